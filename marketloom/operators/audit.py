"""Table checks in passing: counted by the job that reads the bars anyway, not by a scan of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, WindowSpec
from pyspark.sql import functions as F

SAME = "_same_key"
RULES = ("EMPTY", "CLOSE_NOT_POSITIVE", "VOLUME_NEGATIVE", "DUPLICATE_KEY")


class BarAudit:
    """The rules of ``quality.bar_violations``, watched while one job runs.

    An operator that cuts series into blocks has every row beside its neighbours, so rows that repeat a key are seen there
    without a grouping of their own: :meth:`beside` adds a mark to its block function, :meth:`watch` counts and drops it.
    The counts exist once a job over the watched rows has ended; until then :meth:`violations` waits.
    """

    def __init__(self) -> None:
        self.seen = Observation()

    def beside(self, build: Callable[[DataFrame, WindowSpec], DataFrame], time: str = "ts") -> Callable[[DataFrame, WindowSpec], DataFrame]:
        """``build`` and a mark on rows whose neighbour has their time. It needs one row back and one ahead."""

        def marked(df: DataFrame, w: WindowSpec) -> DataFrame:
            def repeats(side) -> F.Column:
                there, other = side(F.lit(True), 1).over(w), side(time, 1).over(w)
                return F.coalesce(there & other.eqNullSafe(F.col(time)), F.lit(False))

            return build(df, w).withColumn(SAME, repeats(F.lag) | repeats(F.lead))

        return marked

    def watch(self, df: DataFrame) -> DataFrame:
        close = F.col("close")
        return df.observe(
            self.seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(close.isNull() | ~(close > 0)).alias("CLOSE_NOT_POSITIVE"),
            F.count_if(F.col("volume") < 0).alias("VOLUME_NEGATIVE"),
            F.count_if(SAME).alias("DUPLICATE_KEY"),
        ).drop(SAME)

    def violations(self) -> dict[str, int]:
        """Broken rules and their rows (for an empty table 1)."""
        counts = dict(self.seen.get)
        counts["EMPTY"] = int(not counts.get("rows"))
        return {rule: counts[rule] for rule in RULES if counts.get(rule)}

    def require(self) -> None:
        """Fail closed: what the job wrote must not be used if a rule is broken."""
        broken = [f"{rule}({n})" for rule, n in sorted(self.violations().items())]
        if broken:
            raise ValueError("invalid bars: " + ", ".join(broken))
