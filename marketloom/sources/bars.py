"""Bar tables: filtered scans and a pruned, date-partitioned layout."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import DatasetMetadata
from ..schemas import BARS_DDL


def select_bars(df: DataFrame, symbols: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the given symbols between ``start`` and ``end``, both inclusive. On a table with a ``dt``
    partition column the dates prune folders, the rest is pushed to the scan."""
    out = df.where(F.col("symbol").isin(list(symbols)))
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        moment = F.lit(bound).cast("timestamp")
        out = out.where(F.col("ts") >= moment if low else F.col("ts") <= moment)
        if "dt" in df.columns:
            out = out.where(F.col("dt") >= F.to_date(moment) if low else F.col("dt") <= F.to_date(moment))
    return out


def bars_on_dates(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Bars of a date-partitioned table on the days ``dt`` of ``dates``, a filtered table of days.

    The days are not known when the query is planned: Spark prunes the date folders while it runs, by the days that the
    other side of the join has turned out to have. Bars and days without a date match nothing.
    """
    days = dates.select(F.col("dt").alias("_day")).distinct()
    return bars.join(days, F.col("dt") == F.col("_day"), "left_semi")


def read_bars(spark: SparkSession, path: str, partitioned: bool = True) -> DataFrame:
    return spark.read.schema(BARS_DDL + (", dt date" if partitioned else "")).parquet(path)


def write_bars(df: DataFrame, path: str, mode: str = "append", files_per_date: int = 1) -> None:
    """Write date folders whose files are sorted by symbol. Rows go to ``files_per_date`` tasks per date by
    symbol hash, so busy dates and symbols are split when that number is raised."""
    salt = F.pmod(F.xxhash64("symbol", "ts"), F.lit(files_per_date))
    (
        df.withColumn("dt", F.to_date("ts"))
        .withColumn("_salt", salt)
        .repartition("dt", "_salt")
        .drop("_salt")
        .sortWithinPartitions("dt", "symbol", "ts")
        .write.mode(mode).partitionBy("dt").parquet(path)
    )


@dataclass(frozen=True)
class BarProvider:
    """A named bar source: any callable that returns a bar DataFrame."""

    metadata: DatasetMetadata
    load: Callable[[], DataFrame]

    def load_bars(self, symbols: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
        return select_bars(self.load(), symbols, start, end)
