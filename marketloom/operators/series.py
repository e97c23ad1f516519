"""Ordered series at scale.

A window over ``partitionBy(symbol).orderBy(ts)`` puts a whole symbol into one task, however many
rows it has. The helpers here give the same answers from bounded pieces:

* ``index_rows`` numbers the rows of every series: rows are counted per calendar bucket (small, map-side
  combined), the counts are summed up along the calendar, and rows are ranked inside their bucket only.
* ``in_blocks`` cuts a numbered series into blocks of ``block_rows`` rows, copies the few rows a window
  looks back or ahead across a block edge, and runs ordinary window expressions per block.
* ``running_*`` carry block totals forward, so running products, sums and maxima need one value per
  block and never the series itself.

The calendar bounds what still meets per key: a bucket table has at most one row per key and day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROW = "row_idx"
BLOCK = "series_block"


@dataclass(frozen=True)
class SeriesLayout:
    """What one series is (``keys``), how it is ordered, and how it is cut.

    ``order`` starts with the time column; further columns break ties. ``bucket`` is the calendar unit
    of the row count; one bucket of one series must fit a task.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    bucket: str = "day"
    block_rows: int = 100_000

    def __post_init__(self) -> None:
        if not self.order:
            raise ValueError("a series needs an order column")
        if self.block_rows <= 0:
            raise ValueError("block_rows must be positive")

    def keyed(self, *keys: str) -> "SeriesLayout":
        return replace(self, keys=tuple(keys))

    @property
    def block_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)


DEFAULT_LAYOUT = SeriesLayout()


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key, so that no row is lost for want of a key. It shuffles by keys of
    its own: a grouped aggregate after it gets an exchange, and a partial sum before that."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def index_rows(df: DataFrame, layout: SeriesLayout = DEFAULT_LAYOUT) -> DataFrame:
    """Add ``row_idx``: 1, 2, 3 ... along every series. 

    Rows without a time come first. A row without a key belongs to no series: it is kept and numbered inside its
    bucket only, and running values of it are null.
    """
    keys = list(layout.keys)
    bucketed = df.withColumn("_bucket", F.date_trunc(layout.bucket, F.col(layout.order[0])))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(*keys, "_bucket", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*layout.order)
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "_bucket"], "left")  # plain keys: the window's shuffle serves the join too
        .withColumn(ROW, F.coalesce("_before", F.lit(0)) + F.col("_rank"))
        .drop("_bucket", "_rank", "_before")
        .select(*df.columns, ROW)
    )


def in_blocks(
    df: DataFrame,
    layout: SeriesLayout,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    keep_block: bool = False,
) -> DataFrame:
    """Run ``build(rows, window)`` on blocks that hold ``back`` earlier and ``ahead`` later rows.

    ``build`` may use any window frame within those bounds. Rows copied across an edge are removed
    again, so every input row comes out once.
    """
    rows = df if ROW in df.columns else index_rows(df, layout)
    n = layout.block_rows
    first = F.expr(f"greatest(0L, {ROW} - 1 - {int(ahead)}) div {n}")
    last = F.expr(f"({ROW} - 1 + {int(back)}) div {n}")
    spread = rows.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    built = build(spread, layout.block_window)
    own = built.where(F.expr(f"({ROW} - 1) div {n} = {BLOCK}"))
    return own if keep_block else own.drop(BLOCK)


def block_of(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Number the rows and name their block, without copies."""
    rows = df if ROW in df.columns else index_rows(df, layout)
    return rows.withColumn(BLOCK, F.expr(f"({ROW} - 1) div {layout.block_rows}"))


def opens_block(layout: SeriesLayout) -> Column:
    return F.expr(f"({ROW} - 1) % {layout.block_rows} = 0")


def _carry_window(layout: SeriesLayout) -> WindowSpec:
    return Window.partitionBy(*layout.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, layout: SeriesLayout, columns: dict[str, str | Column]) -> DataFrame:
    """Running sums ``{output: input}`` along each series."""
    rows = df if BLOCK in df.columns else block_of(df, layout)
    totals = rows.groupBy(*layout.keys, BLOCK).agg(
        *[F.sum(F.col(c) if isinstance(c, str) else c).alias(f"_t_{out}") for out, c in columns.items()]
    )
    before = _carry_window(layout)
    carry = totals.select(
        *layout.keys, BLOCK, *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in columns]
    )
    w = layout.block_window.rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, [*layout.keys, BLOCK], "left")
    for out, c in columns.items():
        joined = joined.withColumn(out, F.col(f"_c_{out}") + F.sum(F.col(c) if isinstance(c, str) else c).over(w))
    return joined.drop(*[f"_c_{out}" for out in columns])


def compound(
    df: DataFrame,
    layout: SeriesLayout,
    rate: str,
    *,
    start: float = 1.0,
    equity: str = "equity",
    peak: str = "equity_peak",
    before: str | None = None,
) -> DataFrame:
    """Compound ``rate`` along each series: equity, its running peak and (optionally) prior equity.

    The peak begins at the first equity value, not at ``start``; callers that count the starting
    capital as a peak take ``greatest(peak, start)``.
    """
    rows = df if BLOCK in df.columns else block_of(df, layout)
    keys = list(layout.keys)
    growth = 1.0 + F.col(rate)
    upto = layout.block_window.rowsBetween(Window.unboundedPreceding, 0)
    shape = (
        rows.select(*keys, BLOCK, *layout.order, F.product(growth).over(upto).alias("_local"))
        .groupBy(*keys, BLOCK)
        .agg(F.max_by("_local", F.struct(*layout.order)).alias("_total"), F.max("_local").alias("_top"))
    )
    prior = _carry_window(layout)
    carry = (
        shape.withColumn("_start", F.lit(float(start)) * F.coalesce(F.product("_total").over(prior), F.lit(1.0)))
        .withColumn("_peak0", F.max(F.col("_start") * F.col("_top")).over(prior))
        .select(*keys, BLOCK, "_start", "_peak0")
    )
    # Seeding the first factor keeps the multiplication order of a plain running product.
    seeded = F.when(opens_block(layout), F.col("_start") * growth).otherwise(growth)
    out = rows.join(carry, [*keys, BLOCK], "left").withColumn(equity, F.product(seeded).over(upto))
    out = out.withColumn(peak, F.greatest(F.col("_peak0"), F.max(equity).over(upto)))
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(equity).over(layout.block_window), F.col("_start")))
    return out.drop("_start", "_peak0")


def latest_per_key(df: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """The last row of every series, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def last_rows(df: DataFrame, layout: SeriesLayout, n: int, minimum: int = 0) -> DataFrame:
    """The last ``n`` rows per series with ``bar_count``; too short a series is flagged, not dropped."""
    rows = df if ROW in df.columns else index_rows(df, layout)
    total = rows.groupBy(*layout.keys).agg(F.max(ROW).alias("series_rows"))
    tail = join_keys(rows, total, list(layout.keys)).where(F.col(ROW) > F.col("series_rows") - n)
    kept = F.least(F.lit(n), F.col("series_rows"))
    return tail.withColumn("bar_count", kept).withColumn("enough_bars", kept >= minimum).drop("series_rows")
