"""Forward labels: returns, adverse excursions, excess returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.clean import finite, ratio
from .features import percentile_rank
from .series import DEFAULT_LAYOUT, SeriesLayout, in_blocks


def forward_return(h: int, w: WindowSpec, price: str = "close"):
    return finite(ratio(F.lead(price, h).over(w), F.col(price)) - 1.0)


def adverse_excursion(h: int, w: WindowSpec, price: str = "close"):
    frame = w.rowsBetween(1, h)
    worst = ratio(F.min(price).over(frame), F.col(price)) - 1.0
    return finite(F.when(F.count(price).over(frame) == h, worst))


def panel_labels(
    df: DataFrame,
    horizons: Sequence[int] = (1, 5, 20),
    benchmark: DataFrame | None = None,
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Add ``fwd_return_h``, ``adverse_excursion_h`` and, given a benchmark ``(ts, close)``,
    ``fwd_excess_return_h``. The benchmark moves forward on its own calendar before it is joined."""
    if not horizons or any(int(h) <= 0 for h in horizons):
        raise ValueError("horizons must be positive")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        columns = {}
        for h in horizons:
            columns[f"fwd_return_{h}"] = forward_return(h, w)
            columns[f"adverse_excursion_{h}"] = adverse_excursion(h, w)
        return rows.withColumns(columns)

    labelled = in_blocks(df, layout, build, ahead=max(horizons))
    if benchmark is None:
        return labelled
    ts = layout.order[0]
    bench_layout = SeriesLayout(keys=(), order=(ts,), bucket=layout.bucket, block_rows=layout.block_rows)
    moved = in_blocks(
        benchmark.select(ts, F.col("close").cast("double").alias("close")),
        bench_layout,
        lambda rows, w: rows.withColumns({f"_b{h}": forward_return(h, w) for h in horizons}),
        ahead=max(horizons),
    ).select(ts, *[f"_b{h}" for h in horizons])
    joined = labelled.join(moved, ts, "left")
    excess = {f"fwd_excess_return_{h}": F.col(f"fwd_return_{h}") - F.col(f"_b{h}") for h in horizons}
    return joined.withColumns(excess).drop(*[f"_b{h}" for h in horizons])


def supervised_rows(
    df: DataFrame, features: Sequence[str], horizon: int = 5, layout: SeriesLayout = DEFAULT_LAYOUT
) -> DataFrame:
    """Feature rows with a known forward return ``target``; incomplete rows drop out."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    labelled = in_blocks(
        df, layout, lambda rows, w: rows.withColumn("target", forward_return(horizon, w)), ahead=horizon
    )
    return labelled.dropna("any", subset=[*features, "target"])


def rank_label(df: DataFrame, source: str, out: str, by: str = "ts") -> DataFrame:
    """Documented extra: forward return as a cross-sectional rank."""
    return df.withColumn(out, percentile_rank(source, by))


def hurdle_label(df: DataFrame, source: str, out: str, cost: float, hurdle: float = 0.0) -> DataFrame:
    """Documented extra: did the forward return clear cost plus hurdle?"""
    return df.withColumn(out, (F.col(source) > cost + hurdle).cast("int"))
