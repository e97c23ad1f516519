"""Causal rolling features per series and percentile ranks per timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.clean import finite, ratio
from .audit import BarAudit
from .series import DEFAULT_LAYOUT, SeriesLayout, in_blocks

PERIODS_PER_YEAR = 252
TECHNICAL_COLUMNS = (
    "return_1", "momentum_5", "momentum_20", "sma_20_dist", "realized_vol_20", "volume_z_20", "breakout_20",
)
PANEL_COLUMNS = (
    "return_1", "momentum_20", "realized_vol_20", "volume_z_20", "momentum_rank", "volatility_rank", "volume_rank",
)
RANKED = {"momentum_rank": "momentum_20", "volatility_rank": "realized_vol_20", "volume_rank": "volume_z_20"}
LOOKBACK = 20


def pct_change(c: str, n: int, w: WindowSpec) -> Column:
    return finite(ratio(F.col(c).cast("double"), F.lag(F.col(c).cast("double"), n).over(w)) - 1.0)


def full_frame(value: Column, counted: str, w: WindowSpec, n: int) -> Column:
    """``value`` only where the frame holds ``n`` known inputs."""
    return F.when(F.count(counted).over(w) == n, value)


def _volume_z(w20: WindowSpec) -> Column:
    mean, sd = F.avg("volume").over(w20), F.stddev_pop("volume").over(w20)
    return finite(full_frame(ratio(F.col("volume") - mean, sd), "volume", w20, 20))


def technical_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Add the seven single-series features; ``w`` orders each series and may be a block window."""
    w20, prior20 = w.rowsBetween(-19, 0), w.rowsBetween(-20, -1)
    with_returns = df.withColumns({
        "return_1": pct_change("close", 1, w),
        "momentum_5": pct_change("close", 5, w),
        "momentum_20": pct_change("close", 20, w),
        "sma_20_dist": finite(full_frame(ratio(F.col("close"), F.avg("close").over(w20)) - 1.0, "close", w20, 20)),
        "volume_z_20": _volume_z(w20),
        "breakout_20": finite(
            full_frame(ratio(F.col("close"), F.max("high").over(prior20)) - 1.0, "high", prior20, 20)
        ),
    })
    vol = F.stddev_pop("return_1").over(w20) * math.sqrt(PERIODS_PER_YEAR)
    return with_returns.withColumn("realized_vol_20", finite(full_frame(vol, "return_1", w20, 20)))


def _feature_blocks(df: DataFrame, layout: SeriesLayout, build, audit: BarAudit | None) -> DataFrame:
    if audit is None:
        return in_blocks(df, layout, build, back=LOOKBACK)
    return audit.watch(in_blocks(df, layout, audit.beside(build, layout.order[0]), back=LOOKBACK, ahead=1))


def technical_features(df: DataFrame, layout: SeriesLayout = DEFAULT_LAYOUT, audit: BarAudit | None = None) -> DataFrame:
    """Seven technical features for all series at once; NULL until a frame is full. ``audit`` checks the bars in passing."""
    require_columns(df, ("close", "high", "low", "volume"))
    return _feature_blocks(df, layout, technical_columns, audit)


def panel_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    w20 = w.rowsBetween(-19, 0)
    base = df.withColumns({
        "return_1": pct_change("close", 1, w),
        "momentum_20": pct_change("close", 20, w),
        "volume_z_20": _volume_z(w20),
    })
    vol = F.stddev_pop("return_1").over(w20) * math.sqrt(PERIODS_PER_YEAR)
    return base.withColumn("realized_vol_20", finite(full_frame(vol, "return_1", w20, 20)))


def percentile_rank(value: str, by: str = "ts") -> Column:
    """Average-tie rank divided by the number of known values of the same timestamp.

    A timestamp holds each symbol once, so its group is bounded by the universe.
    """
    x = F.col(value)
    below = F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    known = F.count(x).over(Window.partitionBy(by))
    return F.when(x.isNotNull(), (below + (ties - 1) / F.lit(2.0)) / known)


def cross_sectional_ranks(df: DataFrame, ranks: dict[str, str] = RANKED, by: str = "ts") -> DataFrame:
    return df.withColumns({out: percentile_rank(source, by) for out, source in ranks.items()})


def cross_sectional_features(df: DataFrame, layout: SeriesLayout = DEFAULT_LAYOUT, audit: BarAudit | None = None) -> DataFrame:
    """Panel features per symbol, then their ranks within each timestamp."""
    return cross_sectional_ranks(_feature_blocks(df, layout, panel_columns, audit), by=layout.order[0])


def prior_volatility(net_or_asset_return: str, w: WindowSpec) -> Column:
    """Volatility known before the bar: 20 earlier returns, at least 5, else 0."""
    prior = w.rowsBetween(-20, -1)
    vol = F.stddev_pop(net_or_asset_return).over(prior) * math.sqrt(PERIODS_PER_YEAR)
    return F.when(F.count(net_or_asset_return).over(prior) >= 5, vol).otherwise(F.lit(0.0))


def long_horizon_columns(df: DataFrame, w: WindowSpec, momentum: tuple[int, ...] = (60, 120), peak: int = 60) -> DataFrame:
    """Documented extras: long momentum and drawdown from the rolling peak."""
    frame = w.rowsBetween(-(peak - 1), 0)
    out = df.withColumns({f"momentum_{n}": pct_change("close", n, w) for n in momentum})
    drawdown = full_frame(1.0 - ratio(F.col("close"), F.max("close").over(frame)), "close", frame, peak)
    return out.withColumn(f"drawdown_{peak}", drawdown)


def long_horizon_features(df: DataFrame, layout: SeriesLayout = DEFAULT_LAYOUT) -> DataFrame:
    return in_blocks(df, layout, long_horizon_columns, back=120)


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
