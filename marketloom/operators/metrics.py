"""Performance, stability, and research score of return series."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clip, finite, safe_ratio
from ..session import interim
from .quantile import exact_quantile
from .series import BLOCK, SeriesLayout, compound, join_keys

PERIODS = 252
PERFORMANCE_COLUMNS = (
    "cagr", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "cvar_95",
    "hit_rate", "profit_factor", "excess_return", "beta", "alpha",
)
STABILITY_COLUMNS = (
    "negative_month_rate", "monthly_observations", "worst_month", "monthly_return_volatility", "average_loss_month",
)


def _cagr(wealth: Column, n: Column, periods: int) -> Column:
    return (
        F.when(n == 0, F.lit(0.0))
        .when(wealth <= 0, F.lit(-1.0))
        .otherwise(F.pow(wealth, periods / n) - 1.0)
    )


def drawdown_curve(df: DataFrame, layout: SeriesLayout, ret: str = "net_return") -> DataFrame:
    """Add ``wealth, wealth_peak, drawdown``. The peak starts at the first wealth, so a first-bar loss
    is not a drawdown."""
    clean = df.withColumn("_r", finite(ret, 0.0))
    curve = compound(clean, layout, "_r", equity="wealth", peak="wealth_peak")
    ratio = F.try_divide(F.col("wealth"), F.nullif(F.col("wealth_peak"), F.lit(0.0)))
    return curve.withColumn("drawdown", 1.0 - ratio).drop("_r", BLOCK)


def performance_metrics(
    df: DataFrame,
    layout: SeriesLayout,
    ret: str = "net_return",
    benchmark_ret: str | None = None,
    periods: int = PERIODS,
    stored: bool = False,
) -> DataFrame:
    """13 metrics per series. ``benchmark_ret`` is a column aligned to the rows (NULL counts as 0).

    The rows are read several times (curve, moments, quantile, tail), so they are stored first unless
    the caller says they already are.
    """
    keys = list(layout.keys)
    bench = finite(benchmark_ret, 0.0) if benchmark_ret else F.lit(None).cast("double")
    passed = [c for c in df.columns if c in ("row_idx", BLOCK)]
    rows = df.select(*keys, *layout.order, *passed, finite(ret, 0.0).alias("_x"), bench.alias("_b"))
    if not stored:
        rows = interim(rows)
    curve = drawdown_curve(rows, layout, "_x")
    r, b = F.col("_x"), F.col("_b")
    year = math.sqrt(periods)
    stats = curve.groupBy(*keys).agg(
        F.count(r).alias("_n"),
        F.product(1.0 + r).alias("_wealth"),
        F.avg(r).alias("_mean"),
        F.stddev_pop(r).alias("_sd"),
        F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.max("drawdown").alias("_dd"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.sum(F.when(r > 0, r)).alias("_wins"),
        F.abs(F.sum(F.when(r < 0, r))).alias("_losses"),
        F.product(1.0 + b).alias("_bwealth"),
        F.avg(b).alias("_bmean"),
        F.var_pop(b).alias("_bvar"),
        F.covar_pop(r, b).alias("_cov"),
    )
    cut = exact_quantile(rows, keys, "_x", 0.05, "_q")
    joined = join_keys(rows.select(*keys, "_x"), cut, keys)
    tail = joined.where(F.col("_x") <= F.col("_q")).groupBy(*keys).agg(F.avg("_x").alias("_tail"))
    out = stats.join(tail, keys, "left")

    n = F.col("_n")
    out = out.withColumns({
        "cagr": _cagr(F.col("_wealth"), n, periods),
        "annual_return": F.coalesce(F.col("_mean"), F.lit(0.0)) * periods,
        "volatility": F.coalesce(F.col("_sd"), F.lit(0.0)) * year,
        "max_drawdown": F.greatest(F.lit(0.0), F.coalesce(F.col("_dd"), F.lit(0.0))),
        "cvar_95": F.greatest(F.lit(0.0), -F.coalesce(F.col("_tail"), F.lit(0.0))),
        "profit_factor": safe_ratio(F.coalesce(F.col("_wins"), F.lit(0.0)), F.col("_losses")),
    })
    out = out.withColumns({
        "sharpe": safe_ratio(F.col("annual_return"), F.col("volatility")),
        "sortino": safe_ratio(F.col("annual_return"), F.col("_down") * year),
        "calmar": safe_ratio(F.col("cagr"), F.col("max_drawdown")),
    })
    if benchmark_ret:
        out = out.withColumn("beta", safe_ratio(F.col("_cov"), F.col("_bvar")))
        out = out.withColumns({
            "excess_return": F.col("cagr") - _cagr(F.col("_bwealth"), n, periods),
            "alpha": F.col("annual_return") - F.col("beta") * (F.col("_bmean") * periods),
        })
    else:
        out = out.withColumns({c: F.lit(0.0) for c in ("beta", "excess_return", "alpha")})
    return out.select(*keys, *[finite(c, 0.0).alias(c) for c in PERFORMANCE_COLUMNS])


def monthly_returns(df: DataFrame, keys: Sequence[str], ret: str = "net_return", ts: str = "ts") -> DataFrame:
    """Compounded return per series and calendar month that has rows."""
    return (
        df.groupBy(*keys, F.date_trunc("month", ts).alias("month"))
        .agg((F.product(1.0 + finite(ret, 0.0)) - 1.0).alias("month_return"))
    )


def stability_metrics(df: DataFrame, keys: Sequence[str], ret: str = "net_return", ts: str = "ts") -> DataFrame:
    month = F.col("month_return")
    stats = monthly_returns(df, keys, ret, ts).groupBy(*keys).agg(
        F.avg(F.when(month < 0.0, 1.0).otherwise(0.0)).alias("negative_month_rate"),
        F.count(month).cast("double").alias("monthly_observations"),
        F.min(month).alias("worst_month"),
        F.stddev_pop(month).alias("monthly_return_volatility"),
        (-F.avg(F.when(month < 0.0, month))).alias("average_loss_month"),
    )
    return stats.select(*keys, *[finite(c, 0.0).alias(c) for c in STABILITY_COLUMNS])


def cost_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("turnover").alias("turnover"), F.sum("cost_rate").alias("cost_ratio"))


def full_metrics(df: DataFrame, layout: SeriesLayout, ret: str = "net_return", benchmark_ret: str | None = None) -> DataFrame:
    """Performance, turnover and cost, and monthly stability of backtest rows, one row per series."""
    keys = list(layout.keys)
    wanted = {*keys, *layout.order, ret, "turnover", "cost_rate", "row_idx"} | ({benchmark_ret} if benchmark_ret else set())
    df = interim(df.select(*[c for c in df.columns if c in wanted]))
    parts = [
        performance_metrics(df, layout, ret, benchmark_ret, stored=True),
        cost_metrics(df, keys),
        stability_metrics(df, keys, ret, layout.order[0]),
    ]
    return reduce(lambda a, b: a.join(b, keys), parts)


def baseline_robustness(coverage: Column | None = None) -> Column:
    value = (1.0 - F.col("max_drawdown")) * (1.0 - F.col("negative_month_rate"))
    return clip(value if coverage is None else value * coverage, 0.0, 1.0)


# Weights of the research score.
SCORE_REWARDS: Mapping[str, float] = {
    "cagr": 3.0, "sharpe": 1.2, "sortino": 0.8, "calmar": 0.7, "excess_return": 1.0,
}
ROBUSTNESS_REWARD = 1.5
SCORE_PENALTIES: Mapping[str, float] = {
    "max_drawdown": 4.0, "cvar_95": 5.0, "turnover": 0.08, "instability": 1.0, "concentration": 1.0,
    "negative_month_rate": 2.5, "average_loss_month": 1.5,
}


def research_score(columns: Sequence[str], robustness: str | Column = "robustness") -> Column:
    """Rewards minus penalties; a metric that is missing from ``columns`` or not finite counts as 0."""

    def weighted(table: Mapping[str, float]) -> Column:
        terms = [weight * finite(name, 0.0) for name, weight in table.items() if name in columns]
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    robust = F.col(robustness) if isinstance(robustness, str) else robustness
    reward = weighted(SCORE_REWARDS) + ROBUSTNESS_REWARD * clip(robust, 0.0, 1.0)
    return reward - weighted(SCORE_PENALTIES)
