"""Panel execution: pick the top fraction per timestamp, trade it one grid step later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clip, finite
from ..functions.pricing import CostModel
from ..session import interim
from .features import pct_change
from .folds import date_numbers
from .metrics import full_metrics
from .series import ROW, SeriesLayout, in_blocks


def top_fraction_weights(
    df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", fraction: float = 0.30, ts: str = "ts"
) -> DataFrame:
    """Equal weights for the best positive predictions of each timestamp: at most
    ``ceil(valid * fraction)`` names, at least one, ties by symbol. Unselected rows do not appear.

    A timestamp holds each symbol once per model, so its group is bounded by the universe.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0,1]")
    group = [*keys, ts]
    pred = F.col(prediction)
    valid = df.where(pred.isNotNull())
    everyone = Window.partitionBy(*group)
    best = everyone.orderBy(pred.desc(), F.col("symbol").asc())
    ranked = valid.withColumns({
        "_rank": F.row_number().over(best),
        "_n": F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(everyone) * F.lit(fraction))),
        "_positive": F.count(F.when(pred > 0, 1)).over(everyone),
    })
    chosen = ranked.where((pred > 0) & (F.col("_rank") <= F.col("_n")))
    return chosen.withColumn("weight", 1.0 / F.least("_n", "_positive")).select(*keys, ts, "symbol", "weight")


def densify(df: DataFrame, layout: SeriesLayout = SeriesLayout(), fill: Sequence[str] = ()) -> DataFrame:
    """Every symbol on every timestamp of the panel's calendar.

    Each row spreads over the dates up to the symbol's next row, so nothing is paired with everything;
    the work equals the size of the result. ``fill`` columns keep their last value on added rows, all
    others are NULL there. Dates before a symbol's first row come from its first row.
    """
    ts, keys = layout.order[0], list(layout.keys)
    dates = date_numbers(df, ts, layout)
    spread = in_blocks(
        df.join(dates, ts).drop(ROW), layout,
        lambda rows, w: rows.withColumn("_next", F.lead("date_idx").over(w)), ahead=1,
    ).withColumn("_end", dates.agg(F.max("date_idx")).scalar())
    until = F.coalesce(F.col("_next") - 1, F.col("_end"))
    start = F.when(F.col(ROW) == 1, F.lit(0).cast("bigint")).otherwise(F.col("date_idx"))
    cells = spread.withColumn("_cell", F.explode(F.sequence(start, until)))
    real = F.col("_cell") == F.col("date_idx")
    seen = F.col("_cell") >= F.col("date_idx")
    values = [x for x in df.columns if x not in (*keys, ts, ROW)]
    kept = [F.when(seen if x in fill else real, F.col(x)).alias(x) for x in values]
    out = cells.select(*keys, F.col("_cell").alias("date_idx"), real.alias("observed"), *kept)
    return out.join(dates, "date_idx").select(*keys, ts, "date_idx", "observed", *values)


def panel_execution(
    bars: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str] = ("model",),
    fraction: float = 0.30,
    costs: CostModel = CostModel(),
    layout: SeriesLayout = SeriesLayout(),
) -> DataFrame:
    """Net return per model and date from the first predicted date on.

    Weights act one calendar date after their prediction. The dense date-by-symbol matrix is never built:
    a position exists only where a weight was given, a position change is the difference of two such
    rows, and a missing bar returns nothing until the symbol trades again (then the whole gap's return).
    """
    ts, keys = layout.order[0], list(keys)
    dates = interim(date_numbers(bars, ts, layout))
    returns = in_blocks(
        bars.select("symbol", ts, "close"), layout,
        lambda rows, w: rows.withColumn("asset_return", F.coalesce(pct_change("close", 1, w), F.lit(0.0))), back=1,
    ).join(dates, ts).select("symbol", "date_idx", "asset_return")
    weights = interim(
        top_fraction_weights(predictions, keys, fraction=fraction, ts=ts).join(dates, ts).select(*keys, "date_idx", "symbol", "weight")
    )
    held = weights.withColumn("date_idx", F.col("date_idx") + 1)
    gross = (
        held.join(returns, ["symbol", "date_idx"], "left")
        .groupBy(*keys, "date_idx")
        .agg(
            F.sum(F.col("weight") * F.coalesce("asset_return", F.lit(0.0))).alias("gross_return"),
            F.sum(F.col("weight") * F.col("weight")).alias("concentration"),
        )
    )
    entered = held.withColumn("change", F.col("weight"))
    left = held.withColumn("date_idx", F.col("date_idx") + 1).withColumn("change", -F.col("weight"))
    turnover = (
        entered.unionByName(left).groupBy(*keys, "date_idx", "symbol").agg(F.sum("change").alias("change"))
        .groupBy(*keys, "date_idx").agg(F.sum(F.abs("change")).alias("turnover"))
    )
    known = predictions.where(F.col("prediction").isNotNull())
    first = known.groupBy(*keys).agg(F.min(ts).alias(ts)).join(dates, ts).drop(ts)
    # The calendar of each model counts up from its first predicted date.
    days = first.withColumn("_end", dates.agg(F.max("date_idx")).scalar()).select(
        *keys, F.explode(F.sequence("date_idx", "_end")).alias("date_idx")
    )
    return (
        days.join(dates, "date_idx")
        .join(gross, [*keys, "date_idx"], "left").join(turnover, [*keys, "date_idx"], "left")
        .fillna(0.0, ["gross_return", "concentration", "turnover"])
        .withColumn("cost_rate", costs.rate("turnover"))
        .withColumn("net_return", F.col("gross_return") - F.col("cost_rate"))
        .select(*keys, ts, "date_idx", "gross_return", "turnover", "cost_rate", "net_return", "concentration")
    )


def panel_metrics(executed: DataFrame, keys: Sequence[str] = ("model",), ts: str = "ts") -> DataFrame:
    """All metrics per model with concentration, instability and robustness."""
    keys = list(keys)
    stored = interim(executed)
    base = full_metrics(stored, SeriesLayout(keys=tuple(keys), order=(ts,)))
    concentration = stored.groupBy(*keys).agg(F.avg("concentration").alias("concentration"))
    out = base.join(concentration, keys).withColumn("instability", clip(finite("monthly_return_volatility", 0.0), 0.0, 1.0))
    robust = (1.0 - F.col("max_drawdown")) * (1.0 - F.col("instability")) * (1.0 - F.col("negative_month_rate"))
    return out.withColumn("robustness", clip(robust, 0.0, 1.0))
