"""Books: monthly capital ledger, realised and open P&L, regret."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.pricing import pnl
from ..functions.reasons import passes
from .quality import LiveLimits, live_quote_rules


def capital_ledger(
    df: DataFrame, keys: Sequence[str], withdrawal_rate: float = 0.20, starting_hwm: str | None = None
) -> DataFrame:
    """Close every month of every account in order.

    Input: keys, ``month, ending_equity, net_contribution`` (and the first high-water mark). One row per
    account and month goes in, so an account's list is bounded by the calendar and folds inside Spark.
    """
    if not 0.0 <= withdrawal_rate < 1.0:
        raise ValueError("withdrawal_rate must be in [0,1)")
    start = F.first(F.col(starting_hwm)) if starting_hwm else F.lit(0.0)
    months = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("month", "ending_equity", "net_contribution"))).alias("_months"),
        F.coalesce(start, F.lit(0.0)).alias("_hwm"),
    )
    row_type = (
        "array<struct<month:{m},gross_profit_above_hwm:double,withdrawal:double,retained_profit:double,"
        "ending_equity_after_withdrawal:double,next_high_water_mark:double>>"
    ).format(m=df.schema["month"].dataType.simpleString())

    def close(state, m):
        hwm = F.greatest(F.lit(0.0), state["hwm"] + m["net_contribution"])
        profit = F.greatest(F.lit(0.0), m["ending_equity"] - hwm)
        paid = profit * withdrawal_rate
        after = m["ending_equity"] - paid
        mark = F.greatest(hwm, after)
        row = F.struct(
            m["month"].alias("month"), profit.alias("gross_profit_above_hwm"), paid.alias("withdrawal"),
            (profit - paid).alias("retained_profit"), after.alias("ending_equity_after_withdrawal"),
            mark.alias("next_high_water_mark"),
        )
        return F.struct(mark.alias("hwm"), F.concat(state["rows"], F.array(row)).alias("rows"))

    empty = F.struct(F.col("_hwm").alias("hwm"), F.array().cast(row_type).alias("rows"))
    folded = F.aggregate("_months", empty, close, lambda s: s["rows"])
    return months.select(*keys, F.inline(folded))


def regret_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regret of realised against alternative returns, with ``lookahead_rows`` counting alternatives that
    were not available at decision time (a valid summary has none)."""
    real, alt = F.col("realized_net_return"), F.col("alternative_policy_return")
    zero = F.lit(0.0)

    def total(value):
        return F.coalesce(F.sum(value), zero)

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        total(F.greatest(zero, alt - real)).alias("total_regret"),
        F.coalesce(F.avg(F.greatest(zero, alt - real)), zero).alias("mean_regret"),
        total(F.when(real == 0.0, F.greatest(zero, alt))).alias("missed_gain"),
        total(F.when((real < 0.0) & (alt >= 0.0), -real)).alias("avoidable_loss"),
        total(F.greatest(zero, finite("execution_cost_return", 0.0))).alias("execution_cost_drag"),
        F.count_if(~F.col("alternative_available_at_decision")).alias("lookahead_rows"),
    )


def require_causal(summary: DataFrame) -> DataFrame:
    """Fail the job at the first summary that used information from after the decision."""
    bad = F.col("lookahead_rows") > 0
    message = F.lit("counterfactuals must only use information available at decision time")
    return summary.withColumn("lookahead_rows", F.when(bad, F.raise_error(message)).otherwise(F.col("lookahead_rows")))


def daily_realized_pnl(events: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """P&L of CLOSE events per UTC date."""
    return (
        events.where(F.col("event_type") == "CLOSE")
        .groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.sum("pnl_usd").alias("realized_pnl_usd"))
    )


def mark_positions(positions: DataFrame, quotes: DataFrame, now: str, limits: LiveLimits = LiveLimits()) -> DataFrame:
    """Open positions at the latest bid: ``unrealized_pnl_usd`` or ``mark_issues`` saying why not."""
    q = quotes.select("symbol", "bid", "ask", F.col("ts").alias("quote_ts"))
    joined = positions.drop("bid", "ask", "quote_ts").join(q, "symbol", "left")
    issues = F.when(F.col("bid").isNull(), F.array(F.lit("MARKET_DATA_UNAVAILABLE"))).otherwise(
        live_quote_rules(now, limits, ts="quote_ts")
    )
    marked = joined.withColumn("mark_issues", issues)
    value = F.when(passes(F.col("mark_issues")), pnl("quantity", "bid", "entry_price"))
    return marked.withColumn("unrealized_pnl_usd", value)


def book_totals(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return marked.groupBy(*keys).agg(
        F.sum("estimated_risk_usd").alias("open_risk_usd"),
        F.sum("notional_usd").alias("gross_notional_usd"),
        F.coalesce(F.sum("unrealized_pnl_usd"), F.lit(0.0)).alias("unrealized_pnl_usd"),
        F.count_if(F.size("mark_issues") > 0).alias("mark_issue_count"),
    )


def shadow_equity(book: DataFrame) -> DataFrame:
    """Equity from base, realised and open P&L; the peak moves only when every position was marked."""
    equity = F.col("base_equity_usd") + F.col("realized_pnl_usd") + F.col("unrealized_pnl_usd")
    return book.withColumn("shadow_equity_usd", equity).withColumn(
        "equity_peak_usd",
        F.when(F.col("mark_issue_count") == 0, F.greatest("equity_peak_usd", "shadow_equity_usd")).otherwise(
            F.col("equity_peak_usd")
        ),
    )
