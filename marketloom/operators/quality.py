"""Row rules and table checks. Every rule set yields ordered reason codes, so a row can fail many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import within
from ..functions.clean import as_col
from ..functions.pricing import age_seconds, spread_fraction
from ..functions.reasons import (
    is_blank, negative, not_finite, not_positive, outside_unit, passes, reason_codes,
)
from ..functions.text import has_direct_order, hypothesis_text
from .features import require_columns

BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")
c = F.col


@dataclass(frozen=True)
class LiveLimits:
    max_quote_age_seconds: float = 30.0
    max_account_age_seconds: float = 120.0
    max_spread_fraction: float = 0.02

    def __post_init__(self) -> None:
        within(self, max_spread_fraction="(0, 1)", max_quote_age_seconds="(0,", max_account_age_seconds="(0,")


def checked(df: DataFrame, rules: Column, reasons: str = "reasons", ok: str = "ok") -> DataFrame:
    return df.withColumn(reasons, rules).withColumn(ok, passes(F.col(reasons)))


# --- whole tables --------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def bar_violations(df: DataFrame) -> DataFrame:
    """One row per broken table rule, with its number of rows; no row means the table is valid."""
    require_columns(df, BAR_COLUMNS)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("close").isNull() | ~(c("close") > 0)).alias("close"),
        F.count_if(c("volume") < 0).alias("volume"),
    )
    table_rules = counts.select(F.explode(F.array(
        F.struct(F.lit("EMPTY").alias("rule"), F.when(c("n") == 0, 1).otherwise(0).cast("bigint").alias("rows")),
        F.struct(F.lit("CLOSE_NOT_POSITIVE").alias("rule"), c("close").alias("rows")),
        F.struct(F.lit("VOLUME_NEGATIVE").alias("rule"), c("volume").alias("rows")),
    )).alias("v")).select("v.*")
    copies = duplicate_keys(df).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"))
    repeated = copies.select(F.lit("DUPLICATE_KEY").alias("rule"), "rows")
    return table_rules.unionByName(repeated).where("rows > 0")


def require_valid_bars(df: DataFrame) -> DataFrame:
    """Fail closed: raise if any table rule is broken, else hand the table on."""
    broken = [f"{x.rule}({x.rows})" for x in bar_violations(df).collect()]  # at most four rows
    if broken:
        raise ValueError("invalid bars: " + ", ".join(sorted(broken)))
    return df


def as_panel(df: DataFrame) -> DataFrame:
    """Bars with UTC timestamps and unique (ts, symbol); row order carries no meaning."""
    return require_valid_bars(df.withColumn("ts", c("ts").cast("timestamp")))


def as_of(df: DataFrame, decision_time: str | Column) -> DataFrame:
    """Only what was available at the decision time; tables without that column pass unchanged."""
    if "available_time" not in df.columns:
        return df
    moment = F.lit(decision_time).cast("timestamp") if isinstance(decision_time, str) else decision_time
    return df.where(c("available_time") <= moment)


# --- rows ----------------------------------------------------------------------------------------


def bar_rules() -> Column:
    prices = [c("open"), c("high"), c("low"), c("close")]
    bad_price = not_positive(prices[0])
    for p in prices[1:]:
        bad_price = bad_price | not_positive(p)
    return reason_codes([
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (bad_price, "INVALID_PRICE"),
        (c("high") < F.greatest("open", "close", "low"), "HIGH_INCONSISTENT"),
        (c("low") > F.least("open", "close", "high"), "LOW_INCONSISTENT"),
        (negative(c("volume")), "INVALID_VOLUME"),
        (c("ts").isNull(), "TIMESTAMP_REQUIRED"),
    ])


def quote_rules() -> Column:
    # NaN compares as larger than everything, so ordering rules look at finite prices only.
    unknown = not_finite(c("bid")) | not_finite(c("ask"))
    return reason_codes([
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (unknown, "PRICE_NOT_FINITE"),
        (~unknown & ((c("bid") <= 0.0) | (c("ask") <= 0.0)), "PRICE_NOT_POSITIVE"),
        (~unknown & (c("ask") < c("bid")), "CROSSED_QUOTE"),
        (c("ts").isNull(), "TIMESTAMP_REQUIRED"),
    ])


def spec_rules() -> Column:
    return reason_codes([
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (not_positive(c("tick_size")), "TICK_SIZE"),
        (not_positive(c("volume_min")), "VOLUME_MIN"),
        (not_positive(c("volume_max")), "VOLUME_MAX"),
        (not_positive(c("volume_step")), "VOLUME_STEP"),
        (negative(c("tick_value")), "TICK_VALUE"),
        (c("volume_max") < c("volume_min"), "VOLUME_RANGE"),
    ])


def account_rules() -> Column:
    return reason_codes([
        (not_finite(c("balance")) | not_finite(c("equity")) | not_finite(c("free_margin")), "NOT_FINITE"),
        (c("balance") < 0.0, "NEGATIVE_BALANCE"),
        (c("equity") <= 0.0, "EQUITY_NOT_POSITIVE"),
        (c("free_margin") < 0.0, "NEGATIVE_FREE_MARGIN"),
        (is_blank(c("currency")), "CURRENCY_REQUIRED"),
    ])


def live_quote_rules(now: str | Column, limits: LiveLimits = LiveLimits(), ts: str = "ts") -> Column:
    return reason_codes([
        (age_seconds(now, ts) > limits.max_quote_age_seconds, "STALE_QUOTE"),
        (spread_fraction() > limits.max_spread_fraction, "EXCESSIVE_SPREAD"),
    ])


def live_account_rules(now: str | Column, limits: LiveLimits = LiveLimits(), ts: str = "ts") -> Column:
    return reason_codes([
        (age_seconds(now, ts) > limits.max_account_age_seconds, "STALE_ACCOUNT"),
        (c("equity") <= 0.0, "INVALID_EQUITY"),
        (c("free_margin") < 0.0, "INVALID_FREE_MARGIN"),
    ])


def live_symbol_rules() -> Column:
    return reason_codes([
        (~c("trade_enabled"), "SYMBOL_DISABLED"),
        (c("tick_size") <= 0.0, "INVALID_TICK_SIZE"),
        ((c("volume_min") <= 0.0) | (c("volume_step") <= 0.0), "INVALID_VOLUME_RULES"),
        (c("volume_max") < c("volume_min"), "INVALID_VOLUME_RANGE"),
    ])


def signal_rules() -> Column:
    return reason_codes([
        (outside_unit(c("score")), "SCORE_RANGE"),
        (outside_unit(c("confidence")), "CONFIDENCE_RANGE"),
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (is_blank(c("source")), "SOURCE_REQUIRED"),
    ])


def target_rules() -> Column:
    return reason_codes([
        (outside_unit(c("weight")), "WEIGHT_RANGE"),
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
    ])


def opportunity_rules() -> Column:
    return reason_codes([
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (is_blank(c("source")), "SOURCE_REQUIRED"),
        (negative(c("expected_cost")), "EXPECTED_COST"),
        (negative(c("downside_risk")), "DOWNSIDE_RISK"),
        (negative(c("correlation_penalty")), "CORRELATION_PENALTY"),
        (negative(c("uncertainty")), "UNCERTAINTY"),
        (outside_unit(c("confidence")), "CONFIDENCE_RANGE"),
        (not_finite(c("expected_return")), "EXPECTED_RETURN"),
    ])


def intent_rules() -> Column:
    return reason_codes([
        (is_blank(c("decision_id")), "DECISION_ID_REQUIRED"),
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (negative(c("estimated_risk_usd")), "ESTIMATED_RISK"),
        (negative(c("notional_usd")), "NOTIONAL"),
        (negative(c("expected_cost_usd")), "EXPECTED_COST"),
        (not_finite(c("expected_gross_edge_usd")), "EXPECTED_EDGE"),
        (~(c("equity_usd") > 0.0), "EQUITY_NOT_POSITIVE"),
        (~(c("equity_peak_usd") > 0.0), "PEAK_NOT_POSITIVE"),
    ])


def plan_rules(mode: str = "shadow") -> Column:
    """Shadow plans need positive risk and notional; paper plans may be zero."""
    risk, notional = c("risk_fraction"), c("notional_fraction")
    if mode == "paper":
        return reason_codes([
            (is_blank(c("decision_id")), "DECISION_ID_REQUIRED"),
            (not_finite(risk) | (risk < 0.0) | (risk >= 1.0), "RISK_FRACTION"),
            (not_finite(notional) | (notional < 0.0), "NOTIONAL_FRACTION"),
        ])
    return reason_codes([
        (is_blank(c("decision_id")), "DECISION_ID_REQUIRED"),
        (not_finite(risk) | (risk <= 0.0) | (risk >= 1.0), "RISK_FRACTION"),
        (not_positive(notional), "NOTIONAL_FRACTION"),
        (not_positive(c("reward_risk")), "REWARD_RISK"),
    ])


def hypothesis_rules() -> Column:
    lists = ("evidence", "validation_plan", "invalidation_criteria")
    joined = hypothesis_text("hypothesis", "proposed_change", *lists)
    return reason_codes([
        (F.coalesce(F.length("hypothesis"), F.lit(0)) < 5, "HYPOTHESIS_TOO_SHORT"),
        (F.coalesce(F.length("proposed_change"), F.lit(0)) < 5, "CHANGE_TOO_SHORT"),
        *[(F.coalesce(F.size(name), F.lit(0)) < 1, f"{name.upper()}_REQUIRED") for name in lists],
        (has_direct_order(joined), "DIRECT_ORDER"),
    ])


def decision_event_rules(ts: str = "ts") -> Column:
    return reason_codes([
        (is_blank(c("decision_id")), "DECISION_ID_REQUIRED"),
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (is_blank(c("strategy")), "STRATEGY_REQUIRED"),
        (outside_unit(c("signal_score")), "SIGNAL_SCORE_RANGE"),
        (outside_unit(c("confidence")), "CONFIDENCE_RANGE"),
        (c(ts).isNull(), "TIMESTAMP_REQUIRED"),
    ])


def lifecycle_event_rules(ts: str = "ts") -> Column:
    return reason_codes([
        (is_blank(c("event_id")), "EVENT_ID_REQUIRED"),
        (is_blank(c("decision_id")), "DECISION_ID_REQUIRED"),
        (c("event_type").isNull() | ~c("event_type").isin("OPEN", "CLOSE"), "EVENT_TYPE"),
        (is_blank(c("symbol")), "SYMBOL_REQUIRED"),
        (c(ts).isNull(), "TIMESTAMP_REQUIRED"),
    ])


def portfolio_state_rules() -> Column:
    ids = F.transform("positions", lambda p: p["decision_id"])
    return reason_codes([
        (not_positive(c("base_equity_usd")), "BASE_EQUITY"),
        (not_finite(c("realized_pnl_usd")), "REALIZED_PNL"),
        (not_positive(c("equity_peak_usd")), "EQUITY_PEAK"),
        (as_col("updated_at").isNull(), "TIMESTAMP_REQUIRED"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_POSITION"),
    ])


def promotable_grade(grade: str | Column = "grade") -> Column:
    """Demonstration data may never promote a model."""
    return F.coalesce(as_col(grade) == "research_grade", F.lit(False))
