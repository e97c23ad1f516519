"""Normalisation of raw vendor tables (ticks, symbols, accounts, rates) to the package's schemas.

Raw tables differ in the columns they carry; an absent column reads as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _raw(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _first(df: DataFrame, names: tuple[str, ...], default: float | None = None) -> Column:
    options = [_raw(df, n) for n in names]
    return F.coalesce(*options, *([F.lit(default)] if default is not None else []))


def tick_time(df: DataFrame) -> Column:
    """Milliseconds if given and not zero, else seconds, else NULL (the row is unusable)."""
    millis, seconds = _raw(df, "time_msc", "bigint"), _raw(df, "time", "bigint")
    return F.coalesce(F.timestamp_millis(F.nullif(millis, F.lit(0))), F.timestamp_seconds(F.nullif(seconds, F.lit(0))))


def vendor_quotes(df: DataFrame, source: str = "mt5") -> DataFrame:
    return df.select(
        "symbol", F.col("bid").cast("double"), F.col("ask").cast("double"), tick_time(df).alias("ts"),
        F.lit(source).alias("source"),
        F.when(tick_time(df).isNull(), "TICK_TIME_MISSING").alias("error"),
    )


def vendor_accounts(df: DataFrame, now: str | Column) -> DataFrame:
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    keep = ["account_id"] if "account_id" in df.columns else []
    return df.select(
        *keep, F.col("balance").cast("double"), F.col("equity").cast("double"),
        _first(df, ("margin_free", "free_margin"), 0.0).alias("free_margin"), moment.alias("ts"),
        F.coalesce(_raw(df, "currency", "string"), F.lit("USD")).alias("currency"),
    )


def vendor_specs(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol",
        _first(df, ("trade_tick_size", "point"), 0.0).alias("tick_size"),
        _first(df, ("trade_tick_value",), 0.0).alias("tick_value"),
        _first(df, ("volume_min",), 0.0).alias("volume_min"),
        _first(df, ("volume_max",), 0.0).alias("volume_max"),
        _first(df, ("volume_step",), 0.0).alias("volume_step"),
        (F.coalesce(_raw(df, "trade_mode", "int"), F.lit(1)) != 0).alias("trade_enabled"),
    )


def vendor_bars(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol", F.timestamp_seconds(F.col("time")).alias("ts"),
        *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close")],
        _first(df, ("tick_volume", "real_volume"), 0.0).alias("volume"),
    )
