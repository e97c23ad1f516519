"""Stream sources and event-time aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import LiveLimits, live_quote_rules


def stream_snapshots(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Snapshot documents as they arrive; the parsers of ``sources.snapshots`` take the result as is."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("snapshot_id"), "value")


def closed_bars(
    ticks: DataFrame, width: str = "5 minutes", delay: str = "1 minute", price: str = "price", volume: str | None = None,
    order: str = "ts",
) -> DataFrame:
    """OHLCV bars of ticks ``(symbol, ts, price)``. In append mode a bar appears once the watermark has
    passed its end, so a forming bar is never seen. Works on batch tables too (then every bar is final)."""
    amount = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "symbol")
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), amount.alias("volume"),
        )
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def fresh_quotes(quotes: DataFrame, now: str | Column, limits: LiveLimits = LiveLimits()) -> DataFrame:
    """Late or wide quotes are rejected with reasons, never repaired."""
    moment = F.col(now) if isinstance(now, str) else now
    return quotes.withColumn("reasons", live_quote_rules(moment, limits)).withColumn("ok", F.size("reasons") == 0)


def daily_pnl(events: DataFrame, keys: tuple[str, ...] = ("account_id",), delay: str = "1 hour") -> DataFrame:
    """Realised P&L per UTC day and key from CLOSE events."""
    return (
        events.where(F.col("event_type") == "CLOSE")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), *keys)
        .agg(F.sum("pnl_usd").alias("realized_pnl_usd"))
        .select(*keys, F.to_date("w.start").alias("day"), "realized_pnl_usd")
    )
