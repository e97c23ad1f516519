"""Market tables derived by Spark from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.session import use_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def _index_bars(cents: DataFrame, scale: float, width: float) -> DataFrame:
    """Bars from integer cent sums: a price index that moves with each bar's mean value.

    The input has one row per symbol and calendar unit, so the running sum is bounded by the calendar.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    step = (F.col("cents") - scale * F.col("volume")) / (width * F.col("volume"))
    close = 100 * F.exp(F.sum(step).over(run))
    return (
        cents.withColumn("close", close)
        .withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
        .select(
            "symbol", "ts", "open",
            (F.greatest("open", "close") * 1.001).alias("high"),
            (F.least("open", "close") * 0.999).alias("low"),
            "close", F.col("volume").cast("double").alias("volume"),
        )
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars per event type."""
    cents = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("volume"))
    )
    return _index_bars(cents, 5000.0, 200000.0)


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per market segment, over six years of orders."""
    cents = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("volume"))
    )
    return _index_bars(cents, 25_000_000.0, 1_000_000_000.0)


def benchmark_bars(bars_df: DataFrame) -> DataFrame:
    return bars_df.groupBy("ts").agg(F.round(F.avg("close"), 6).alias("close"))
