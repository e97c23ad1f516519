"""Snapshot documents: one JSON text per row becomes account, quote, specification and bar rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_zoned_time
from ..schemas import SNAPSHOT_DDL

SOURCE_NAME = "mt5_snapshot"  # fixed value carried by quotes of this source


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as rows ``(snapshot_id, value)``; the id is the file path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("snapshot_id"), "value")


def parse_snapshots(texts: DataFrame, value: str = "value") -> DataFrame:
    """Parse once; every reader below works on this. ``error`` names what is wrong with a document."""
    parsed = texts.withColumn(
        "_d", F.from_json(value, SNAPSHOT_DDL + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    broken = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull()
    keep = [x for x in texts.columns if x != value]
    return parsed.select(
        *keep,
        F.when(broken, "SNAPSHOT_FILE_INVALID").when(F.col("_d.account").isNull(), "SNAPSHOT_ACCOUNT_MISSING").alias("error"),
        F.when(~broken, F.col("_d.account")).alias("account"),
        F.when(~broken, F.col("_d.symbols")).alias("symbols"),
    )


def snapshot_errors(parsed: DataFrame) -> DataFrame:
    """One row per problem: bad documents, and symbols that lack a quote, specification or bars."""
    parts = {"quote": "SNAPSHOT_QUOTE_MISSING", "spec": "SNAPSHOT_SPEC_MISSING", "bars": "SNAPSHOT_BARS_MISSING"}

    def problem(symbol: Column, code: Column) -> Column:
        return F.struct(symbol.cast("string").alias("symbol"), code.cast("string").alias("error"))

    def missing(entry: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(entry["value"][part].isNull(), problem(entry["key"], F.lit(code))) for part, code in parts.items()]))

    # One array per document, so that documents are read and parsed once.
    document = F.array_compact(F.array(F.when(F.col("error").isNotNull(), problem(F.lit(None), F.col("error")))))
    symbols = F.flatten(F.transform(F.map_entries("symbols"), missing))
    problems = F.concat(document, F.coalesce(symbols, F.slice(document, 1, 0)))
    return parsed.select(*_ids(parsed), F.explode_outer(problems).alias("_p")).where("_p IS NOT NULL").select(*_ids(parsed), "_p.symbol", "_p.error")


def _ids(parsed: DataFrame) -> list[str]:
    return [x for x in parsed.columns if x not in ("error", "account", "symbols")]


def snapshot_accounts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("account").isNotNull()).select(
        *_ids(parsed), "account.balance", "account.equity", "account.free_margin",
        parse_zoned_time("account.timestamp").alias("ts"), F.coalesce("account.currency", F.lit("USD")).alias("currency"),
    )


def _symbols(parsed: DataFrame) -> DataFrame:
    # Spark filters the input of an inner explode by its size, which parses every document again for each use in that filter.
    return parsed.select(*_ids(parsed), F.explode_outer("symbols").alias("symbol", "value")).where("symbol IS NOT NULL")


def snapshot_quotes(parsed: DataFrame, source: str = SOURCE_NAME) -> DataFrame:
    return _symbols(parsed).where(F.col("value.quote").isNotNull()).select(
        *_ids(parsed), "symbol", "value.quote.bid", "value.quote.ask",
        parse_zoned_time("value.quote.timestamp").alias("ts"), F.lit(source).alias("source"),
    )


def snapshot_specs(parsed: DataFrame) -> DataFrame:
    spec = "value.spec"
    return _symbols(parsed).where(F.col(spec).isNotNull()).select(
        *_ids(parsed), "symbol", f"{spec}.tick_size", F.coalesce(f"{spec}.tick_value", F.lit(0.0)).alias("tick_value"),
        f"{spec}.volume_min", f"{spec}.volume_max", f"{spec}.volume_step",
        F.coalesce(f"{spec}.trade_enabled", F.lit(True)).alias("trade_enabled"),
    )


def snapshot_bars(parsed: DataFrame, count: int = 250) -> DataFrame:
    """The last ``count`` bars of each symbol in stored order."""
    if count <= 0:
        raise ValueError("count must be positive")
    kept = F.slice("value.bars", F.greatest(F.size("value.bars") - count, F.lit(0)) + 1, count)
    rows = _symbols(parsed).where(F.col("value.bars").isNotNull()).select(*_ids(parsed), "symbol", F.explode(kept).alias("b"))
    return rows.select(
        *_ids(parsed), "symbol", parse_zoned_time("b.timestamp").alias("ts"), "b.open", "b.high", "b.low", "b.close",
        F.coalesce("b.volume", F.lit(0.0)).alias("volume"),
    )
