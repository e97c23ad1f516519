"""Journal and portfolio-state documents, and the sinks that extend them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import parse_zoned_time
from ..operators.admission import flag_duplicates
from ..operators.fingerprint import DatasetMetadata
from ..operators.quality import portfolio_state_rules
from ..operators.series import join_keys
from ..session import interim
from ..schemas import DECISION_EVENT_DDL, LIFECYCLE_EVENT_DDL, PORTFOLIO_STATE_DDL, journal_ddl

STATE_VERSION = 1


def read_journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``(journal_id, value)``; one file is one journal. The audit works on these."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("journal_id"), "value")


def _events(lines: DataFrame, ddl: str, value: str) -> DataFrame:
    keep = [x for x in lines.columns if x != value]
    parsed = lines.where(F.trim(F.col(value)) != "").select(*keep, F.from_json(value, journal_ddl(ddl)).alias("_j"))
    return parsed.select(*keep, "_j.sequence", "_j.previous_hash", "_j.entry_hash", "_j.event.*").withColumn(
        "ts", parse_zoned_time("timestamp")
    ).drop("timestamp")


def decision_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decision-journal entries; free-form metadata stays JSON text."""
    return _events(lines, DECISION_EVENT_DDL, value).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def lifecycle_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """OPEN and CLOSE entries of the lifecycle journal."""
    return _events(lines, LIFECYCLE_EVENT_DDL, value).withColumn("pnl_usd", F.coalesce("pnl_usd", F.lit(0.0)))


def parse_portfolio_states(texts: DataFrame, value: str = "value") -> DataFrame:
    """State documents with ``error`` (invalid text, unsupported version, broken rules) instead of a failed job."""
    keep = [x for x in texts.columns if x != value]
    rows = texts.select(*keep, F.from_json(value, PORTFOLIO_STATE_DDL).alias("_s")).select(
        *keep, F.col("_s").isNull().alias("_bad"), "_s.*"
    )
    rows = rows.withColumn("updated_at", parse_zoned_time("updated_at")).withColumns({
        "realized_pnl_usd": F.coalesce("realized_pnl_usd", F.lit(0.0)),
        "positions": F.coalesce("positions", F.expr("array()").cast(rows.schema["positions"].dataType)),
    })
    error = (
        F.when(F.col("_bad") | F.col("schema_version").isNull() & F.col("base_equity_usd").isNull(), "SHADOW_STATE_INVALID")
        .when(F.coalesce("schema_version", F.lit(0)) != STATE_VERSION, "SHADOW_STATE_UNSUPPORTED_VERSION")
        .when(F.size(portfolio_state_rules()) > 0, "SHADOW_STATE_INVALID")
    )
    return rows.withColumn("error", error).drop("_bad")


def state_positions(states: DataFrame) -> DataFrame:
    """Open positions of valid states."""
    keep = [x for x in states.columns if x not in (
        "schema_version", "base_equity_usd", "realized_pnl_usd", "equity_peak_usd", "updated_at", "positions", "error")]
    return states.where(F.col("error").isNull()).select(*keep, F.explode("positions").alias("p")).select(
        *keep, "p.*").withColumn("opened_at", parse_zoned_time("opened_at"))


# --- sinks -----------------------------------------------------------------------------------------


#: Folders of a journal's table of ids, dealt by hash of the id.
ID_BUCKETS = 64


def append_decisions(
    batch: DataFrame, path: str, order: Sequence[str] = ("ordinal",), ts: str = "ts", commit: str | None = None
) -> None:
    """Append rows whose decision id the journal does not hold yet, however late they come.

    ``path`` holds ``rows`` and ``ids``, each with a folder per commit, and a marker per commit in ``commits``.
    Rows and ids of a commit become visible together when its marker appears, which is the last step; what a broken
    attempt left behind is never read, and a replay under the same ``commit`` name overwrites it. A commit that has its
    marker is not made again. Of the table of ids only the folders of the batch's hashes are read, of the rows none. A
    null id is an id like any other. One writer at a time; without a name a commit gets a new one.
    """
    spark = batch.sparkSession
    key, top = "decision_id", path.rstrip("/")
    name = f"b-{commit or uuid.uuid4().hex}"
    if _exists(spark, f"{top}/commits/{name}"):
        return
    keyed = interim(batch.withColumns({"dt": F.to_date(ts), "_bucket": F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")}))
    fresh = keyed
    if _exists(spark, f"{top}/commits"):
        buckets = [r[0] for r in keyed.select("_bucket").distinct().collect()]  # ID_BUCKETS at most
        ids = f"{key} {keyed.schema[key].dataType.simpleString()}, commit string, _bucket int"
        known = _committed(spark, top, spark.read.schema(ids).parquet(f"{top}/ids")).where(F.col("_bucket").isin(buckets))
        fresh = join_keys(keyed, known.select("_bucket", key), ["_bucket", key], "left_anti")
    fresh = interim(fresh)
    new = interim(flag_duplicates(fresh, order=order).where(~F.col("duplicate")).drop("duplicate").dropDuplicates([key]))
    new.drop("_bucket").hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{top}/rows/commit={name}")
    new.select(key, "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{top}/ids/commit={name}")
    _mark(spark, f"{top}/commits/{name}")


def read_decisions(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Rows of the committed batches of a journal that :func:`append_decisions` wrote, with their date ``dt``.

    A ``schema`` of the rows (with ``dt``) is needed only where no batch has had a row yet.
    """
    top = path.rstrip("/")
    if schema is not None and not _exists(spark, f"{top}/commits"):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("commit", StringType())]))
    return _committed(spark, top, reader.parquet(f"{top}/rows")).drop("commit")


def _committed(spark: SparkSession, top: str, rows: DataFrame) -> DataFrame:
    """Rows of commits that have their marker; markers are listed by Spark, one small row each."""
    names = spark.read.text(f"{top}/commits").select(F.col("value").alias("commit")).distinct()
    return rows.join(names, "commit", "left_semi")


def _mark(spark: SparkSession, path: str) -> None:
    """A file that holds its own name; it appears whole, by renaming."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    folder, name = path.rsplit("/", 1)
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}")
    files = target.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    if not files.rename(draft, target):
        raise OSError(f"cannot rename {draft} to {target}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - the Hadoop file system has no Python face
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)  # noqa: SLF001


def run_summary(summary: DataFrame, digits: int = 6) -> DataFrame:
    """Report rows: numbers rounded, plus the row as JSON text."""
    doubles = [f.name for f in summary.schema.fields if f.dataType.simpleString() == "double"]
    rounded = summary.withColumns({x: F.round(x, digits) for x in doubles})
    return rounded.withColumn("report", F.to_json(F.struct(*rounded.columns)))


def experiment_artifacts(
    leaderboard: DataFrame,
    metadata: DatasetMetadata,
    fingerprint: str,
    features: Sequence[str],
    label: str,
    params: dict[str, dict],
    seed: int,
    metrics: Sequence[str],
) -> DataFrame:
    """One artifact row per model: what was trained on what, and how it did."""
    chosen = F.lit(None).cast("map<string,string>")
    for name, values in params.items():
        entries = [F.lit(x) for pair in sorted(values.items()) for x in (str(pair[0]), str(pair[1]))]
        table = F.create_map(*entries) if entries else F.expr("map()").cast("map<string,string>")
        chosen = F.when(F.col("model") == name, table).otherwise(chosen)
    numbers = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    return leaderboard.select(
        F.lit(metadata.name).alias("dataset"), F.lit(metadata.grade).alias("grade"),
        F.lit(fingerprint).alias("dataset_fingerprint"), F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.lit(label).alias("label_name"), F.col("model").alias("model_name"), chosen.alias("model_params"),
        F.lit(seed).alias("seed"), "fold_count", "oos_coverage", numbers.alias("metrics"),
    )
