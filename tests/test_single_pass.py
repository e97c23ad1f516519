"""Documents and journal lines are read, parsed and hashed once; deliveries of a stream are several files."""

from pyspark.sql import functions as F

from marketloom.operators.journal import audit_journal
from marketloom.sources import snapshots as SN

GOOD = '{"account":{"balance":1.0},"symbols":{"A":{"quote":{"bid":1.0,"ask":2.0,"timestamp":"2024-01-01T00:00:00Z"}},"B":null}}'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snapshot_readers_parse_a_document_once(spark):
    texts = spark.createDataFrame([(1, GOOD), (2, "{"), (3, '{"symbols":{}}'), (4, '{"account":{"balance":1.0}}')], "snapshot_id int, value string")
    parsed = SN.parse_snapshots(texts)
    for out in (SN.snapshot_quotes(parsed), SN.snapshot_specs(parsed), SN.snapshot_bars(parsed), SN.snapshot_errors(parsed)):
        assert plan(out).count("from_json") == 1
    assert [tuple(x) for x in SN.snapshot_quotes(parsed).select("snapshot_id", "symbol").collect()] == [(1, "A")]
    missing = [(1, s, f"SNAPSHOT_{x}_MISSING") for s, parts in (("A", ("BARS", "SPEC")), ("B", ("BARS", "QUOTE", "SPEC"))) for x in parts]
    wanted = [*missing, (2, None, "SNAPSHOT_FILE_INVALID"), (3, None, "SNAPSHOT_ACCOUNT_MISSING")]
    assert sorted(map(tuple, SN.snapshot_errors(parsed).collect()), key=str) == sorted(wanted, key=str)


def test_journal_audit_reads_lines_once(spark):
    lines = spark.createDataFrame([("j", "x"), ("j", "y"), ("j", '{"sequence":2}')], "journal_id string, value string")
    out = audit_journal(lines)
    assert "Join" not in plan(out) and plan(out).count("LogicalRDD") == 1
    assert [x.failure for x in out.collect()] == ["SEQUENCE"] * 3


def test_a_delivery_is_several_files(spark, tmp_path):
    from workloads.live import stream

    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    rows = stream(spark, str(tmp_path), "t", parts=2)
    seen = []

    def note(batch, number):
        seen.append((batch.count(), len(batch.select(F.input_file_name()).distinct().collect())))

    rows.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in seen) == 1000 and len(seen) == 2
    assert all(k > 1 for _, k in seen)
