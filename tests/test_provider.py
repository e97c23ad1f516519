import json
import os
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

from helpers import bar_rows, bars_frame, walk
from marketloom.sources import bars as SB
from marketloom.sources import provider as PV
from marketloom.sources import snapshots as SN
from test_sources_streaming import snapshot


def test_bars_through_a_provider_equal_the_table(spark, tmp_path):
    bars = bars_frame(spark, {s: walk(200, i) for i, s in enumerate("ABC")})
    path = str(tmp_path / "bars")
    bars.repartitionByRange(3, "symbol").write.parquet(path)
    got = PV.provider_bars(spark, path)
    assert got.schema.simpleString() == bars.schema.simpleString()
    assert got.exceptAll(bars).isEmpty() and got.count() == 600
    picked = SB.select_bars(got, ["B", "C"], "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    assert sorted(picked.collect()) == sorted(SB.select_bars(bars, ["B", "C"], "2024-01-02 00:00:00", "2024-01-03 00:00:00").collect())
    one = PV.provider_bars(spark, "file:" + path, partitionBytes="1")
    assert one.count() == 600 and one.rdd.getNumPartitions() == 3
    assert PV.provider_bars(spark, str(tmp_path / "nothing")).count() == 0


def test_row_groups_that_cannot_match_are_not_read(tmp_path):
    rows = [r for s in "ABC" for r in bar_rows(s, walk(100, 1))]
    names = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    path = str(tmp_path / "x.parquet")
    pq.write_table(table, path, row_group_size=50)
    meta, size = pq.read_metadata(path), os.path.getsize(path)
    all_of = PV.Unit(path, 0, 0, size)
    day = datetime(2024, 1, 3, tzinfo=timezone.utc)

    def groups(*filters, unit=all_of):
        return PV.row_groups(meta, unit, PV.conditions(filters))

    assert groups() == [0, 1, 2, 3, 4, 5]
    assert groups(EqualTo(("symbol",), "B")) == [2, 3] and groups(In(("symbol",), ("A", "C", None))) == [0, 1, 4, 5]
    assert groups(GreaterThan(("ts",), day + timedelta(hours=2))) == [1, 3, 5]
    assert groups(LessThanOrEqual(("ts",), datetime(2024, 1, 1))) == [0, 2, 4]  # no zone counts as UTC
    # what is not understood prunes nothing; neither do unlike types or unknown columns
    assert groups(Not(EqualTo(("symbol",), "B")), EqualTo(("symbol",), 3), EqualTo(("other",), 3)) == [0, 1, 2, 3, 4, 5]
    # every group belongs to one split, wherever files are cut
    for cut in (1000, 3000, size):
        parts = [PV.Unit(path, 0, at, min(cut, size - at)) for at in range(0, size, cut)]
        assert sorted(g for u in parts for g in groups(unit=u)) == [0, 1, 2, 3, 4, 5]


def test_filters_reach_the_provider(spark, tmp_path):
    class Asked(PV.Provider):
        schema = "symbol string, n int"

        def units(self):
            return [PV.Unit("all", 0, 0, 1)]

        def read(self, unit, wanted):
            said = ";".join(sorted(f"{w.column}{w.values or ''}{w.low or ''}" for w in wanted))
            yield pa.RecordBatch.from_pydict({"symbol": ["A", said], "n": [5, 5]})

    PV.register_provider(spark, "asked", Asked)
    df = spark.read.format("asked").load()
    assert [r.symbol for r in df.where("n > 3").collect()] == ["A", "n3"]
    assert [r.symbol for r in df.where("symbol = 'A'").collect()] == ["A"]  # Spark checks the rows again


def test_packs_are_bounded_and_whole():
    units = [PV.Unit(f"u{i}", i // 2, 0, size) for i, size in enumerate((5, 5, 30, 1, 9, 1))]
    got = PV.packs(reversed(units), 10)
    assert [[u.name for u in p.units] for p in got] == [["u0", "u1"], ["u2"], ["u3", "u4"], ["u5"]]
    assert PV.packs([], 10) == []


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "snapshots"
    path.mkdir()
    (path / "a.json").write_text(json.dumps(snapshot(), indent=2))
    (path / "_b.json").write_text("not seen")
    return path


def test_documents_through_a_provider_parse_the_same(spark, folder):
    (folder / "b.json").write_text('{"account": {"balance": 1')
    docs = PV.provider_snapshots(spark, str(folder))
    name = F.element_at(F.split("snapshot_id", "/"), -1).alias("snapshot_id")
    want = SN.parse_snapshots(SN.read_snapshots(spark, str(folder)))
    for part in (SN.snapshot_quotes, SN.snapshot_accounts, SN.snapshot_errors, SN.snapshot_bars):
        got = part(SN.parse_snapshots(docs)).withColumn("snapshot_id", name)
        assert sorted(map(str, got.collect())) == sorted(map(str, part(want).withColumn("snapshot_id", name).collect()))
    assert docs.where(F.col("snapshot_id") == str(folder / "a.json")).count() == 1


def test_a_restarted_stream_goes_on_after_its_last_document(spark, folder, tmp_path):
    spark.createDataFrame([("r1", json.dumps(snapshot())), ("r2", None)], "snapshot_id string, value string").coalesce(1).write.parquet(str(folder / "rows"))

    def run():
        docs = PV.provider_snapshots(spark, str(folder), stream=True, partitionBytes="1")
        query = (docs.select(F.element_at(F.split("snapshot_id", "/"), -1).alias("id")).writeStream.trigger(availableNow=True)
                 .option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out")))
        query.awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.json", "r1", "r2"]
    assert run() == ["a.json", "r1", "r2"]  # nothing new, nothing twice
    (folder / "c.json").write_text("{}")
    assert run() == ["a.json", "c.json", "r1", "r2"]


def test_delivered_documents_are_stored_once(spark):
    """Each delivery makes its own documents; they are not stored beside what is delivered."""
    from marketloom.session import shared_dir
    from workloads.live import stream_provider_quotes

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for f in names if f.endswith(".parquet")}

    sf = "/root/testdata/sf0.01"
    before = files()
    quotes = stream_provider_quotes(spark, sf).count()
    made = [pq.ParquetFile(f) for f in files() - before]
    documents = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert quotes > 0 and sum(f.metadata.num_rows for f in made if "value" in f.schema_arrow.names) == documents
