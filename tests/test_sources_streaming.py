import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import START, bars_frame, walk
from marketloom.functions.text import parse_zoned_time
from marketloom.operators.fingerprint import DatasetMetadata
from marketloom.sources import bars as SB
from marketloom.sources import journals as SJ
from marketloom.sources import snapshots as SN
from marketloom.sources import vendor as SV
from marketloom.streaming import feeds as FD
from marketloom.streaming.sinks import drain, journal_stream


def snapshot(equity=100.0):
    bars = [{"timestamp": f"2024-01-01T0{i}:00:00+00:00", "open": 1 + i, "high": 2 + i, "low": 1.0, "close": 1.5 + i} for i in range(5)]
    return {"account": {"balance": equity, "equity": equity, "free_margin": 50, "timestamp": "2024-01-01T05:00:00Z"},
            "symbols": {"X": {"quote": {"bid": 1.0, "ask": 1.1, "timestamp": "2024-01-01T05:00:00.250Z"},
                              "spec": {"tick_size": 0.01, "volume_min": 0.1, "volume_max": 10, "volume_step": 0.1}, "bars": bars},
                        "Y": {"quote": {"bid": 2.0, "ask": 2.1, "timestamp": "2024-01-01T05:00:00"}}}}


@pytest.fixture()
def snapshot_dir(tmp_path):
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(snapshot(), indent=2))
    (folder / "b.json").write_text('{"account": {"balance": 1')
    (folder / "c.json").write_text(json.dumps({"symbols": {}}))
    return str(folder)


def by_name(df):
    return {os.path.basename(r.snapshot_id): r for r in df.collect()}


def test_snapshot_documents(spark, snapshot_dir):
    parsed = SN.parse_snapshots(SN.read_snapshots(spark, snapshot_dir)).cache()
    account = by_name(SN.snapshot_accounts(parsed))["a.json"]
    assert (account.equity, account.currency, account.ts) == (100.0, "USD", datetime(2024, 1, 1, 5))
    quotes = {r.symbol: r for r in SN.snapshot_quotes(parsed).collect()}
    assert quotes["X"].ts == datetime(2024, 1, 1, 5, 0, 0, 250_000) and quotes["Y"].ts is None
    spec = SN.snapshot_specs(parsed).first()
    assert (spec.symbol, spec.tick_value, spec.trade_enabled) == ("X", 0.0, True)
    bars = SN.snapshot_bars(parsed, 2).orderBy("ts").collect()
    assert [(r.open, r.volume) for r in bars] == [(4.0, 0.0), (5.0, 0.0)]
    errors = {(os.path.basename(r.snapshot_id), r.symbol, r.error) for r in SN.snapshot_errors(parsed).collect()}
    assert errors == {("b.json", None, "SNAPSHOT_FILE_INVALID"), ("c.json", None, "SNAPSHOT_ACCOUNT_MISSING"),
                      ("a.json", "Y", "SNAPSHOT_SPEC_MISSING"), ("a.json", "Y", "SNAPSHOT_BARS_MISSING")}


def test_streamed_snapshots_parse_the_same(spark, snapshot_dir):
    rows = drain(SN.snapshot_quotes(SN.parse_snapshots(FD.stream_snapshots(spark, snapshot_dir, 1))))
    want = SN.snapshot_quotes(SN.parse_snapshots(SN.read_snapshots(spark, snapshot_dir)))
    assert rows.exceptAll(want).count() == 0 and rows.count() == want.count() == 2


def test_times_need_a_zone(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "nonsense+00:00"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_zoned_time("t").alias("x")).collect()
    assert [r.x for r in out] == [datetime(2024, 1, 1), datetime(2024, 1, 1), None, None]


def test_vendor_fallbacks(spark):
    ticks = spark.createDataFrame([("X", 1.0, 1.1, 1704067200250, 5), ("Y", 1.0, 1.1, 0, 1704067200), ("Z", 1.0, 1.1, None, 0)],
                                  "symbol string, bid double, ask double, time_msc bigint, time bigint")
    out = {r.symbol: (r.ts, r.error) for r in SV.vendor_quotes(ticks).collect()}
    assert out == {"X": (datetime(2024, 1, 1, 0, 0, 0, 250_000), None), "Y": (datetime(2024, 1, 1), None), "Z": (None, "TICK_TIME_MISSING")}
    spec = SV.vendor_specs(spark.createDataFrame([("X", 0.5, 0)], "symbol string, point double, trade_mode int")).first()
    assert (spec.tick_size, spec.trade_enabled, spec.volume_min) == (0.5, False, 0.0)
    account = SV.vendor_accounts(spark.createDataFrame([(1.0, 2.0, 3.0)], "balance double, equity double, free_margin double"), "2024-01-01 00:00:00").first()
    assert (account.free_margin, account.currency) == (3.0, "USD")
    bar = SV.vendor_bars(spark.createDataFrame([("X", 1704067200, 1.0, 2.0, 0.5, 1.5, 9)], "symbol string, time bigint, open double, high double, low double, close double, real_volume bigint")).first()
    assert (bar.ts, bar.volume) == (datetime(2024, 1, 1), 9.0)


def test_bar_table_prunes_dates_and_is_inclusive(spark, tmp_path):
    path = str(tmp_path / "bars")
    SB.write_bars(bars_frame(spark, {"A": walk(72, 1), "B": walk(72, 2), "C": walk(5, 3)}), path, files_per_date=2)
    provider = SB.BarProvider(DatasetMetadata("d", "s"), lambda: SB.read_bars(spark, path))
    out = provider.load_bars(["A", "C"], "2024-01-01 03:00:00", "2024-01-02 00:00:00")
    assert out.groupBy("symbol").count().orderBy("symbol").collect() == [("A", 22), ("C", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters" in plan and "In(symbol" in plan.replace("IsNotNull(symbol), ", "")


def test_portfolio_states(spark):
    pos = {"decision_id": "d", "symbol": "X", "side": "long", "notional_usd": 1.0, "estimated_risk_usd": 0.1, "quantity": 1.0,
           "entry_price": 1.0, "stop_loss": 0.9, "take_profit": 1.2, "opened_at": "2024-01-01T00:00:00+00:00"}
    good = {"schema_version": 1, "base_equity_usd": 10.0, "equity_peak_usd": 11.0, "updated_at": "2024-01-01T00:00:00+00:00", "positions": [pos]}
    docs = [("a", good), ("b", {**good, "schema_version": 2}), ("c", {**good, "positions": [pos, pos]}), ("d", {**good, "base_equity_usd": -1.0})]
    texts = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs] + [("e", "{oops")], "id string, value string")
    states = SJ.parse_portfolio_states(texts)
    assert {r.id: r.error for r in states.collect()} == {
        "a": None, "b": "SHADOW_STATE_UNSUPPORTED_VERSION", "c": "SHADOW_STATE_INVALID", "d": "SHADOW_STATE_INVALID", "e": "SHADOW_STATE_INVALID"}
    row = SJ.state_positions(states).first()
    assert (row.id, row.decision_id, row.opened_at) == ("a", "d", datetime(2024, 1, 1))


def journalled(spark, path):
    rows = SJ.read_decisions(spark, path).collect()
    return sorted(((r.decision_id, r.ordinal) for r in rows), key=lambda x: (x[0] is not None, x))


def test_decisions_append_once(spark, tmp_path):
    path = str(tmp_path / "journal")
    cols = "decision_id string, ordinal int, ts timestamp"
    SJ.append_decisions(spark.createDataFrame([("a", 1, START), ("a", 2, START), ("b", 3, START), (None, 4, START)], cols), path)
    SJ.append_decisions(spark.createDataFrame([("b", 1, START), ("c", 2, START + timedelta(days=1)), (None, 5, START), ("d", 6, None)], cols), path)
    SJ.append_decisions(spark.createDataFrame([], cols), path)
    assert journalled(spark, path) == [(None, 4), ("a", 1), ("b", 3), ("c", 2), ("d", 6)]
    none = SJ.read_decisions(spark, str(tmp_path / "none"), SJ.read_decisions(spark, path).schema)
    assert none.count() == 0 and none.columns == ["decision_id", "ordinal", "ts", "dt"]


def test_late_new_decisions_are_kept(spark, tmp_path, monkeypatch):
    """A new id is journalled however old its time; an attempt that broke off at any step shows nothing and its replay is whole."""
    path, cols = str(tmp_path / "journal"), "decision_id string, ordinal int, ts timestamp"
    late = [("a", 1, START + timedelta(hours=12)), ("b", 2, START + timedelta(hours=12)), ("c", 3, START + timedelta(hours=9) - timedelta(days=900))]
    for row in late[:2]:
        SJ.append_decisions(spark.createDataFrame([row], cols), path)
    batch = spark.createDataFrame(late + [("e", 4, START)], cols)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(SJ, "_mark", killed)  # rows and ids are written, the commit is not
        with pytest.raises(RuntimeError, match="killed"):
            SJ.append_decisions(batch, path, commit="7")
    assert journalled(spark, path) == [("a", 1), ("b", 2)]
    SJ.append_decisions(spark.createDataFrame([("e", 9, START)], cols), path, commit="8")  # the id is still free
    for _ in range(2):
        SJ.append_decisions(batch, path, commit="7")
    assert journalled(spark, path) == [("a", 1), ("b", 2), ("c", 3), ("e", 9)]


def test_a_known_id_is_found_without_reading_the_journal(spark, tmp_path):
    import shutil

    path, cols = str(tmp_path / "journal"), "decision_id string, ordinal int, ts timestamp"
    SJ.append_decisions(spark.createDataFrame([("a", 1, START)], cols), path)
    shutil.copytree(path + "/rows", str(tmp_path / "kept"))
    for file in (tmp_path / "journal" / "rows").rglob("*.parquet"):
        file.write_bytes(b"unreadable")
    SJ.append_decisions(spark.createDataFrame([("a", 2, START + timedelta(days=50)), ("b", 3, START + timedelta(days=50))], cols), path)
    shutil.copytree(str(tmp_path / "kept"), path + "/rows", dirs_exist_ok=True)
    assert journalled(spark, path) == [("a", 1), ("b", 3)]


def test_unread_dates_are_pruned_while_the_query_runs(spark, tmp_path):
    path = str(tmp_path / "bars")
    SB.write_bars(bars_frame(spark, {"A": walk(96, 1), "B": walk(96, 2)}), path)
    days = [(START + timedelta(days=i)).date() for i in range(4)]
    calendar = str(tmp_path / "calendar")
    spark.createDataFrame(list(zip(days, [5, 50, 7, 60])) + [(None, 99)], "dt date, trades int").write.parquet(calendar)
    for day in (days[0], days[2]):  # folders that must not be opened
        for file in (tmp_path / "bars" / f"dt={day}").glob("*.parquet"):
            file.write_bytes(b"unreadable")
    out = SB.bars_on_dates(SB.read_bars(spark, path), spark.read.parquet(calendar).where("trades > 10"))
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.dt, r["count"]) for r in out.groupBy("dt").count().collect()} == {(days[1], 48), (days[3], 48)}


def test_decision_stream_is_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "journal")
    cols = "decision_id string, ordinal int, ts timestamp"
    spark.createDataFrame([("a", 1, START), ("b", 2, START)], cols).coalesce(1).write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint replays the input
        rows = spark.readStream.schema(cols).parquet(source)
        journal_stream(rows, path, str(tmp_path / checkpoint)).awaitTermination()
    assert [x for x, _ in journalled(spark, path)] == ["a", "b"]
    assert not any("b-None" in p.name for p in (tmp_path / "journal" / "commits").iterdir())
    named = [p.name for p in (tmp_path / "journal" / "commits").iterdir() if not p.name.startswith(".")]
    assert len(named) == 2 and all(x.endswith("-0") for x in named)  # named by query and micro-batch


def test_only_closed_bars_leave_the_stream(spark, tmp_path):
    cols = "symbol string, ts timestamp, price double"
    ticks = [("X", START + timedelta(minutes=m), float(p)) for m, p in ((0, 5), (1, 9), (4, 3), (4.5, 4), (6, 7), (13, 8))]
    spark.createDataFrame(ticks, cols).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    out = drain(FD.closed_bars(spark.readStream.schema(cols).parquet(str(tmp_path / "ticks")))).orderBy("ts").collect()
    assert [(r.ts.minute, r.open, r.high, r.low, r.close, r.volume) for r in out] == [(0, 5, 9, 3, 4, 4), (5, 7, 7, 7, 7, 1)]
    batch = FD.closed_bars(spark.createDataFrame(ticks, cols))
    assert batch.count() == 3
