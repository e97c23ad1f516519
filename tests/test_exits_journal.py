import hashlib
import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.pricing import long_geometry
from marketloom.operators import exits as EX
from marketloom.operators import journal as JO
from marketloom.operators.fingerprint import DatasetMetadata, dataset_fingerprint
from marketloom.operators.asof import as_of_join
from marketloom.operators.series import SeriesLayout
from marketloom.sources import journals as SJ
from marketloom.streaming.exits import LATE, exit_stream, settle_late
from marketloom.streaming.sinks import drain

START = datetime(2024, 1, 30, 20, 0)
POS = "decision_id string, symbol string, stop_loss double, take_profit double, opened_at timestamp, quantity double, entry_price double"
QUOTE = "symbol string, ts timestamp, seq bigint, bid double"


def market(seed=5, n=400, symbols=("HOT", "B", "C")):
    rng, quotes, positions = random.Random(seed), [], []
    for s in symbols:
        price, t = 100.0, START
        for i in range(n if s == "HOT" else n // 8):
            t += timedelta(minutes=rng.choice([0, 1, 7, 90, 60 * 24 * 9] if s == "C" else [0, 1, 7, 90]))
            price *= 1 + rng.gauss(0, 0.004)
            quotes.append((s, t, i, price))
            if rng.random() < 0.3:
                width = rng.choice([0.002, 0.01, 0.05])
                positions.append((f"{s}{i}", s, price * (1 - width), price * (1 + 2 * width), t + timedelta(seconds=rng.choice([0, 30])), 2.0, price))
    return positions, quotes


def brute(positions, quotes):
    out = {}
    for d, s, sl, tp, at, qty, entry in positions:
        hits = sorted((t, seq, bid) for qs, t, seq, bid in quotes if qs == s and t >= at and (bid <= sl or bid >= tp))
        if hits:
            t, _, bid = hits[0]
            out[d] = ("STOP_LOSS" if bid <= sl else "TAKE_PROFIT", bid, t, pytest.approx(qty * (bid - entry)))
    return out


def as_dict(df):
    return {r.decision_id: (r.exit_reason, r.exit_price, r.closed_at, r.realized_pnl_usd) for r in df.collect()}


def test_first_exits_equal_brute_force(spark):
    positions, quotes = market()
    got = EX.first_exits(spark.createDataFrame(positions, POS).repartition(3), spark.createDataFrame(quotes, QUOTE).repartition(5), "seq")
    want = brute(positions, quotes)
    assert as_dict(got) == want and 0 < len(want) < len(positions)


def test_exits_of_one_level_take_one_join(spark, monkeypatch):
    """Positions are shuffled once: opening and touch are found together, and exits are not joined to positions again."""
    stored = []
    monkeypatch.setattr(EX, "interim", lambda df, real=EX.interim: stored.append(df.columns) or real(df))
    positions, quotes = market()
    out = EX.first_exits(spark.createDataFrame(positions, POS), spark.createDataFrame(quotes, QUOTE), "seq", fan=4096)
    assert as_dict(out) == brute(positions, quotes) and not stored
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Join" in x and "strategy=broadcast" not in x]
    assert len(joins) == 1  # the others bring the pieces' few offsets


@pytest.mark.parametrize("fan", [3, 7])
def test_exits_through_many_levels(spark, fan):
    """Few children a block make a deep index; ties in time, positions before all and after all quotes, rows without values."""
    positions, quotes = market(seed=8, n=260)
    positions += [("early", "HOT", 99.9, 100.1, START - timedelta(days=400), 1.0, 100.0), ("never", "HOT", 1.0, 1e9, START, 1.0, 100.0),
                  ("after", "HOT", 1e9, 2e9, START + timedelta(days=4000), 1.0, 100.0), ("nowhere", "NONE", 99.0, 101.0, START, 1.0, 100.0)]
    q = spark.createDataFrame([*quotes, ("HOT", None, 1, 5.0), ("HOT", START, 2, None), (None, START, 3, 5.0)], QUOTE)
    p = spark.createDataFrame([*positions, ("void", "HOT", 99.0, 101.0, None, 1.0, 100.0), ("bare", None, 99.0, 101.0, START, 1.0, 100.0)], POS)
    assert len(EX.range_index(q.where("symbol = 'HOT' AND bid IS NOT NULL AND ts IS NOT NULL").withColumn("seq", F.lit(0)), fan)) > 2
    want = brute(positions, quotes)
    assert as_dict(EX.first_exits(p, q, "seq", fan=fan)) == want and "early" in want and "never" not in want
    assert EX.first_exits(p, q.where("false"), "seq", fan=fan).count() == 0


def test_streamed_exits_equal_batch_over_several_files(spark, tmp_path):
    positions, quotes = market(seed=6, n=160)
    times = sorted(t for _, t, _, _ in quotes)
    edges = [times[0], times[len(times) // 3], times[2 * len(times) // 3], times[-1] + timedelta(days=1)]
    qdir, pdir = str(tmp_path / "q"), str(tmp_path / "p")
    for lo, hi in zip(edges, edges[1:]):  # one file per period, written in order
        spark.createDataFrame([q for q in quotes if lo <= q[1] < hi], QUOTE).coalesce(1).write.mode("append").parquet(qdir)
        spark.createDataFrame([p for p in positions if lo <= p[4] < hi], POS).coalesce(1).write.mode("append").parquet(pdir)
    read = spark.readStream.option("maxFilesPerTrigger", "1")
    out = drain(exit_stream(read.schema(POS).parquet(pdir), read.schema(QUOTE).parquet(qdir), "seq", salts=2))
    assert as_dict(out) == brute(positions, quotes)


def test_late_positions_are_settled(spark, tmp_path):
    """Every position arrives one micro-batch after the quotes it should have met."""
    positions, quotes = market(n=120, symbols=("HOT",))
    qdir, pdir = str(tmp_path / "q"), str(tmp_path / "p")
    half = quotes[len(quotes) // 2][1]
    for part in ([q for q in quotes if q[1] < half], [q for q in quotes if q[1] >= half]):
        spark.createDataFrame(part, QUOTE).coalesce(1).write.mode("append").parquet(qdir)
    spark.createDataFrame([], POS).coalesce(1).write.mode("append").parquet(pdir)
    spark.createDataFrame(positions, POS).coalesce(1).write.mode("append").parquet(pdir)
    read = spark.readStream.option("maxFilesPerTrigger", "1")
    out = drain(exit_stream(read.schema(POS).parquet(pdir), read.schema(QUOTE).parquet(qdir), "seq", salts=2))
    assert out.where(f"exit_reason = '{LATE}'").count() > 0
    settled = settle_late(out, spark.createDataFrame(positions, POS), spark.createDataFrame(quotes, QUOTE), "seq")
    assert as_dict(settled) == brute(positions, quotes)


def test_geometry(spark):
    df = spark.createDataFrame([(100.0, 1000.0, 10.0, 2.0), (100.0, 10.0, 10.0, 2.0), (100.0, 0.0, 0.0, 2.0)], "ask double, n double, r double, rr double")
    g = long_geometry("ask", "n", "r", "rr")
    rows = df.select(g.quantity.alias("q"), g.stop_loss.alias("s"), g.take_profit.alias("t"), g.valid.alias("v")).collect()
    assert (rows[0].q, rows[0].s, rows[0].t) == (10.0, pytest.approx(99.0), pytest.approx(102.0))
    assert [r.v for r in rows] == [True, False, False]


def chain(events, kind="decision"):
    lines, prev = [], JO.GENESIS_HASH
    for n, event in enumerate(events, 1):
        body = {"sequence": n, "previous_hash": prev, "event": event}
        digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        lines.append(json.dumps({**body, "entry_hash": digest}, sort_keys=True, separators=(",", ":")))
        prev = digest
    return lines


def decision(i):
    return {"decision_id": f"d{i}", "timestamp": "2024-01-01T00:00:00+00:00", "symbol": "X", "strategy": "s", "regime": "r",
            "signal_score": 0.5, "confidence": 1.0, "expected_return": 1e-05, "expected_cost": 0.0, "expected_risk": 0.1,
            "approved": i % 2 == 0, "reasons": ["A", "B"] if i % 2 else [], "metadata": {"rank": i, "note": "é,\"{}"}}


def test_journal_audit_and_parse(spark):
    good = chain([decision(i) for i in range(6)])
    books = {
        "good": [*good[:3], "", "  ", *good[3:]],
        "edited": [*good[:2], good[2].replace('"confidence":1.0', '"confidence":0.9'), *good[3:]],
        "gap": [*good[:2], *good[3:]],
        "forged": [*good[:3], chain([decision(9)] * 4)[3], *good[4:]],
        "repeated": [*good, good[5]],
        "headless": good[1:],
    }
    lines = spark.createDataFrame([(k, v) for k, vs in books.items() for v in vs], "journal_id string, value string").repartition(7)
    got = {r.journal_id: (r.intact, r.first_bad_sequence, r.failure) for r in JO.journal_summary(JO.audit_journal(lines)).collect()}
    assert got == {"good": (True, None, None), "edited": (False, 3, "ENTRY"), "gap": (False, 4, "SEQUENCE"),
                   "forged": (False, 4, "HASH_CHAIN"), "repeated": (False, 6, "SEQUENCE"), "headless": (False, 2, "SEQUENCE")}
    rows = SJ.decision_events(lines.where("journal_id = 'good'")).orderBy("sequence").collect()
    assert [r.decision_id for r in rows] == [f"d{i}" for i in range(6)]
    assert rows[1].reasons == ["A", "B"] and json.loads(rows[1].metadata) == {"rank": 1, "note": "é,\"{}"}
    assert rows[0].ts == datetime(2024, 1, 1)
    with pytest.raises(Exception, match="integrity failure"):
        JO.require_intact(JO.journal_summary(JO.audit_journal(lines))).collect()


def test_fingerprint_contract(spark):
    df = spark.range(50).select("id", (F.col("id") / 7).alias("x"))
    meta = DatasetMetadata("n", "s")

    def mark(frame, m=meta):
        return dataset_fingerprint(frame, m).first().fingerprint

    base = mark(df)
    assert mark(df.repartition(9).orderBy(F.desc("x"))) == base
    assert mark(df.withColumn("x", F.when(F.col("id") == 3, 0.0).otherwise(F.col("x")))) != base
    assert mark(df.withColumnRenamed("x", "y")) != base
    assert mark(df, DatasetMetadata("n", "s", "research_grade")) != base
    assert mark(df.unionByName(df.limit(1))) != base


def test_as_of_join_equals_loop(spark):
    rng = random.Random(8)
    obs = [(rng.choice("ABC"), START + timedelta(minutes=rng.randint(0, 9000)), float(i)) for i in range(150)]
    obs = list({(k, t): (k, t, v) for k, t, v in obs}.values())
    dec = [(k, START + timedelta(minutes=m)) for k in "ABCD" for m in range(0, 9000, 450)]
    out = as_of_join(spark.createDataFrame(dec, "symbol string, ts timestamp"),
                     spark.createDataFrame(obs, "symbol string, available_time timestamp, value double"), layout=SeriesLayout(block_rows=5))
    got = {(r.symbol, r.ts): r.value for r in out.collect()}
    want = {(k, t): max(((a, v) for s, a, v in obs if s == k and a <= t), default=(None, None))[1] for k, t in dec}
    assert got == want


def test_first_touch_against_a_loop():
    from marketloom.streaming.exits import first_touch

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 101):
        bid, start = rng.normal(10, 1, n), rng.integers(0, n + 1, 300)
        stop, target = rng.normal(8.5, 0.7, 300), rng.normal(11.5, 0.7, 300)
        stop[:5] = np.nan
        loop = [next((i for i in range(s, n) if bid[i] <= lo or bid[i] >= hi), n) for s, lo, hi in zip(start, stop, target)]
        assert first_touch(bid, start, stop, target).tolist() == loop


class CountingState:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class CountingHandle:
    def __init__(self):
        self.states = []

    def getValueState(self, *_):
        self.states.append(CountingState())
        return self.states[-1]


def test_exit_state_is_read_and_written_once_a_batch():
    """Hundreds of positions and symbols cost the state store as many calls as one."""
    import pandas as pd
    from marketloom.streaming.exits import OpenPositions

    positions, quotes = market(n=300, symbols=("HOT", *[f"S{i}-" for i in range(40)]))
    columns = ["decision_id", "symbol", "stop_loss", "take_profit", "opened_at", "quantity", "entry_price"]
    held = pd.DataFrame(positions, columns=columns).rename(columns={"opened_at": "at"}).assign(kind=0)
    ticks = pd.DataFrame(quotes, columns=["symbol", "at", "seq", "bid"]).assign(kind=1)
    rows = pd.concat([held, ticks], ignore_index=True)
    rows["at"] = rows["at"].astype("datetime64[us]").astype("int64")
    processor, handle = OpenPositions(), CountingHandle()
    processor.init(handle)
    half = rows["at"].median()
    out = []
    for batch in (rows[rows["at"] < half], rows[rows["at"] >= half]):
        out += list(processor.handleInputRows((1,), iter([batch.sample(frac=1.0, random_state=1)]), None))
    assert sum(s.calls for s in handle.states) == 3 * len(handle.states)  # one read, two writes
    got = pd.concat(out)
    want = brute(positions, quotes)
    assert len(want) > 50
    assert dict(zip(got["decision_id"], got["exit_price"])) == {k: v[1] for k, v in want.items()}


def test_nothing_late_needs_no_settling(spark):
    done = spark.createDataFrame([("a", "X", "STOP_LOSS")], "decision_id string, symbol string, exit_reason string")
    assert settle_late(done, None, None).collect() == done.collect()


def test_micro_batches_in_order_of_time_are_several_files(spark, tmp_path):
    from workloads.live import stream

    rows = spark.range(0, 1000, 1, 4).select(F.col("id"), F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("ts"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    q = stream(spark, str(tmp_path), "orders", "ts").writeStream.foreachBatch(
        lambda batch, _: seen.append(sorted((r.ts, r.f) for r in batch.select("ts", F.input_file_name().alias("f")).collect()))
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and sum(map(len, seen)) == 1000
    assert all(a[-1][0] < b[0][0] for a, b in zip(seen, seen[1:]))
    assert all(len({f for _, f in batch}) == 2 for batch in seen)  # a third of the four shuffle partitions, rounded up
