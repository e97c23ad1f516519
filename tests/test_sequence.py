"""Several cycles per account: against one call per cycle, split runs, streams, and rows without ids."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators.gates import SafeguardConfig
from marketloom.operators.quality import LiveLimits
from marketloom.plans import cycle as CY
from marketloom.operators.asof import as_of_join
from marketloom.plans.sequence import MARK, Book, run_cycles, split_walk, walk_rows
from marketloom.session import cut, shared_dir
from marketloom.streaming.books import book_stream

START = datetime(2024, 3, 1, 12)
PLAN = ("account_id string, cycle_id string, ordinal bigint, decision_id string, symbol string, source string, expected_return double, "
        "expected_cost double, downside_risk double, correlation_penalty double, uncertainty double, confidence double, "
        "risk_fraction double, notional_fraction double, reward_risk double, market_regime string")
CYCLE = ("account_id string, cycle_id string, ts timestamp, regime string, equity_peak_usd double, daily_pnl_usd double, "
         "orders_last_minute int, kill_switch boolean")
ACCOUNT = "account_id string, balance double, equity double, free_margin double, ts timestamp, currency string"
SPEC = "symbol string, tick_size double, tick_value double, volume_min double, volume_max double, volume_step double, trade_enabled boolean"
LIMITS = LiveLimits(max_quote_age_seconds=100.0, max_account_age_seconds=1000.0, max_spread_fraction=0.01)
SAFE = SafeguardConfig(max_data_age_seconds=100.0)


def desk(spark, cycles=4, seed=1):
    rng = random.Random(seed)
    mk = spark.createDataFrame
    rows, plans, quotes, accounts = [], [], [], []
    symbols = ["X", "Y", "Z"]
    price = dict.fromkeys(symbols, 1.0)
    for k in range(cycles):
        now = START + timedelta(minutes=5 * k)
        for s in symbols:
            price[s] *= 1 + rng.uniform(-0.02, 0.02)
            if not (k == 2 and s == "Z"):  # a stale quote
                quotes.append((s, price[s], price[s] * 1.0001, now - timedelta(seconds=rng.randint(0, 30))))
            quotes.append((s, price[s] * 2, price[s] * 2.1, now + timedelta(seconds=40)))  # not yet known, stale at the next cycle
        for a in ("a", "b", "c"):
            accounts.append((a, 500.0, 500.0 + k, 500.0, now - timedelta(seconds=5), "USD"))
            if a == "c" and k > 0:
                continue  # idle after its first cycle
            rows.append((a, f"k{k}", now, "neutral_chop", None, 0.0, 0, False))
            for i in range(5):
                name = f"{a}{k}{i}" if i < 4 else f"{a}0{rng.randrange(4)}"  # used before
                plans.append((a, f"k{k}", i, name, rng.choice(symbols), f"m{i}", rng.choice([0.01, 0.02, 0.0001]), 0.0001, 0.001, 0.001, 0.001, 0.9,
                              rng.choice([0.003, 0.004, 0.02]), 0.25, 2.0, None))
    specs = [(s, 0.00001, 1.0, 0.01, 100.0, 0.01, True) for s in symbols]
    return (mk(rows, CYCLE), mk(accounts, ACCOUNT), mk(quotes, "symbol string, bid double, ask double, ts timestamp"), mk(specs, SPEC), mk(plans, PLAN))


def told(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


DECIDED = ("account_id", "cycle_id", "ordinal", "decision_id", "approved", "reasons", "rank", "quantity", "stop_loss", "opened_at")


@pytest.fixture(scope="module")
def run(spark):
    return run_cycles(*desk(spark), limits=LIMITS, safeguard=SAFE)


def test_equals_one_call_per_cycle(spark, run):
    cycles, accounts, quotes, specs, plans = desk(spark)
    positions = spark.createDataFrame([], "account_id string, decision_id string, symbol string, notional_usd double, estimated_risk_usd double, "
                                          "quantity double, entry_price double, stop_loss double, take_profit double, opened_at timestamp")
    states = spark.createDataFrame([], "account_id string, base_equity_usd double, realized_pnl_usd double, equity_peak_usd double, realized_today_usd double")
    journal, want, closed = None, [], []
    for k in range(4):
        own = cycles.where(F.col("cycle_id") == f"k{k}")
        now = START + timedelta(minutes=5 * k)
        def latest(df, key):
            return df.where(F.col("ts") <= now).groupBy(key).agg(F.max_by(F.struct("*"), "ts").alias("r")).select("r.*")
        seen = latest(quotes, "symbol")
        held = positions.join(own.select("account_id"), "account_id", "left_semi")
        idle = positions.join(own.select("account_id"), "account_id", "left_anti")
        kept = states.join(own.select("account_id"), "account_id", "left_anti")
        books, marked = CY.refresh_books(own, latest(accounts, "account_id"), held, seen, states, LIMITS)
        out = cut(CY.shadow_cycle(plans.where(F.col("cycle_id") == f"k{k}"), books, seen, specs, journal, safeguard=SAFE, limits=LIMITS))
        events = CY.lifecycle_rows(marked, out)
        closed += told(events, "event_id", "price", "pnl_usd")
        want += told(out, *DECIDED[:-1])
        positions = cut(CY.next_positions(marked, out).unionByName(idle))
        today = marked.where("exit_reason is not null").groupBy("account_id").agg(F.sum("mark_pnl_usd").alias("d"))
        fresh = CY.next_states(books).drop("updated_at").join(today, "account_id", "left").join(
            states.select("account_id", F.col("realized_today_usd").alias("t")), "account_id", "left")
        fresh = fresh.withColumn("realized_today_usd", F.coalesce("t", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).drop("d", "t")
        states = cut(fresh.unionByName(kept))
        journal = cut(out.select("account_id", "decision_id") if journal is None else journal.unionByName(out.select("account_id", "decision_id")))
    assert told(run.decisions, *DECIDED[:-1]) == sorted(want, key=str)
    assert told(run.events, "event_id", "price", "pnl_usd") == sorted(closed, key=str)
    columns = ("account_id", "decision_id", "symbol", "quantity", "stop_loss", "opened_at")
    assert told(run.positions, *columns) == told(positions, *columns)
    assert told(run.states, "account_id", "base_equity_usd", "equity_peak_usd") == told(states, "account_id", "base_equity_usd", "equity_peak_usd")
    codes = {x for row in run.decisions.collect() for x in row.reasons}
    assert {"DUPLICATE_DECISION_ID", "PORTFOLIO_MARK_UNAVAILABLE", "ORDER_RISK_LIMIT", "BELOW_MINIMUM_NET_EDGE"} <= codes
    ids = [r.event_id for r in run.events.collect()]
    assert len(ids) == len(set(ids)) and any(x.endswith(":CLOSE") for x in ids)
    assert any(r.account_id == "c" for r in run.positions.collect())  # idle, carried on


def test_two_runs_equal_one(spark, run):
    cycles, accounts, quotes, specs, plans = desk(spark)
    early = F.col("cycle_id") < "k2"
    first = run_cycles(cycles.where(early), accounts, quotes, specs, plans.where(early), limits=LIMITS, safeguard=SAFE)
    second = run_cycles(cycles.where(~early), accounts, quotes, specs, plans.where(~early), first.positions, first.states, first.events,
                        first.decisions.select("account_id", "decision_id"), limits=LIMITS, safeguard=SAFE)
    assert told(first.decisions.unionByName(second.decisions), *DECIDED) == told(run.decisions, *DECIDED)
    assert told(first.events.unionByName(second.events), "event_id", "ts", "metadata") == told(run.events, "event_id", "ts", "metadata")
    for table in ("positions", "states"):
        columns = getattr(run, table).columns
        assert told(getattr(second, table), *columns) == told(getattr(run, table), *columns)


def test_stream_equals_batch(spark, run):
    rows = walk_rows(*desk(spark), limits=LIMITS, last=False)
    base = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    for k in range(4):
        rows.where(F.col("cycle_id") == f"k{k}").coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)
    name = f"walk_{uuid.uuid4().hex}"
    q = book_stream(stream, SAFE).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = split_walk(spark.table(name))
    assert told(got.decisions, *DECIDED) == told(run.decisions, *DECIDED)
    assert told(got.events, "event_id", "ts", "metadata") == told(run.events, "event_id", "ts", "metadata")
    assert told(got.books, *run.books.columns) == told(run.books, *run.books.columns)


def test_rows_without_ids_are_kept(spark):
    cycles, accounts, quotes, specs, plans = desk(spark, cycles=1)
    row = list(plans.where("decision_id = 'a00'").first())
    odd = []
    for i, (name, symbol, source, cycle_id) in enumerate([(None, "X", "m", "k0"), (None, "Y", "m", "k0"), ("p", None, "m", "k0"), ("q", "X", None, "k0"), ("r", "X", "m", "none")]):
        odd.append((row[0], cycle_id, 100 + i, name, symbol, source, *row[6:]))
    both = plans.unionByName(spark.createDataFrame(odd, PLAN))
    out = run_cycles(cycles, accounts, quotes, specs, both, limits=LIMITS, safeguard=SAFE).decisions
    assert out.count() == both.count()
    found = {r.ordinal: r.reasons for r in out.collect() if r.ordinal >= 100}
    assert found[102] == ["MARKET_DATA_UNAVAILABLE"] and found[104] == ["ACCOUNT_DATA_UNAVAILABLE"] and found[101] == ["DUPLICATE_DECISION_ID"]
    none = run_cycles(cycles.where("false"), accounts, quotes, specs, plans.where("false"))
    assert none.decisions.count() == none.books.count() == none.positions.count() == 0


def test_book_adds_positions_as_it_opened_them():
    """What is open weighs the same in the cycle that opened it and in every later one, to the last bit."""
    book = Book(SafeguardConfig())
    risk = gross = 0.0
    for i in range(10):
        risk, gross = risk + 0.1, gross + 0.3
        book.held[str(i)] = ["X", 0.3, 0.1, 1.0, 1.0, 0.5, 2.0, 0]
    assert book._sums() == (risk, gross)
    assert risk != 1.0 and gross != 3.0


def test_symbols_are_marked_while_a_position_may_be_open(spark):
    """X leaves its barriers at once, Y never does, nothing can open Z: what is marked follows from that."""
    cycles, accounts, _, specs, plans = desk(spark)
    row = plans.where("decision_id = 'a00'").first().asDict()
    own = [{**row, "decision_id": s, "ordinal": i, "symbol": s, "expected_return": gain, "risk_fraction": 0.003}
           for i, (s, gain) in enumerate([("X", 0.02), ("Y", 0.02), ("Z", 0.0)])]
    prices = [(s, p, p * 1.0001, START + timedelta(minutes=5 * k)) for k in range(4) for s, p in (("X", 1.0 + k), ("Y", 1.0), ("Z", 1.0))]
    quotes = spark.createDataFrame(prices, "symbol string, bid double, ask double, ts timestamp")
    tables = (cycles, accounts, quotes, specs, spark.createDataFrame(own, PLAN))
    marks = walk_rows(*tables, limits=LIMITS).where(F.col("kind") == MARK)
    assert told(marks, "cycle_id", "symbol", "bid") == [("k1", "X", 2.0), ("k1", "Y", 1.0), ("k2", "Y", 1.0), ("k3", "Y", 1.0)]
    out = run_cycles(*tables, limits=LIMITS, safeguard=SAFE)
    assert told(out.events, "event_id", "price") == [("X:CLOSE", 2.0), ("X:OPEN", 1.0001), ("Y:OPEN", 1.0001)]


def test_observations_pass_from_piece_to_piece(spark):
    """One key holds all rows, so every piece but the first takes over what an earlier one knew."""
    start = datetime(2024, 1, 1)
    seen = [("k", start + timedelta(seconds=100 * i), float(i)) for i in range(3)] + [(None, start, -1.0)]
    asked = [("k", start + timedelta(seconds=s), i) for i, s in enumerate([-1, 0, 50, *[150] * 200, 199, 200, 10_000])] + [(None, start, 1), ("l", start, 2)]
    out = as_of_join(spark.createDataFrame(asked, "symbol string, ts timestamp, id int"),
                     spark.createDataFrame(seen, "symbol string, available_time timestamp, value double"))
    def known(symbol, ts):
        return max(((t, v) for s, t, v in seen if s == symbol and t <= ts), default=(None, None))[1]
    assert told(out, "symbol", "ts", "id", "value") == sorted(((s, t, i, known(s, t)) for s, t, i in asked), key=str)


def test_crowded_accounts_are_decided_alike(spark, monkeypatch):
    """Accounts that fit a task are shuffled by symbol and by account and not stored; in pieces they get the same decisions."""
    cycles, accounts, quotes, specs, plans = desk(spark, cycles=1)
    row = plans.where("decision_id = 'a00'").first().asDict()
    odd = [(None, "X", "k0"), (None, "Y", "k0"), ("p", None, "k0"), ("q", "W", "k0"), ("r", "X", "none"), ("s", "X", None), ("a00", "X", "a"), ("t", "X", "k0")]
    own = [{**row, "decision_id": d, "symbol": s, "cycle_id": k, "ordinal": 100 + i} for i, (d, s, k) in enumerate(odd)]
    own += [{**row, "account_id": a, "decision_id": "u", "ordinal": 200} for a in ("nobody", None)]
    plans = plans.unionByName(spark.createDataFrame(own, PLAN))
    positions = spark.createDataFrame([], "account_id string, decision_id string, symbol string, notional_usd double, estimated_risk_usd double, "
                                          "quantity double, entry_price double, stop_loss double, take_profit double, opened_at timestamp")
    states = spark.createDataFrame([], "account_id string, base_equity_usd double, realized_pnl_usd double, equity_peak_usd double, realized_today_usd double")
    seen = quotes.where(F.col("ts") <= START)
    books, _ = CY.refresh_books(cycles, accounts, positions, seen, states, LIMITS)
    journal = spark.createDataFrame([("a", "t"), ("b", "a00")], "account_id string, decision_id string")
    stored = []
    monkeypatch.setattr(CY, "interim", lambda df, real=CY.interim: stored.append(df.columns) or real(df))
    for policy in (CY.OpportunityPolicy(), CY.OpportunityPolicy(max_opportunities=2)):
        asked = (plans, books, seen, specs, journal, policy, SAFE, LIMITS)
        stored.clear()
        calm = CY.shadow_cycle(*asked)
        assert stored == [["account_id"]]
        want = told(calm, *calm.columns)
        assert len(want) == plans.count()
        assert {"DUPLICATE_DECISION_ID", "ACCOUNT_DATA_UNAVAILABLE", "MARKET_DATA_UNAVAILABLE"} <= {x for r in calm.collect() for x in r.reasons}
        assert told(CY.shadow_cycle(*asked, crowd=5), *calm.columns) == want  # some accounts in pieces
        assert told(CY.shadow_cycle(*asked, crowd=0), *calm.columns) == want
