import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import admission as AD
from marketloom.operators import ledger as LE
from marketloom.operators import ranking as RA
from marketloom.operators.fold import GreedyLayout
from marketloom.operators.gates import SafeguardConfig
from marketloom.plans.cycle import paper_cycle

PLAN = ("account_id string, cycle_id string, ordinal bigint, decision_id string, symbol string, source string, expected_return double, "
        "expected_cost double, downside_risk double, correlation_penalty double, uncertainty double, confidence double, "
        "risk_fraction double, notional_fraction double")


def plan(i, ret=0.05, risk=0.005, notional=0.2, account="a", cost=0.0, conf=1.0, downside=0.0):
    return (account, "c", i, f"{account}-{i}", f"S{i}", "s", ret, cost, downside, 0.0, 0.0, conf, risk, notional)


def states(spark, accounts, equity=1000.0, mode="paper", orders=0):
    rows = [(a, "c", mode, equity, equity, 0.0, 0.0, 0.0, 0.0, orders, False) for a in accounts]
    return spark.createDataFrame(rows, "account_id string, cycle_id string, mode string, equity_usd double, equity_peak_usd double, "
                                       "daily_pnl_usd double, open_risk_usd double, gross_notional_usd double, data_age_seconds double, "
                                       "orders_last_minute int, kill_switch boolean")


def test_fifth_plan_exceeds_total_risk(spark):
    plans = spark.createDataFrame([plan(i, ret=0.05 - i / 1000) for i in range(5)], PLAN)
    out = paper_cycle(plans, states(spark, ["a"])).orderBy("rank").collect()
    assert [r.accepted for r in out] == [True] * 4 + [False]
    assert out[4].reasons == ["TOTAL_OPEN_RISK_LIMIT"]


def test_live_mode_is_never_accepted(spark):
    plans = spark.createDataFrame([plan(1)], PLAN)
    cfg = SafeguardConfig(live_execution_enabled=True)
    row = paper_cycle(plans, states(spark, ["a"], mode="live"), safeguard=cfg).first()
    assert (row.approved, row.accepted) == (True, False)


def test_repeated_symbol_and_source_fail(spark):
    plans = spark.createDataFrame([plan(1), plan(1)], PLAN)
    with pytest.raises(Exception, match="duplicate plan"):
        paper_cycle(plans, states(spark, ["a"])).collect()


@pytest.mark.parametrize("layout", [GreedyLayout(), GreedyLayout(4, 10), GreedyLayout(1, 1)])
def test_admission_equals_loop(spark, monkeypatch, layout):
    """One pass, passes over a few blocks each, and passes of a single plan."""
    import marketloom.plans.cycle as cycle_module

    monkeypatch.setattr(cycle_module, "admit", lambda *a, **k: AD.admit(*a, **k, layout=layout))
    rng = random.Random(7)
    rows = [plan(i, ret=rng.random() * 0.05, risk=rng.random() * 0.006, notional=rng.random() * 0.8, account=f"a{min(i % 9, 6)}",
                 cost=rng.random() * 0.01, conf=0.5 + rng.random() / 2) for i in range(300)]
    out = paper_cycle(spark.createDataFrame(rows, PLAN).repartition(6), states(spark, [f"a{k}" for k in range(7)])).collect()
    got = {r.decision_id: r.accepted for r in out}
    budget = {r.decision_id: r.orders_last_minute for r in out}
    met = {}
    want, cfg, eq = {}, SafeguardConfig(), 1000.0
    for a in {r[0] for r in rows}:
        mine = [(r[11] * (r[6] - r[7]), r) for r in rows if r[0] == a]
        mine = sorted((x for x in mine if x[0] > 0), key=lambda x: (-x[0], -x[1][11], -x[1][6], x[1][2]))
        risk = gross = 0.0
        orders = 0
        for _, r in mine:
            rk, nt = eq * r[12], eq * r[13]
            ok = (rk / eq <= cfg.max_order_risk_pct and (risk + rk) / eq <= cfg.max_total_open_risk_pct and orders < 10
                  and (gross + nt) / eq <= cfg.max_gross_notional_multiple and r[6] * nt - r[7] * nt > 0)
            want[r[3]], met[r[3]] = ok, orders
            if ok:
                risk, gross, orders = risk + rk, gross + nt, orders + 1
    assert budget == met
    assert got == want and any(want.values()) and not all(want.values())


def test_many_acceptances_take_few_passes(spark, monkeypatch):
    """A thousand acceptances, sizes that give budget back, a null cycle, an empty table."""
    from marketloom.operators import fold as FO

    passes = []
    monkeypatch.setattr(FO, "ordered_fold", lambda *a, real=FO.ordered_fold, **k: passes.append(1) or real(*a, **k))
    rng = random.Random(3)
    cols = ("account_id string, rank bigint, symbol string, decision_id string, mode string, estimated_risk_usd double, notional_usd double, "
            "expected_gross_edge_usd double, expected_cost_usd double, equity_usd double, equity_peak_usd double, daily_pnl_usd double, "
            "open_risk_usd double, gross_notional_usd double, data_age_seconds double, orders_last_minute int, kill_switch boolean")
    rows = [(a, i + 1, "X", f"{a}{i}", "paper", rng.choice([0.001, 0.02, 4.0, -0.01]), rng.choice([0.1, 50.0, -20.0, 400.0]), 5.0, 1.0,
             1000.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0, False) for a, n in (("hot", 2500), (None, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, cols)
    out = AD.admit(df.repartition(7), ["account_id"], count_orders=False, layout=FO.GreedyLayout(64, 512)).collect()
    order = {(r.account_id, r.rank): r for r in out}
    assert len(out) == len(rows) == len(order) and len(passes) <= 6
    for a in ("hot", None):
        risk = gross = 0.0
        for r in (r for r in rows if r[0] == a):
            got = order[a, r[1]]
            assert (got.open_risk_usd, got.gross_notional_usd) == (risk, gross)
            if got.approved:
                risk, gross = risk + r[5], gross + r[6]
    assert sum(r.approved for r in out) > 1000
    assert AD.admit(df.limit(0), ["account_id"]).count() == 0


def test_only_cut_cycles_are_walked_in_passes(spark, monkeypatch):
    """Cycles that lie in one piece are ranked and walked by the pass that stores them; a split point cuts one at most."""
    walked = []

    def counted(rows, *args, real=AD.greedy, **kwargs):
        walked.append(rows.count())
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(AD, "greedy", counted)
    rows = [plan(i, ret=0.05 - (i % 6) / 1000, account=f"a{i // 6}") for i in range(1200)]
    out = paper_cycle(spark.createDataFrame(rows, PLAN).repartition(6), states(spark, [f"a{k}" for k in range(200)])).collect()
    assert sorted((r.account_id, r.rank, r.accepted) for r in out) == sorted((f"a{k}", n, n < 5) for k in range(200) for n in range(1, 7))
    assert sum(walked) <= 3 * 6  # four pieces


def test_limit_of_opportunities_keeps_the_best(spark):
    rows = [plan(i, ret=0.05 - (i % 6) / 1000, account=f"a{i // 6}") for i in range(60)]
    policy = RA.OpportunityPolicy(max_opportunities=2)
    out = paper_cycle(spark.createDataFrame(rows, PLAN).repartition(6), states(spark, [f"a{k}" for k in range(10)]), policy).collect()
    assert sorted((r.account_id, r.ordinal, r.rank) for r in out) == [(f"a{k}", 6 * k + n, n + 1) for k in range(10) for n in range(2)]


def test_clean_edge_ranks_before_risky_one(spark):
    rows = [plan(0, ret=0.08, downside=0.06), plan(1, ret=0.04), plan(2, ret=0.0)]
    out = RA.rank_opportunities(spark.createDataFrame(rows, PLAN), ["cycle_id"]).orderBy("rank").collect()
    assert [(r.ordinal, r.rank) for r in out] == [(1, 1), (0, 2)]


def test_row_numbers_with_heavy_ties(spark):
    rng = random.Random(9)
    rows = [("g", i, rng.choice([0.5, 0.5, 0.5, 1.0, rng.random()]), rng.choice([1.0, 1.0, 2.0])) for i in range(400)]
    rows += [("flat", i, 1.0, 1.0) for i in range(60)]
    rows += [(None, i, rng.random() if i % 3 else None, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, ordinal bigint, x double, y double")
    got = {(r.k, r.ordinal): r.rank for r in RA.row_numbers(df.repartition(5), ["k"], ("x", "y")).collect()}
    want = {}
    for k in ("g", "flat", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is None, -(r[2] or 0), -r[3], r[1])), 1):
            want[(k, r[1])] = n
    assert got == want


def test_duplicates_against_journal_and_batch(spark):
    batch = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3), ("z", 4)], "decision_id string, ordinal int")
    journal = spark.createDataFrame([("z",), ("z",)], "decision_id string")
    out = {(r.decision_id, r.ordinal): r.duplicate for r in AD.flag_duplicates(batch, journal).collect()}
    assert out == {("x", 1): False, ("x", 2): True, ("y", 3): False, ("z", 4): True}


def test_capital_ledger(spark):
    cols = "account_id string, month date, ending_equity double, net_contribution double, hwm double"
    rows = [("a", 1, 500.0, 0.0, 466.0), ("a", 2, 450.0, 0.0, 466.0), ("a", 3, 700.0, 100.0, 466.0)]
    df = spark.createDataFrame([(a, __import__("datetime").date(2024, m, 1), e, c, h) for a, m, e, c, h in rows], cols)
    out = LE.capital_ledger(df, ["account_id"], starting_hwm="hwm").orderBy("month").collect()
    assert [r.withdrawal for r in out] == pytest.approx([6.8, 0.0, (700 - 593.2) * 0.2])
    assert [r.next_high_water_mark for r in out] == pytest.approx([493.2, 493.2, 700 - (700 - 593.2) * 0.2])
    single = LE.capital_ledger(df.where("ending_equity = 500").withColumn("ending_equity", F.lit(580.0)).withColumn("net_contribution", F.lit(100.0)),
                               ["account_id"], starting_hwm="hwm").first()
    assert single.withdrawal == pytest.approx(2.8)


def test_regret(spark):
    cols = "key string, realized_net_return double, alternative_policy_return double, alternative_available_at_decision boolean, execution_cost_return double"
    rows = [("a", 0.0, 0.02, True, 0.001), ("a", -0.01, 0.0, True, 0.0), ("a", 0.03, 0.01, True, -1.0)]
    got = LE.regret_summary(spark.createDataFrame(rows, cols), ["key"]).first()
    assert (got.observations, got.missed_gain, got.avoidable_loss, got.execution_cost_drag) == (3, 0.02, 0.01, 0.001)
    assert got.total_regret == pytest.approx(0.03)
    bad = spark.createDataFrame([("a", 0.0, 0.02, False, 0.0)], cols)
    with pytest.raises(Exception, match="available at decision time"):
        LE.require_causal(LE.regret_summary(bad, ["key"])).collect()
