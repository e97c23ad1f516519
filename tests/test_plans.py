import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import bars_frame, loop_backtest, walk
from marketloom.functions import signals as S
from marketloom.operators import ledger as LE
from marketloom.operators.features import technical_features
from marketloom.operators.fingerprint import DatasetMetadata
from marketloom.operators.ranking import OpportunityPolicy
from marketloom.operators.trees import ModelConfig
from marketloom.plans import cycle as CY
from marketloom.session import cut
from marketloom.plans.learning import daily_report
from marketloom.plans.live import PlannerConfig, analyse, plan_trades
from marketloom.plans.research import RISK, run_research
from marketloom.plans.training import run_training

NOW = datetime(2024, 3, 1, 12)
PLAN = ("account_id string, cycle_id string, ordinal bigint, decision_id string, symbol string, source string, expected_return double, "
        "expected_cost double, downside_risk double, correlation_penalty double, uncertainty double, confidence double, "
        "risk_fraction double, notional_fraction double, reward_risk double, market_regime string")


class Desk:
    """One account's cycle inputs; state carries from cycle to cycle."""

    def __init__(self, spark):
        self.spark, self.now, self.bid, self.ask, self.quote_ts, self.equity = spark, NOW, 1.1, 1.1002, NOW, 466.0
        self.positions = spark.createDataFrame([], "account_id string, decision_id string, symbol string, notional_usd double, "
                                                   "estimated_risk_usd double, quantity double, entry_price double, stop_loss double, "
                                                   "take_profit double, opened_at timestamp")
        self.states = spark.createDataFrame([], "account_id string, base_equity_usd double, realized_pnl_usd double, equity_peak_usd double, realized_today_usd double")
        self.journal = None

    def plan(self, name, symbol="X", risk=0.003, notional=0.25, ordinal=1):
        return ("a", "c", ordinal, name, symbol, f"m-{name}", 0.01, 0.0001, 0.001, 0.001, 0.001, 0.9, risk, notional, 2.0, None)

    def run(self, plans, policy=OpportunityPolicy(), symbols=("X",)):
        mk = self.spark.createDataFrame
        cycles = mk([("a", "c", self.now, "neutral_chop", None, 0.0, 0, False)],
                    "account_id string, cycle_id string, ts timestamp, regime string, equity_peak_usd double, daily_pnl_usd double, orders_last_minute int, kill_switch boolean")
        accounts = mk([("a", self.equity, self.equity, self.equity, self.now, "USD")],
                      "account_id string, balance double, equity double, free_margin double, ts timestamp, currency string")
        quotes = mk([(s, self.bid, self.ask, self.quote_ts) for s in symbols], "symbol string, bid double, ask double, ts timestamp")
        specs = mk([(s, 0.00001, 1.0, 0.01, 100.0, 0.01, True) for s in symbols],
                   "symbol string, tick_size double, tick_value double, volume_min double, volume_max double, volume_step double, trade_enabled boolean")
        self.books, self.marked = CY.refresh_books(cycles, accounts, self.positions, quotes, self.states)
        out = cut(CY.shadow_cycle(mk(plans, PLAN), self.books, quotes, specs, self.journal, policy))
        self.events = CY.lifecycle_rows(self.marked, out)
        self.positions = cut(CY.next_positions(self.marked, out))
        self.states = cut(CY.next_states(self.books).withColumn("realized_today_usd", F.lit(0.0)))
        ids = out.select("account_id", "decision_id")
        self.journal = cut(ids if self.journal is None else self.journal.unionByName(ids))
        return {r.decision_id: r for r in out.collect()}


def test_cycle_opens_closes_and_blocks(spark):
    desk = Desk(spark)
    row = desk.run([desk.plan("a")], OpportunityPolicy(minimum_net_edge=0.0005))["a"]
    assert row.approved and row.entry_price == 1.1002 and row.rank == 1 and row.regime == "neutral_chop"
    assert desk.run([desk.plan("a")])["a"].reasons == ["DUPLICATE_DECISION_ID"]
    desk.now = NOW + timedelta(seconds=40)  # the open position's quote is now stale
    assert desk.run([desk.plan("b")])["b"].reasons == ["PORTFOLIO_MARK_UNAVAILABLE"]
    desk.quote_ts = desk.now
    desk.bid = row.stop_loss * 0.999
    desk.ask = desk.bid * 1.0001
    desk.run([desk.plan("c", symbol="missing")])
    book = desk.books.first()
    assert book.realized_total_usd == pytest.approx(row.quantity * (desk.bid - row.entry_price)) and book.realized_total_usd < 0
    assert [(r.event_id, r.event_type) for r in desk.events.collect()] == [("a:CLOSE", "CLOSE")]
    assert LE.daily_realized_pnl(desk.events, ("account_id",)).first().realized_pnl_usd == pytest.approx(book.realized_total_usd)
    assert desk.positions.count() == 0 and desk.states.first().realized_pnl_usd < 0


def test_cycle_market_reasons(spark):
    desk = Desk(spark)
    assert desk.run([desk.plan("a", symbol="none")])["a"].reasons == ["MARKET_DATA_UNAVAILABLE"]
    desk.quote_ts = NOW - timedelta(seconds=31)
    assert desk.run([desk.plan("b")])["b"].reasons == ["STALE_QUOTE"]
    desk.quote_ts, desk.bid, desk.ask = NOW, 1.0, 1.015
    assert desk.run([desk.plan("c")], OpportunityPolicy(minimum_net_edge=0.0005))["c"].reasons == ["BELOW_MINIMUM_NET_EDGE"]
    desk.equity = -5.0
    assert desk.run([desk.plan("d")])["d"].reasons == ["ACCOUNT_DATA_UNAVAILABLE"]


def test_total_open_risk_sits_on_the_boundary(spark):
    desk = Desk(spark)
    names = [f"S{i}" for i in range(5)]
    out = desk.run([desk.plan(f"d{i}", s, 0.005, 0.20, i) for i, s in enumerate(names)], symbols=names)
    assert sum(r.approved for r in out.values()) == 4
    assert [r.reasons for r in out.values() if not r.approved] == [["TOTAL_OPEN_RISK_LIMIT"]]
    assert out["d4"].reasons == ["TOTAL_OPEN_RISK_LIMIT"]


def test_books_add_up_positions_that_are_not_stored(spark):
    """Two accounts: exits, stale and missing quotes are told per position and added up; marked positions are no table of their own."""
    mk = spark.createDataFrame
    cycles = mk([(a, f"c-{a}", NOW, "neutral_chop", None, 0.0, 0, False) for a in "abz"],
                "account_id string, cycle_id string, ts timestamp, regime string, equity_peak_usd double, daily_pnl_usd double, orders_last_minute int, kill_switch boolean")
    accounts = mk([(a, 1000.0, 1000.0, 1000.0, NOW, "USD") for a in "abz"],
                  "account_id string, balance double, equity double, free_margin double, ts timestamp, currency string")
    quotes = mk([("X", 1.0, 1.001, NOW), ("OLD", 9.0, 9.001, NOW - timedelta(days=1))], "symbol string, bid double, ask double, ts timestamp")
    kinds = {"stop": ("X", 1.5, 3.0), "take": ("X", 0.1, 0.9), "open": ("X", 0.5, 2.0), "old": ("OLD", 9.5, 10.0), "none": ("NONE", 1.0, 2.0)}
    rows = [(acc, f"{acc}-{kind}", kinds[kind][0], 50.0, 5.0, 10.0, 1.2, *kinds[kind][1:], NOW)
            for acc, kind in [("a", "stop"), ("a", "take"), ("a", "open"), ("b", "open"), ("b", "old"), ("b", "none"), ("gone", "stop")]]
    positions = mk(rows, "account_id string, decision_id string, symbol string, notional_usd double, estimated_risk_usd double, quantity double, "
                         "entry_price double, stop_loss double, take_profit double, opened_at timestamp")
    states = mk([], "account_id string, base_equity_usd double, realized_pnl_usd double, equity_peak_usd double, realized_today_usd double")
    books, marked = CY.refresh_books(cycles, accounts, positions, quotes, states)
    got = {r.account_id: (r.exits, r.mark_issue_count, r.open_risk_usd, r.gross_notional_usd) for r in books.collect()}
    assert got == {"a": (2, 0, 5.0, 50.0), "b": (0, 2, 15.0, 150.0), "z": (0, 0, 0.0, 0.0)}
    assert books.where("account_id = 'a'").first().realized_total_usd == pytest.approx(2 * 10 * (1.0 - 1.2))
    assert {r.decision_id: (r.exit_reason, tuple(r.mark_issues), r.mark_pnl_usd is None) for r in marked.collect()} == {
        "a-stop": ("STOP_LOSS", (), False), "a-take": ("TAKE_PROFIT", (), False), "a-open": (None, (), False), "b-open": (None, (), False),
        "b-old": (None, ("STALE_QUOTE",), True), "b-none": (None, ("MARKET_DATA_UNAVAILABLE",), True)}
    assert not marked.inputFiles()


def trending(n, seed):
    rng = np.random.default_rng(seed)
    steps = 0.0005 + 0.002 * np.sin(np.arange(n) / 18) + rng.normal(0, 0.009, n)
    return [float(x) for x in 100 * np.exp(np.cumsum(steps))]


@pytest.fixture(scope="module")
def research(spark):
    crash = [float(x) for x in (*np.linspace(100.0, 140.0, 80), *[30.0] * 40)]
    series = {"UP": trending(260, 11), "CRASH": crash}
    bars = bars_frame(spark, series, step=timedelta(days=1)).cache()
    return series, bars, run_research(bars)


def test_research_runs_all_symbols(research):
    _, _, run = research
    board = run.leaderboard.collect()
    assert {r.strategy for r in board if r.symbol == "UP"} == {"trend", "momentum", "mean_reversion", "breakout", "ml_ridge"}
    assert {r.strategy for r in board if r.symbol == "CRASH"} == {"trend", "momentum", "mean_reversion", "breakout"}
    for s in ("UP", "CRASH"):
        mine = sorted((r for r in board if r.symbol == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.score >= b.score for a, b in zip(mine, mine[1:])) and all(math.isfinite(r.score) for r in mine)
    summary = {r.symbol: r for r in run.summary.collect()}
    assert 0 <= summary["UP"].latest_signal <= 1 and summary["UP"].ml_oos_samples == 21 * ((235 - 117) // 26)
    assert run.findings.where("symbol = 'CRASH'").count() >= 1


def test_ensemble_goes_through_the_risk_gate(research):
    _, _, run = research
    late = run.ensemble.where("symbol = 'CRASH' AND row_idx > 82").agg(F.sum("position").alias("p"), F.count("*").alias("n")).first()
    assert (late.p, late.n) == (0.0, 38)


def test_research_backtests_equal_loop(research):
    series, bars, run = research
    signals = technical_features(bars).withColumn("s", S.momentum_signal())
    for name, closes in series.items():
        s = [r.s for r in signals.where(F.col("symbol") == name).orderBy("ts").collect()]
        got = run.backtests.where((F.col("symbol") == name) & (F.col("strategy") == "momentum")).orderBy("ts").collect()
        want = loop_backtest(closes, s, risk=RISK)
        assert [r.equity for r in got] == pytest.approx([w[3] for w in want])


def test_training_run(spark):
    bars = bars_frame(spark, {s: walk(140, i, vol=0.01) for i, s in enumerate("ABCD")}, step=timedelta(days=2)).cache()
    models = (ModelConfig("ridge"), ModelConfig("elastic_net"))
    run = run_training(bars, DatasetMetadata("t", "walk", "research_grade"), models)
    board = run.leaderboard.orderBy("rank").collect()
    assert [r["rank"] for r in board] == [1, 2] and {r.model for r in board} == {"ridge", "elastic_net"}
    assert run.folds.train_periods == 70 and all(0 < r.oos_coverage < 1 for r in board)
    assert run.predictions.where("prediction IS NOT NULL").groupBy("model").count().count() == 2
    again = run_training(bars.repartition(5), DatasetMetadata("t", "walk", "demo"), models[:1])
    assert again.leaderboard.first().score == pytest.approx(next(r.score for r in board if r.model == "ridge"))
    assert again.fingerprint != run.fingerprint and again.champion_candidate().count() == 0
    artifact = run.artifacts.where("model_name = 'ridge'").first()
    assert artifact.label_name == "fwd_return_5" and artifact.dataset_fingerprint == run.fingerprint and "cagr" in artifact.metrics
    with pytest.raises(ValueError):
        run_training(bars, DatasetMetadata("t", "w"), models, horizon=0)
    with pytest.raises(ValueError, match="DUPLICATE"):
        run_training(bars.unionByName(bars.limit(1)), DatasetMetadata("t", "w"), models)


def test_live_plans(spark):
    up = [100.0 * 1.002 ** i * (1 + 0.0005 * (-1) ** i) for i in range(300)]
    bars = bars_frame(spark, {"UP": up, "DOWN": [1 / x for x in up], "SHORT": up[:60]})
    analysis = {r.symbol: r for r in analyse(bars).collect()}
    assert analysis["UP"].eligible and not analysis["DOWN"].eligible
    assert (analysis["UP"].bar_count, analysis["SHORT"].enough_bars) == (250, False)
    rets = np.diff(up[-250:]) / np.array(up[-250:-1])
    assert analysis["UP"].sample_count <= len(rets)
    plans = plan_trades(analyse(bars), PlannerConfig(decision_namespace="ns")).collect()
    last = bars.where("symbol = 'UP'").agg(F.unix_seconds(F.max("ts")).alias("t")).first().t
    assert [(p.decision_id, p.symbol, p.risk_fraction) for p in plans] == [(f"ns:UP:{last}", "UP", 0.003)]
    # Neither order nor partitioning nor bars beyond the last 250 matter.
    same = plan_trades(analyse(bars.repartition(9).where("symbol <> 'UP'").unionByName(bars_frame(spark, {"UP": up}).repartition(3))),
                       PlannerConfig(decision_namespace="ns")).collect()
    assert same == plans


def test_daily_report_lets_stability_override(spark):
    rets = spark.createDataFrame([("r", datetime(2024, m, 1), x) for m, x in ((1, 0.1), (2, -0.1))], "run string, ts timestamp, net_return double")
    facts = spark.createDataFrame([("r", -0.01, 0.01, True, 0.0)] * 3, "run string, realized_net_return double, alternative_policy_return double, "
                                                                      "alternative_available_at_decision boolean, execution_cost_return double")
    base = spark.createDataFrame([("r", 0.2, 0.0)], "run string, cost_ratio double, negative_month_rate double")
    out = daily_report(rets, facts, ["run"], base)
    assert out.metrics.first().negative_month_rate == 0.5
    assert [r.category for r in out.findings.collect()] == ["execution_costs", "monthly_stability", "decision_regret"]
