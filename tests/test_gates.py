import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import champions as CH
from marketloom.operators import gates as GA
from marketloom.operators import quality as QU
from marketloom.operators.fold import GreedyLayout
from marketloom.functions.reasons import reason_codes

STATE = dict(
    decision_id="d", symbol="X", mode="shadow", estimated_risk_usd=1.0, notional_usd=100.0, expected_gross_edge_usd=5.0,
    expected_cost_usd=1.0, equity_usd=1000.0, equity_peak_usd=1000.0, daily_pnl_usd=0.0, open_risk_usd=0.0,
    gross_notional_usd=0.0, data_age_seconds=0.0, orders_last_minute=0, kill_switch=False,
)
CASES = [
    ({}, []),
    ({"kill_switch": True}, ["KILL_SWITCH"]),
    ({"mode": "live"}, ["LIVE_EXECUTION_DISABLED"]),
    ({"data_age_seconds": 31.0}, ["STALE_DATA"]),
    ({"data_age_seconds": 30.0}, []),
    ({"orders_last_minute": 10}, ["ORDER_RATE_LIMIT"]),
    ({"estimated_risk_usd": 5.01}, ["ORDER_RISK_LIMIT"]),
    ({"open_risk_usd": 19.5}, ["TOTAL_OPEN_RISK_LIMIT"]),
    ({"daily_pnl_usd": -20.0}, ["DAILY_LOSS_LIMIT"]),
    ({"equity_peak_usd": 1112.0}, ["MAX_DRAWDOWN"]),
    ({"gross_notional_usd": 1901.0}, ["GROSS_EXPOSURE_LIMIT"]),
    ({"expected_cost_usd": 5.0}, ["NO_POSITIVE_NET_EDGE", "COST_CONSUMES_EDGE"]),
    ({"expected_gross_edge_usd": 0.0, "expected_cost_usd": 0.0}, ["NO_POSITIVE_NET_EDGE"]),
    ({"equity_usd": 466.0, "equity_peak_usd": 466.0, "estimated_risk_usd": 2.0}, []),
    ({"equity_usd": 466.0, "equity_peak_usd": 466.0, "estimated_risk_usd": 2.5}, ["ORDER_RISK_LIMIT"]),
]


def test_safeguard_matrix(spark):
    rows = [tuple({**STATE, **change}.values()) + (i,) for i, (change, _) in enumerate(CASES)]
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in STATE.items()) + ", i int"
    out = GA.safeguard(spark.createDataFrame(rows, ddl)).orderBy("i").collect()
    for (_, want), row in zip(CASES, out):
        assert (row.reasons, row.approved) == (want, not want)


def test_experiment_stages(spark):
    cols = "stage string, score double, robustness double, sample_count int, max_drawdown double, negative_month_rate double, champion_score double"
    rows = [
        ("proposed", None, None, None, None, None, None), ("backtest", 1.0, 0.7, 126, 0.1, 0.2, None),
        ("shadow", 1.0, 0.7, 5, 0.1, 0.2, None), ("micro", 2.01, 0.7, 30, None, 0.0, 2.0), ("micro", 2.05, 0.7, 30, None, 0.0, 2.0),
        ("backtest", 1.0, 0.1, 500, 0.3, 0.9, None), ("backtest", 1.0, 0.9, 500, float("nan"), 0.0, None), ("promoted",) + (None,) * 6,
        ("shadow",) + (None,) * 6,
    ]
    out = GA.advance_experiments(spark.createDataFrame(rows, cols)).collect()
    assert [r.next_stage for r in out] == [
        "backtest", "shadow", "shadow", "micro", "promoted", "rejected", "rejected", "promoted", "shadow"]
    assert [r.stage_reasons for r in out] == [
        [], [], ["INSUFFICIENT_SAMPLES"], ["INSUFFICIENT_SCORE_MARGIN"], [], ["LOW_ROBUSTNESS", "MAX_DRAWDOWN", "NEGATIVE_MONTH_RATE"],
        ["MAX_DRAWDOWN"], ["TERMINAL_STAGE"], ["MISSING_EVIDENCE"]]
    assert [r.terminal for r in out] == [False, False, False, False, True, True, True, True, False]


def test_missing_metric_blocks_promotion_and_demo_data_never_promotes(spark):
    cols = "grade string, score double, oos_coverage double, robustness double, max_drawdown double, turnover double, negative_month_rate double, monthly_observations double"
    good = ("research_grade", 1.0, 0.5, 0.6, 0.2, 50.0, 0.3, 8.0)
    rows = [good, ("demo", *good[1:]), (*good[:4], None, *good[5:]), (good[0], float("nan"), *good[2:]), (*good[:7], 5.0)]
    got = spark.createDataFrame(rows, cols).select(GA.eligible_for_promotion().alias("e")).collect()
    assert [r.e for r in got] == [True, False, False, False, False]


def test_findings(spark):
    cols = "run string, cost_ratio double, negative_month_rate double, max_drawdown double, observations int, avoidable_loss double, missed_gain double, regime_degradation boolean"
    rows = [("a", 0.2, 0.5, 0.2, 3, 0.1, 0.0, True), ("b", 0.0, 0.0, None, 2, 1.0, 1.0, None)]
    out = GA.review_findings(spark.createDataFrame(rows, cols), ["run"]).collect()
    assert [r.category for r in out if r.run == "a"] == [
        "execution_costs", "monthly_stability", "regime_risk", "decision_regret", "ensemble"]
    assert [r.category for r in out if r.run == "b"] == ["machine_learning"]
    assert QU.checked(GA.review_findings(spark.createDataFrame(rows, cols), ["run"]), QU.hypothesis_rules()).where("NOT ok").count() == 0


@pytest.mark.parametrize("layout", [GreedyLayout(), GreedyLayout(4, 8)])
def test_champion_fold_equals_loop(spark, layout):
    rng = random.Random(4)
    rows = [(f"f{i % 3}", i, f"n{i}", rng.random() * 2, rng.random(), rng.randint(100, 200), rng.random() * 0.4,
             rng.random() * 0.6 if rng.random() > 0.1 else None, 8.0) for i in range(150)]
    cols = "family string, ordinal int, name string, score double, robustness double, oos_samples int, max_drawdown double, negative_month_rate double, monthly_observations double"
    crit = CH.PromotionCriteria(min_robustness=0.2, max_drawdown=0.35)
    promoted = CH.promote_in_order(spark.createDataFrame(rows, cols).repartition(5), ["family"], criteria=crit, layout=layout).cache()
    won, champion = set(), {}
    for fam, i, name, score, rob, n, dd, neg, months in rows:
        if n < 126 or rob < 0.2 or dd > 0.35 or neg is None or neg > 0.5 or months < 6:
            continue
        c = champion.get(fam)
        if c is None or (score >= c[0] + 0.05 and dd <= c[1] + 0.02 and neg <= c[2] + 0.02):
            champion[fam] = (score, dd, neg, name)
            won.add(name)
    assert {r.name for r in promoted.where("promoted").collect()} == won
    assert promoted.count() == len(rows)
    got = {r.family: r.champion for r in CH.reigning_champion(promoted, ["family"]).collect()}
    assert got == {k: v[3] for k, v in champion.items()}


def test_quote_spec_account_rules(spark):
    q = spark.createDataFrame([("X", 1.0, 1.05, 31.0), ("X", 1.0, 1.001, -5.0), (" ", 2.0, 1.0, 0.0), ("X", float("nan"), 1.0, 0.0)],
                              "symbol string, bid double, ask double, age double")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    q = q.withColumn("ts", (F.unix_micros(now) / 1e6 - F.col("age")).cast("timestamp"))
    out = q.select(QU.quote_rules().alias("c"), QU.live_quote_rules(now).alias("l")).collect()
    assert [r.c for r in out] == [[], [], ["SYMBOL_REQUIRED", "CROSSED_QUOTE"], ["PRICE_NOT_FINITE"]]
    assert [r.l for r in out[:2]] == [["STALE_QUOTE", "EXCESSIVE_SPREAD"], []]
    s = spark.createDataFrame([("X", 0.01, 0.0, 0.1, 10.0, 0.1, True), ("X", 0.0, -1.0, 0.0, -1.0, 0.1, False)],
                              "symbol string, tick_size double, tick_value double, volume_min double, volume_max double, volume_step double, trade_enabled boolean")
    out = s.select(QU.spec_rules().alias("c"), QU.live_symbol_rules().alias("l")).collect()
    assert (out[0].c, out[0].l) == ([], [])
    assert out[1].l == ["SYMBOL_DISABLED", "INVALID_TICK_SIZE", "INVALID_VOLUME_RULES", "INVALID_VOLUME_RANGE"]


def test_table_rules_fail_closed(spark):
    cols = "symbol string, ts int, open double, high double, low double, close double, volume double"
    bad = spark.createDataFrame([("A", 1, 1.0, 1.0, 1.0, 0.0, -1.0), ("A", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    assert {r.rule: r.rows for r in QU.bar_violations(bad).collect()} == {
        "CLOSE_NOT_POSITIVE": 1, "VOLUME_NEGATIVE": 1, "DUPLICATE_KEY": 2}
    with pytest.raises(ValueError, match="DUPLICATE_KEY"):
        QU.require_valid_bars(bad)
    with pytest.raises(ValueError, match="EMPTY"):
        QU.require_valid_bars(bad.where("false"))
    with pytest.raises(ValueError, match="missing"):
        QU.bar_violations(bad.drop("close"))


def test_as_of_filter(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-05"), (3, None)], "i int, a string").select(
        "i", F.col("a").cast("timestamp").alias("available_time"))
    assert [r.i for r in QU.as_of(df, "2024-01-03 00:00:00").collect()] == [1]
    assert QU.as_of(df.drop("available_time"), "2024-01-03 00:00:00").count() == 3


def test_hypothesis_guard(spark):
    cols = "hypothesis string, proposed_change string, evidence array<string>, validation_plan array<string>, invalidation_criteria array<string>"
    ok = ("Costs matter a lot", "Lower turnover", ["x"], ["y"], ["z"])
    rows = [ok, ("Costs", "Please PLACE a live order", *ok[2:]), ("abc", ok[1], [], ["buy tsla now"], ["z"]), (*ok[:4], ["sell everything someday"])]
    out = spark.createDataFrame(rows, cols).select(QU.hypothesis_rules().alias("r")).collect()
    assert [r.r for r in out] == [[], ["DIRECT_ORDER"], ["HYPOTHESIS_TOO_SHORT", "EVIDENCE_REQUIRED", "DIRECT_ORDER"], []]


def test_null_conditions_do_not_fire(spark):
    df = spark.createDataFrame([(None,)], "x double").select(reason_codes([(F.col("x") > 1, "A"), (F.col("x").isNull(), "B")]).alias("r"))
    assert df.first().r == ["B"]
