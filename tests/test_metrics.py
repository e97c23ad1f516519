import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from marketloom.operators import metrics as ME
from marketloom.operators.quantile import exact_quantile
from marketloom.operators.series import SeriesLayout

START = datetime(2024, 1, 1)
RUN = SeriesLayout(keys=("run_id",), block_rows=11)


def returns(spark, runs):
    rows = [(k, START + timedelta(days=i), x) for k, xs in runs.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "run_id string, ts timestamp, net_return double")


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    groups = {
        "flat": [0.0] * 50, "one": [3.0], "two": [1.0, 2.0], "ties": [float(rng.randint(0, 3)) for _ in range(200)],
        "wide": [rng.gauss(0, 1) for _ in range(999)] + [1e9], "tiny": [rng.random() * 1e-12 for _ in range(101)],
    }
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double")
    for q in (0.0, 0.05, 0.5, 1.0):
        got = {r.k: r.q for r in exact_quantile(df, ["k"], "x", q, "q").collect()}
        assert got == {k: pytest.approx(float(np.percentile(xs, q * 100)), rel=1e-12, abs=1e-25) for k, xs in groups.items()}


def plain_metrics(r):
    r = np.array(r)
    wealth = np.cumprod(1 + r)
    dd = max(0.0, float(np.max(1 - wealth / np.maximum.accumulate(wealth))))
    cagr = wealth[-1] ** (252 / len(r)) - 1
    mean, vol = r.mean() * 252, r.std() * math.sqrt(252)
    down = r[r < 0].std() * math.sqrt(252)
    tail = r[r <= np.percentile(r, 5)]
    return {
        "cagr": cagr, "annual_return": mean, "volatility": vol, "sharpe": mean / vol, "sortino": mean / down,
        "max_drawdown": dd, "calmar": cagr / dd, "cvar_95": max(0.0, -tail.mean()), "hit_rate": (r > 0).mean(),
        "profit_factor": r[r > 0].sum() / -r[r < 0].sum(),
    }


def test_performance_equals_plain_computation(spark):
    rng = random.Random(2)
    runs = {k: [rng.gauss(0.0005, 0.02) for _ in range(n)] for k, n in (("a", 90), ("b", 41))}
    out = {r.run_id: r.asDict() for r in ME.performance_metrics(returns(spark, runs), RUN).collect()}
    for k, r in runs.items():
        want = plain_metrics(r)
        assert {m: out[k][m] for m in want} == {m: pytest.approx(v, rel=1e-9) for m, v in want.items()}


def test_first_bar_loss_is_no_drawdown_and_bad_values_count_as_zero(spark):
    out = ME.performance_metrics(returns(spark, {"a": [-0.5, 0.0, float("nan"), float("inf")], "b": [0.0, 0.0]}), RUN)
    rows = {r.run_id: r for r in out.collect()}
    assert rows["a"].max_drawdown == 0.0 and rows["a"].annual_return == pytest.approx(-0.5 / 4 * 252)
    assert all(v == 0.0 for k, v in rows["b"].asDict().items() if k != "run_id")


def test_benchmark_columns(spark):
    rng = random.Random(3)
    bench = [rng.gauss(0, 0.01) for _ in range(60)]
    own = [0.0001 + 1.5 * b for b in bench]
    rows = [("a", START + timedelta(days=i), x, b) for i, (x, b) in enumerate(zip(own, bench))]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, net_return double, bench double")
    got = ME.performance_metrics(df, RUN, benchmark_ret="bench").first()
    assert got.beta == pytest.approx(1.5) and got.alpha == pytest.approx(0.0001 * 252)


def test_monthly_stability(spark):
    rows = [("a", datetime(2024, 1, 30), 0.02), ("a", datetime(2024, 1, 31), 0.01), ("a", datetime(2024, 2, 1), -0.02),
            ("a", datetime(2024, 2, 2), -0.01)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, net_return double")
    got = ME.stability_metrics(df, ["run_id"]).first()
    assert (got.monthly_observations, got.negative_month_rate) == (2.0, 0.5)
    assert got.worst_month == pytest.approx(0.98 * 0.99 - 1) and got.average_loss_month == pytest.approx(1 - 0.98 * 0.99)


def test_research_score_ignores_missing_and_non_finite(spark):
    df = spark.createDataFrame([(0.1, float("nan"), 0.5)], "cagr double, sharpe double, robustness double")
    got = df.select(ME.research_score(df.columns).alias("s")).first().s
    assert got == pytest.approx(3.0 * 0.1 + 1.5 * 0.5)
