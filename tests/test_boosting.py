"""Boosted trees of all folds against a plain version: one fold at a time, float sums, a queue of leaves."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import folds as FO
from marketloom.operators.boosting import BoostConfig, boosted_oos
from marketloom.operators.trees import ModelConfig, train_oos

NAMES = ("a", "b", "c")
FOLDS = FO.PurgedFolds(30, 10, 2, 3)


def rows_of(dates=60, symbols=6, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for d in range(dates):
        for s in range(symbols):
            a, b, c = rng.normal(), float(rng.integers(0, 4)), rng.normal()
            y = 0.02 * np.sign(a) + 0.01 * b * (c > 0) + rng.normal() * 0.003
            odd = rng.random()
            out.append((f"s{s}", datetime(2024, 1, 1) + timedelta(days=d), d, None if odd < 0.02 else float(a), b, float("nan") if odd > 0.98 else float(c),
                        None if 0.5 < odd < 0.52 else float(y)))
    return out


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(rows_of(), "symbol string, ts timestamp, date_idx bigint, a double, b double, c double, y double")


def by_hand(x, y, test, s):
    """Predictions for ``test`` of trees fitted on (x, y)."""
    grid = np.linspace(0, 1, s.max_bins + 1)[1:-1]
    edges = [np.unique(np.sort(col)[np.clip(np.ceil(grid * len(col)).astype(int) - 1, 0, None)]) for col in x.T]
    bx, bt = (np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, z.T)], axis=1) for z in (x, test))
    pred, out = np.full(len(y), y.mean()), np.full(len(test), y.mean())

    def split(rows, g):
        best = None
        for f in range(x.shape[1]):
            for b in range(bx[rows, f].max() + 1):
                left = rows[bx[rows, f] <= b]
                n, m = len(left), len(rows) - len(left)
                if n < s.min_samples_leaf or m < s.min_samples_leaf:
                    continue
                gl, gt = g[left].sum(), g[rows].sum()
                gain = gl**2 / (n + s.l2_regularization) + (gt - gl) ** 2 / (m + s.l2_regularization) - gt**2 / (len(rows) + s.l2_regularization)
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, b)
        return best

    for _ in range(s.max_iter):
        g = pred - y
        leaves = [(np.arange(len(y)), np.arange(len(test)))]
        found = [split(leaves[0][0], g)]
        while len(leaves) < s.max_leaf_nodes and any(found):
            i = max((j for j in range(len(found)) if found[j]), key=lambda j: found[j][0])
            (rows, asked), (_, f, b) = leaves.pop(i), found.pop(i)
            for side in (lambda v: v <= b, lambda v: v > b):
                leaves.append((rows[side(bx[rows, f])], asked[side(bt[asked, f])]))
                found.append(split(leaves[-1][0], g))
        if len(leaves) > 1:
            for rows, asked in leaves:
                value = -s.learning_rate * g[rows].sum() / (len(rows) + s.l2_regularization)
                pred[rows] += value
                out[asked] += value
    return out


@pytest.mark.parametrize("s", [BoostConfig(max_iter=4, max_leaf_nodes=7, min_samples_leaf=5, stored_every=2),
                               BoostConfig(max_iter=2, max_leaf_nodes=3, min_samples_leaf=20, l2_regularization=3.0, max_bins=8, fold_group=1, task_rows=150)])
def test_boosting_follows_the_rules(panel, s):
    out = boosted_oos(panel.repartition(3), NAMES, "y", FOLDS, 60, s).toPandas().sort_values(["date_idx", "symbol"], ignore_index=True)
    raw = panel.toPandas().sort_values(["date_idx", "symbol"], ignore_index=True)
    assert len(out) == len(raw)
    x, y = raw[list(NAMES)].to_numpy(float), raw["y"].to_numpy(float)
    full, want = np.isfinite(x).all(1), np.full(len(raw), np.nan)
    for k in range(FOLDS.count(60)):
        train = raw["date_idx"].between(k * FOLDS.step, k * FOLDS.step + 29).to_numpy() & full & np.isfinite(y)
        first = FOLDS.first_test + k * FOLDS.step
        test = raw["date_idx"].between(first, first + 9).to_numpy() & full
        want[test] = by_hand(x[train], y[train], x[test], s)
    assert FOLDS.count(60) > 1 and np.isfinite(want).sum() > 100
    assert np.allclose(out["prediction"].to_numpy(float), want, atol=1e-9, equal_nan=True)


def test_boosting_is_named_repeatable_and_learns(panel):
    config = ModelConfig("hist_gb", {"max_iter": 12, "l2_regularization": 0.1, "max_leaf_nodes": 15, "min_samples_leaf": 5})
    a = train_oos(panel, NAMES, "y", FOLDS, 60, config).toPandas()
    b = train_oos(panel.repartition(7), NAMES, "y", FOLDS, 60, config).toPandas()
    keys = ["date_idx", "symbol"]
    a, b = (z.sort_values(keys, ignore_index=True) for z in (a, b))
    assert (a["prediction"].fillna(0) == b["prediction"].fillna(0)).all()  # to the last bit
    known = a.dropna(subset=["prediction", "y"])
    assert np.corrcoef(known["prediction"], known["y"])[0, 1] > 0.8
    with pytest.raises(ValueError, match="unsupported"):
        BoostConfig.of({"depth": 3})
    few = train_oos(panel.where(F.col("date_idx") < 3), NAMES, "y", FOLDS, 3, config)
    assert few.count() == 18 and few.where("prediction IS NOT NULL").count() == 0
