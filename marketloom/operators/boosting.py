"""Histogram gradient boosting for all folds at once.

Rows are binned once per fold. A pass over the binned table sums gradients and counts per (fold, node, feature, bin): tasks
build the histograms of the rows they hold, Spark adds them up by (fold, node), and one split per node comes back. All
folds grow their trees in the same passes, so their number is that of the deepest tree, not of the folds.

Trees grow best first up to ``max_leaf_nodes``. A node's gain depends on its own rows only, so nodes that the order might
reach are measured ahead, a level per pass, and the order is replayed on what is known. Gradients are rounded to a fixed
point chosen so that sums are exact in doubles: neither the order of rows nor their partitioning changes a tree.

The driver holds the trees of ``fold_group`` folds; more folds are taken group by group.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import within
from ..functions.clean import finite
from ..session import interim
from .folds import PurgedFolds
from .linear import MIN_TRAIN_ROWS, known


@dataclass(frozen=True)
class BoostConfig:
    # Fixed values.
    learning_rate: float = 0.05
    max_iter: int = 150
    max_leaf_nodes: int = 15
    l2_regularization: float = 0.1
    min_samples_leaf: int = 20
    max_bins: int = 255
    fold_group: int = 64
    stored_every: int = 10  # trees after which predictions are written down
    task_rows: int = 250_000  # rows of a task; it sends a histogram per node, so few large tasks send less

    def __post_init__(self) -> None:
        within(self, learning_rate="(0, 1]", max_iter="[1,", max_leaf_nodes="[2,", l2_regularization="[0,", min_samples_leaf="[1,",
               max_bins="[2, 255]", fold_group="[1,", stored_every="[1,")

    @classmethod
    def of(cls, params: Mapping[str, Any]) -> "BoostConfig":
        unknown = sorted(set(params) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unsupported boosting params: {unknown}")
        return cls(**params)


@dataclass
class Node:
    """Sums of a node, its best split once measured, and its children once split."""

    total: float
    n: int
    split: tuple[float, int, int, float, int] | None = None  # gain, feature, bin, total and rows of the left child
    measured: bool = False
    left: int = -1


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def grow(self, config: BoostConfig) -> tuple[dict[int, tuple[int, int, int]], set[int], bool]:
        """Replay best-first growth: splits made (node: feature, bin, left child), nodes to measure, whether it is done."""
        splits: dict[int, tuple[int, int, int]] = {}
        queue: list[tuple[float, int]] = []

        def offer(i: int) -> bool:
            node = self.nodes[i]
            if not node.measured:
                return False
            if node.split is not None:
                heapq.heappush(queue, (-node.split[0], i))
            return True

        if not offer(0):
            return splits, {0}, False
        leaves = 1
        while queue and leaves < config.max_leaf_nodes:
            _, i = queue[0]
            node = self.nodes[i]
            self._part(i, config)
            ends = leaves + 1 == config.max_leaf_nodes
            if not ends and not all(self.nodes[j].measured for j in (node.left, node.left + 1)):
                # Which leaf comes next is not known yet: measure below every leaf that may still be split.
                ahead = heapq.nsmallest(config.max_leaf_nodes - leaves, queue)
                for _, j in ahead:
                    self._part(j, config)
                below = {c for _, j in ahead for c in (self.nodes[j].left, self.nodes[j].left + 1)}
                return splits, {c for c in below if not self.nodes[c].measured}, False
            heapq.heappop(queue)
            splits[i] = (node.split[1], node.split[2], node.left)
            leaves += 1
            if not ends:
                offer(node.left), offer(node.left + 1)
        return splits, set(), True

    def _part(self, i: int, config: BoostConfig) -> None:
        node = self.nodes[i]
        if node.left < 0:
            _, _, _, total, n = node.split
            node.left = len(self.nodes)
            for t, m in ((total, n), (node.total - total, node.n - n)):
                self.nodes.append(Node(t, m, measured=m < 2 * config.min_samples_leaf))

    def arrays(self, splits: dict[int, tuple[int, int, int]], value) -> tuple[np.ndarray, ...]:
        """Feature (-1 at leaves), bin, left child and value per node."""
        feature, bin_, left = (np.full(len(self.nodes), -1, np.int32) for _ in range(3))
        for i, (f, b, child) in splits.items():
            feature[i], bin_[i], left[i] = f, b, child
        return feature, bin_, left, np.array([value(node) for node in self.nodes])


def leaf_of(bins: np.ndarray, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node of each row of ``bins`` (rows x features) at which its way down the tree ends."""
    at = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        own = at[rows]
        at[rows] = left[own] + (bins[rows, feature[own]] > bin_[own])
    return at


def best_split(g: np.ndarray, n: np.ndarray, config: BoostConfig) -> tuple[float, int, int, float, int] | None:
    """Of histograms (features x bins) the split of highest gain, the first of equal ones; None if none gains."""
    left, rows = g.cumsum(1), n.cumsum(1)
    right, rest = left[:, -1:] - left, rows[:, -1:] - rows
    l2 = config.l2_regularization
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / (rows + l2) + right**2 / (rest + l2) - left[:, -1:] ** 2 / (rows[:, -1:] + l2)
    gain = np.where((rows >= config.min_samples_leaf) & (rest >= config.min_samples_leaf), gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b), float(left[f, b]), int(rows[f, b])) if gain[f, b] > 0 else None


def _by_fold(batches: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        for fold, rows in pdf.groupby("fold", sort=False):
            yield int(fold), rows, np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), k)


def _added(pred: np.ndarray, bins: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    for feature, bin_, left, value in trees:
        pred = pred + value[leaf_of(bins, feature, bin_, left)]
    return pred


def _measure(rows: DataFrame, k: int, trees: dict, growing: dict, wanted: dict, scale: float, config: BoostConfig) -> list:
    """Sum and best split of the wanted nodes: rows (fold, node, whole, gain, feature, bin, total, n); feature -1 where none gains."""
    places = {fold: {node: i for i, node in enumerate(sorted(nodes))} for fold, nodes in wanted.items()}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for fold, own, bins in _by_fold(batches, k):
            if fold not in places:
                continue
            feature, bin_, left, _ = growing[fold]
            place = np.full(len(feature), -1)
            place[list(places[fold])] = list(places[fold].values())
            at = place[leaf_of(bins, feature, bin_, left)]
            use = at >= 0
            at, bins = at[use], bins[use]
            pred = _added(own["pred"].to_numpy()[use], bins, trees[fold])
            g = np.rint((pred - own["y"].to_numpy()[use]) * scale)
            size = len(places[fold]) * 256
            got = sums.setdefault(fold, np.zeros((2, len(places[fold]), k, 256)))
            for f in range(k):
                cell = at * 256 + bins[:, f]
                got[0, :, f] += np.bincount(cell, g, size).reshape(-1, 256)
                got[1, :, f] += np.bincount(cell, minlength=size).reshape(-1, 256)
        for fold, got in sums.items():
            nodes = list(places[fold])
            yield pd.DataFrame({"fold": fold, "node": nodes, "sums": [got[:, i].tobytes() for i in range(len(nodes))]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        g, n = sum(np.frombuffer(x, np.float64) for x in pdf["sums"]).reshape(2, k, 256)
        found = best_split(g / scale, n, config) or (0.0, -1, -1, 0.0, 0)
        whole = float(g[0].sum() / scale)
        return pd.DataFrame([(pdf["fold"].iloc[0], pdf["node"].iloc[0], whole, *found)], columns=["fold", "node", "whole", "gain", "feature", "bin", "total", "n"])

    partials = rows.mapInPandas(partial, "fold bigint, node int, sums binary")
    return partials.groupBy("fold", "node").applyInPandas(
        best, "fold bigint, node int, whole double, gain double, feature int, bin int, total double, n bigint").collect()


def fit_folds(rows: DataFrame, k: int, stats: dict[int, tuple[int, float, float]], config: BoostConfig) -> dict[int, list[tuple]]:
    """Trees of every fold. ``rows``: stored (fold, y, bins binary of ``k`` bytes); ``stats``: rows, mean and largest |y| per fold."""
    most = max(n for n, _, _ in stats.values())
    reach = max(max(abs(mean) + top for _, mean, top in stats.values()), 1e-300) * 4.0
    scale = 2.0 ** math.floor(52 - math.log2(most * reach))
    starts = {fold: mean for fold, (_, mean, _) in stats.items()}
    columns = "fold bigint, y double, bins binary, pred double"

    def with_pred(table: DataFrame, trees: dict | None) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for fold, own, bins in _by_fold(batches, k):
                pred = np.full(len(own), starts[fold]) if trees is None else _added(own["pred"].to_numpy(), bins, trees[fold])
                yield own[["fold", "y", "bins"]].assign(pred=pred)

        return interim(table.mapInPandas(run, columns))

    rows = with_pred(rows, None)
    fitted: dict[int, list[tuple]] = {fold: [] for fold in stats}
    recent: dict[int, list[tuple]] = {fold: [] for fold in stats}
    for turn in range(config.max_iter):
        growing = {fold: Tree([Node(0.0, n)]) for fold, (n, _, _) in stats.items()}
        done: dict[int, dict] = {}
        while len(done) < len(growing):
            wanted, shapes = {}, {}
            for fold, tree in growing.items():
                if fold in done:
                    continue
                splits, ask, ready = tree.grow(config)
                if ready:
                    done[fold] = splits
                    continue
                # Nodes measured ahead hang on their parents' splits, made or not.
                parts = {i: (x.split[1], x.split[2], x.left) for i, x in enumerate(tree.nodes) if x.left >= 0}
                wanted[fold], shapes[fold] = ask, tree.arrays(parts, lambda _: 0.0)
            if not wanted:
                break
            for r in _measure(rows, k, recent, shapes, wanted, scale, config):
                node = growing[r.fold].nodes[r.node]
                node.total, node.measured = r.whole, True
                node.split = None if r.feature < 0 else (r.gain, r.feature, r.bin, r.total, r.n)
        for fold, tree in growing.items():
            value = lambda x: -config.learning_rate * x.total / (x.n + config.l2_regularization)
            if done[fold]:
                made = tree.arrays(done[fold], value)
                fitted[fold].append(made)
                recent[fold].append(made)
        if (turn + 1) % config.stored_every == 0 and turn + 1 < config.max_iter:
            rows = with_pred(rows, recent)
            recent = {fold: [] for fold in stats}
    return fitted


def boosted_oos(df: DataFrame, features: Sequence[str], target: str, folds: PurgedFolds, n_dates: int, config: BoostConfig = BoostConfig()) -> DataFrame:
    """Out-of-sample predictions of a stored panel with ``date_idx``: ``df`` with ``fold`` and ``prediction``.

    Folds with too few training rows and rows without all features get no prediction. Bin edges are quantiles of each
    fold's training rows (a sketch above some ten thousand rows). A row is stored once per fold that trains on it, as one
    byte per feature: trees of different folds leave different residuals.
    """
    names, k, day, total = list(features), len(features), F.col("date_idx"), folds.count(n_dates)
    clean = [finite(f).alias(f"_x{i}") for i, f in enumerate(names)]
    usable = known(names) & finite(target).isNotNull()
    train = df.where(usable).select(F.explode(folds.train_folds(day, total)).alias("fold"), finite(target).alias("y"), *clean)
    nothing = df.select("*", folds.test_fold(day, total).alias("fold"), F.lit(None).cast("double").alias("prediction"))
    quantiles = [float(q) for q in np.linspace(0, 1, config.max_bins + 1)[1:-1]]
    edges_of = [F.percentile_approx(f"_x{i}", quantiles, 10_000).alias(f"e{i}") for i in range(k)]
    exact = F.sum(F.col("y").cast("decimal(38,18)")).cast("double") / F.count("y")  # the same in any order
    per_fold = train.groupBy("fold").agg(F.count("y").alias("n"), exact.alias("mean"), F.max(F.abs("y")).alias("top"), *edges_of)
    sized = interim(per_fold.where(F.col("n") >= MIN_TRAIN_ROWS))
    usual = [r.fold for r in sized.select("fold").orderBy("fold").collect()]
    out, xs = [], [f"_x{i}" for i in range(k)]
    for at in range(0, len(usual), config.fold_group):
        group = usual[at:at + config.fold_group]
        rows = sized.where(F.col("fold").isin(group)).collect()
        stats = {r.fold: (r.n, r.mean, r.top) for r in rows}
        edges = {r.fold: [np.unique(r[f"e{i}"]) for i in range(k)] for r in rows}

        def binned(own: pd.DataFrame, fold: int, edges=edges) -> np.ndarray:
            return np.stack([np.searchsorted(e, own[x].to_numpy(np.float64), "left") for e, x in zip(edges[fold], xs)], axis=1).astype(np.uint8)

        def pack(batches: Iterator[pd.DataFrame], binned=binned) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, own in pdf.groupby("fold", sort=False):
                    yield pd.DataFrame({"fold": fold, "y": own["y"].to_numpy(), "bins": [x.tobytes() for x in binned(own, int(fold))]})

        packed = train.where(F.col("fold").isin(group)).mapInPandas(pack, "fold bigint, y double, bins binary")
        tasks = math.ceil(sum(n for n, _, _ in stats.values()) / config.task_rows)
        packed = interim(packed.repartitionByRange(tasks, "fold", "y") if tasks > 1 else packed.coalesce(1))
        trees = fit_folds(packed, k, stats, config)
        starts = {fold: mean for fold, (_, mean, _) in stats.items()}

        def score(batches: Iterator[pd.DataFrame], binned=binned, trees=trees, starts=starts) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                parts = [own.assign(prediction=_added(np.full(len(own), starts[int(fold)]), binned(own, int(fold)), trees[int(fold)]))
                         for fold, own in pdf.groupby("fold", sort=False)]
                yield pd.concat(parts).drop(columns=xs)

        test = nothing.where(F.col("fold").isin(group) & known(names)).drop("prediction").select("*", *clean)
        out.append(test.mapInPandas(score, nothing.schema))
    rest = F.col("fold").isNull() | ~F.col("fold").isin(usual) | ~known(names)
    unscored = nothing.where(rest).withColumn("fold", F.lit(None).cast("bigint"))
    return reduce(DataFrame.unionByName, out, unscored)
