"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its characters. Their log-count ratios between toxic and other
training texts scale them, and a logistic regression is fitted on the scaled features. The fit sees a bounded sample
of labelled rows; every text is scored whole, in one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import crc_mod


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20  # 2**bits hashed features; the model is one float for each
    sample: int = 4000  # labelled rows the fit sees, at most; taken by hash of the id
    least: int = 4  # training texts an n-gram must be in
    smooth: float = 1.0
    ridge: float = 3e-4
    rounds: int = 8
    rate: float = 0.15
    chunk: int = 1 << 20  # characters hashed at once


def grams(text: str | None, s: Settings, stamp: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text, unordered. ``stamp`` is scratch space of 2**bits."""
    found = []
    text = " " + (text or "").lower() + " "
    step, widest = s.chunk, max(s.orders)
    for at in range(0, len(text), step):
        codes = np.frombuffer(text[at: at + step + widest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for order in s.orders:
            n = min(len(codes) - order + 1, step)
            if n <= 0:
                continue
            h = np.full(n, order, np.uint32)
            for k in range(order):
                h = (h ^ codes[k: k + n]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append(_distinct(h & np.uint32((1 << s.bits) - 1), stamp))
    if not found:
        return np.empty(0, np.uint32)
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found), stamp)


def _distinct(h: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    order = np.arange(len(h), dtype=stamp.dtype)
    stamp[h] = order
    return h[stamp[h] == order]


def fit(rows: list[tuple[int, np.ndarray]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights by hashed feature and an intercept, from (label, features) rows."""
    size = 1 << s.bits
    y = np.array([r[0] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():  # one class or no labels: the share of toxic rows, smoothed
        p = (y.sum() + s.smooth) / (len(y) + 2 * s.smooth)
        return np.zeros(size, np.float32), float(np.log(p / (1 - p)))
    counts = np.zeros((2, size))
    for label, f in rows:
        counts[label, f] += 1
    seen = counts.sum(0) >= s.least
    p, q = counts[1] + s.smooth, counts[0] + s.smooth
    ratio = np.where(seen, np.log((p / p[seen].sum()) / (q / q[seen].sum())), 0.0)
    kept = [f[seen[f]] for _, f in rows]
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    b, b2 = float(np.log(y.mean() / (1 - y.mean()))), 1e-8
    random = np.random.default_rng(7)
    for _ in range(s.rounds):
        for i in random.permutation(len(rows)):
            f = kept[i]
            x = ratio[f]
            scale = 1 / np.sqrt(len(f) + 1.0)
            p_i = 1 / (1 + np.exp(-np.clip((w[f] @ x) * scale + b, -30, 30)))
            g = p_i - y[i]
            grad = g * x * scale + s.ridge * w[f]
            g2[f] += grad * grad
            w[f] -= s.rate * grad / np.sqrt(g2[f])
            b2 += g * g
            b -= s.rate * 0.1 * g / np.sqrt(b2)
    return (w * ratio).astype(np.float32), b


def score(features: np.ndarray, weights: np.ndarray, intercept: float, known: np.ndarray) -> float:
    f = features[known[features]]
    return float(1 / (1 + np.exp(-np.clip(weights[f].sum(dtype=np.float64) / np.sqrt(len(f) + 1.0) + intercept, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
          held_out: tuple[int, int] = (4, 2)) -> tuple[np.ndarray, float]:
    """Weights and intercept, fitted on at most ``s.sample`` labelled rows outside the held-out share.

    Rows without id or label are left out; an id labelled more than once counts as toxic if any label says so.
    The chosen ids are a bounded broadcast; the texts are turned into features where they are read, and one task
    fits the bounded sample.
    """
    divisor, remainder = held_out
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod("doc_id", divisor) != remainder)
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(s.sample)
    )
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(1 << s.bits, np.int32)
        for b in batches:
            own = [np.sort(grams(t, s, stamp)).astype("<u4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary())], names=["doc_id", "toxic", "f"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        got.sort()  # the order of arrival differs from run to run
        w, b0 = fit([(t, np.frombuffer(f, "<u4")) for _, t, f in got], s)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([b0])], names=["w", "b"])

    rows = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(
        features, "doc_id long, toxic int, f binary")
    model = rows.repartition(1).mapInArrow(solve, "w binary, b double").first()
    if model is None:
        return fit([], s)
    return np.frombuffer(model["w"], "<f4"), model["b"]


def toxicity_column(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(),
                    text_col: str = "text") -> Column:
    """A column expression with the score of each whole text; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    @F.pandas_udf("double")
    def toxicity_score(texts):
        import pandas as pd

        if not state:
            weights, intercept = sent.value
            state.update(w=weights, b=intercept, known=weights != 0, stamp=np.zeros(1 << s.bits, np.int32))
        return pd.Series([score(grams(t, s, state["stamp"]), state["w"], state["b"], state["known"]) for t in texts])

    return toxicity_score(F.col(text_col).cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Scores come from the text alone.

    Without usable labels, or with one class, every text scores the smoothed share of toxic labels.
    """
    model = train(docs, labels, s, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, 4) == 2).alias("held_out"),
                       toxicity_column(docs, model, s, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    scored = docs.withColumn("__toxicity", toxicity_column(docs, train(docs, labels, s), s))
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")
