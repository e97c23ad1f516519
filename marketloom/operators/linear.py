"""Linear models for all folds at once.

Training rows shrink to one Gram row (sums of products) per fold by an ordinary aggregate; each Gram row
is solved on its own in a vectorised Arrow function. Expanding folds add up Gram segments, sliding folds merge centred
ones; no row is copied into the folds that train on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import finite
from ..session import interim
from .folds import ExpandingFolds, PurgedFolds, with_date_numbers
from .series import BLOCK, ROW, SeriesLayout, index_rows, running_sum

MIN_TRAIN_ROWS = 10
BROADCAST_NUMBERS = 1_000_000


def typical(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """One value per column near its mean: the mean over all rows, by one small aggregate."""
    row = df.agg(*[F.avg(finite(x)).alias(f"_{i}") for i, x in enumerate(columns)]).first()
    return {x: float(row[i] or 0.0) for i, x in enumerate(columns)}


def gram_columns(features: Sequence[str], target: str, shift: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Row-wise terms whose sums are all a linear model needs.

    ``shift`` is taken off every column first. The solution does not depend on it, but a shift near the mean keeps
    the digits that large values would lose in sums of squares.
    """
    shift = shift or {}
    x = [F.col(f).cast("double") - float(shift.get(f, 0.0)) for f in features]
    y = F.col(target).cast("double") - float(shift.get(target, 0.0))
    terms = {"n": F.lit(1.0), "y": y, "yy": y * y}
    for i, a in enumerate(x):
        terms[f"x{i}"] = a
        terms[f"xy{i}"] = a * y
        for j in range(i, len(x)):
            terms[f"x{i}x{j}"] = a * x[j]
    return terms


def _packed(names: Sequence[str], prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}{n}") for n in names])


def _standardised(sums: np.ndarray, names: list[str], p: int):
    """Correlation form of one Gram row: scaled X'X and X'y, column means and deviations, mean of y."""
    value = dict(zip(names, sums))
    n, ybar = value["n"], value["y"] / value["n"]
    mean = np.array([value[f"x{i}"] for i in range(p)]) / n
    cov = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = value[f"x{i}x{j}"] - n * mean[i] * mean[j]
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0) / n)
    sd = np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(mean)), 1.0, sd)  # constant feature: leave its scale
    xy = np.array([value[f"xy{i}"] for i in range(p)]) - n * mean * ybar
    return cov / np.outer(sd, sd), xy / sd, mean, sd, ybar, n


def _unscale(beta: np.ndarray, mean: np.ndarray, sd: np.ndarray, ybar: float) -> list[float]:
    """Value at the means, slopes, means: the intercept is never multiplied out, which would cost digits again."""
    slope = beta / sd
    return [float(ybar), *map(float, slope), *map(float, mean)]


def ridge_solver(names: list[str], p: int, alpha: float):
    def solve(sums: np.ndarray) -> list[float]:
        xx, xy, mean, sd, ybar, _ = _standardised(sums, names, p)
        return _unscale(np.linalg.solve(xx + alpha * np.eye(p), xy), mean, sd, ybar)

    return solve


def elastic_net_solver(names: list[str], p: int, alpha: float, l1_ratio: float, max_iter: int = 5000, tol: float = 1e-10):
    """Coordinate descent on the Gram matrix of standardised features."""

    def solve(sums: np.ndarray) -> list[float]:
        xx, xy, mean, sd, ybar, n = _standardised(sums, names, p)
        beta, l1, l2 = np.zeros(p), alpha * l1_ratio * n, alpha * (1.0 - l1_ratio) * n
        for _ in range(max_iter):
            worst = 0.0
            for j in range(p):
                rho = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2)
                worst, beta[j] = max(worst, abs(new - beta[j])), new
            if worst < tol:
                break
        else:
            raise ValueError(f"elastic net has not settled after {max_iter} rounds: the last step was {worst:.3g}")
        return _unscale(beta, mean, sd, ybar)

    return solve


def solve_grams(grams: DataFrame, solver, gram: str = "gram", out: str = "coef") -> DataFrame:
    """Replace the Gram array by ``[value at the means, slopes..., means...]`` of the shifted columns."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fit(column: pd.Series) -> pd.Series:
        return pd.Series([solver(np.asarray(g, dtype=float)) for g in column])

    return grams.withColumn(out, fit(gram)).drop(gram)


def linear_prediction(features: Sequence[str], coef: str = "coef", shift: Mapping[str, float] | None = None, target: str = "") -> Column:
    shift, p = shift or {}, len(features)
    value = F.col(coef)[0] + float(shift.get(target, 0.0))
    for i, f in enumerate(features):
        value = value + F.col(coef)[i + 1] * (F.col(f) - float(shift.get(f, 0.0)) - F.col(coef)[i + 1 + p])
    return value


def known(features: Sequence[str]) -> Column:
    cond = F.lit(True)
    for f in features:
        cond = cond & finite(f).isNotNull()
    return cond


def model_solver(model: str, params: dict, features: Sequence[str], target: str):
    """Solver of a linear model by name; unknown names and parameters are refused."""
    names, p = list(gram_columns(features, target)), len(features)
    params = dict(params)
    if model == "ridge":
        alpha = float(params.pop("alpha", 1.0))
        solver = ridge_solver(names, p, alpha)
    elif model == "elastic_net":
        solver = elastic_net_solver(
            names, p, float(params.pop("alpha", 0.001)), float(params.pop("l1_ratio", 0.25)), int(params.pop("max_iter", 5000))
        )
        params.pop("random_state", None)
    else:
        raise ValueError(f"unsupported model_type: {model}")
    if params:
        raise ValueError(f"unsupported {model} params: {sorted(params)}")
    return solver


def purged_oos(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    folds: PurgedFolds,
    n_dates: int,
    model: str = "ridge",
    params: dict | None = None,
) -> DataFrame:
    """Out-of-sample predictions of a panel that carries ``date_idx``; rows outside tests get NULL.

    Adds ``fold`` and ``prediction``. Rows that train the same folds are summed once, about their own means, so values far
    from zero and drifting columns keep their digits; a fold merges its segments, of which there are twice train over
    step at most.
    """
    total = folds.count(n_dates)
    solver = model_solver(model, params or {}, features, target)
    columns, part = [*features, target], ["_low", "_high"]
    low, high = folds.train_range(F.col("date_idx"), total)
    usable = df.where(known(columns)).withColumns({"_low": low, "_high": high}).where("_low <= _high")
    near = interim(usable.groupBy(*part).agg(*[F.avg(x).alias(f"_m_{i}") for i, x in enumerate(columns)]))
    if 2 * total * (len(columns) + 2) <= BROADCAST_NUMBERS:  # two rows per fold at most
        near = F.broadcast(near)
    means = [f"_m_{i}" for i in range(len(columns))]
    apart = usable.join(near, part).withColumns({f"_d_{i}": F.col(x).cast("double") - F.col(means[i]) for i, x in enumerate(columns)})
    terms = gram_columns([f"_d_{i}" for i in range(len(features))], f"_d_{len(features)}")
    segments = apart.groupBy(*part).agg(
        *[F.sum(v).alias(f"_g_{k}") for k, v in terms.items()], *[F.first(m).alias(m) for m in means]
    )
    row = F.array(*[F.col(x).cast("double") for x in (*part, *[f"_g_{k}" for k in terms], *means)])
    grams = (
        segments.select(F.explode(F.sequence(*part)).alias("fold"), "_g_n", row.alias("_row"))
        .groupBy("fold").agg(F.sum("_g_n").alias("_n"), F.flatten(F.sort_array(F.collect_list("_row"))).alias("gram"))
        .where(F.col("_n") >= MIN_TRAIN_ROWS).drop("_n")
    )
    coefs = solve_grams(grams, merged_solver(solver, list(terms), len(features)))
    if total * (len(features) + 2) <= BROADCAST_NUMBERS:  # one row per fold: the size is known here
        coefs = F.broadcast(coefs)
    tagged = df.withColumn("fold", F.when(known(features), folds.test_fold(F.col("date_idx"), total)))
    out = tagged.join(coefs, "fold", "left").withColumn("prediction", linear_prediction(features))
    return out.withColumn("fold", F.when(F.col("coef").isNotNull(), F.col("fold"))).drop("coef")


def merged_solver(solver, names: list[str], p: int):
    """Solve a fold from its segments: each a row of two bounds, sums about a point, and that point.

    Means and central moments are merged pairwise, in the order of the segments.
    """
    width = 2 + len(names) + p + 1

    def solve(flat: np.ndarray) -> list[float]:
        n, mean, moments = 0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
        for row in flat.reshape(-1, width):
            value, point = dict(zip(names, row[2:])), row[2 + len(names):]
            m = value["n"]
            off = np.array([*[value[f"x{i}"] for i in range(p)], value["y"]]) / m
            own = np.empty((p + 1, p + 1))
            for i in range(p):
                own[i, p] = own[p, i] = value[f"xy{i}"]
                for j in range(i, p):
                    own[i, j] = own[j, i] = value[f"x{i}x{j}"]
            own[p, p] = value["yy"]
            gap = point + off - mean
            moments += own - m * np.outer(off, off) + np.outer(gap, gap) * (n * m / (n + m))
            mean += gap * (m / (n + m))
            n += m
        central = {"n": n, "y": 0.0, "yy": moments[p, p]}
        for i in range(p):
            central[f"x{i}"], central[f"xy{i}"] = 0.0, moments[i, p]
            central.update({f"x{i}x{j}": moments[i, j] for j in range(i, p)})
        level, *slopes_and_means = solver(np.array([central[k] for k in names]))
        slopes, offsets = slopes_and_means[:p], slopes_and_means[p:]
        return [float(level + mean[p]), *slopes, *[float(a + b) for a, b in zip(offsets, mean)]]

    return solve


def walk_forward_ridge(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    layout: SeriesLayout,
    alpha: float = 1.0,
    minimum_rows: int = 170,
    test_size: int = 21,
    embargo: int = 5,
    train_size: int | None = None,
) -> DataFrame:
    """Expanding walk-forward ridge of every series in one job.

    ``df`` holds complete rows only. The first training size follows the series length (half of it, within
    80..126) unless given. Adds ``prediction`` (NULL outside test blocks).
    """
    keys = list(layout.keys)
    shift = typical(df, [*features, target])
    terms = gram_columns(features, target, shift)
    rows = index_rows(df.drop(ROW) if ROW in df.columns else df, layout)
    sizes = rows.groupBy(*keys).agg(F.max(ROW).alias("_n"))
    half = F.greatest(F.lit(80), F.floor(F.col("_n") / 2).cast("int"))
    sizes = sizes.withColumn("_train", F.lit(train_size) if train_size else F.least(F.lit(126), half))
    step = test_size + embargo
    rows = rows.join(sizes, keys).withColumn("_pos", F.col(ROW) - 1)
    late = F.floor((F.col("_pos") - F.col("_train")) / step) + 1
    segment = F.when(F.col("_pos") < F.col("_train"), F.lit(0)).otherwise(late).cast("bigint")
    offset = F.col("_pos") - F.col("_train") - embargo
    fold = F.floor(offset / step)
    whole = F.col("_train") + embargo + fold * step + test_size <= F.col("_n")
    tested = (offset >= 0) & (offset - fold * step < test_size) & whole & (F.col("_n") >= minimum_rows)
    rows = rows.withColumn("fold", F.when(tested, fold).cast("bigint")).withColumn("_segment", segment)
    rows = interim(rows)  # segments, needed folds and predictions all read the numbered rows

    # One Gram row per training segment, then running sums along the folds. Segments are numbered without
    # gaps, so they are a series of their own and block like any other.
    segments = (
        rows.withColumn("fold", F.col("_segment"))
        .groupBy(*keys, "fold")
        .agg(*[F.sum(v).alias(f"_s_{k}") for k, v in terms.items()])
        .withColumn(ROW, F.col("fold") + 1)
        .withColumn(BLOCK, F.expr(f"fold div {layout.block_rows}"))
    )
    seg_layout = SeriesLayout(tuple(keys), ("fold",), layout.bucket, layout.block_rows)
    summed = running_sum(segments, seg_layout, {f"_g_{k}": f"_s_{k}" for k in terms})
    grams = summed.select(*keys, "fold", _packed(list(terms), "_g_").alias("gram"))
    needed = rows.where(F.col("fold").isNotNull()).select(*keys, "fold").distinct()
    coefs = solve_grams(grams.join(needed, [*keys, "fold"], "left_semi"), ridge_solver(list(terms), len(features), alpha))
    # Rows outside tests get distinct stand-in folds, so they do not pile up on one NULL join key.
    spread = rows.withColumn("_fold", F.coalesce("fold", -F.col(ROW)))
    out = spread.join(coefs.withColumnRenamed("fold", "_fold"), [*keys, "_fold"], "left")
    predicted = linear_prediction(features, shift=shift, target=target)
    return out.withColumn("prediction", predicted).drop("coef", "_n", "_train", "_pos", "_fold", "_segment")


def coverage(df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    """Share of rows with a prediction, number of folds and of predicted rows."""
    made = F.col(prediction).isNotNull()
    return df.groupBy(*keys).agg(
        F.avg(F.when(made, 1.0).otherwise(0.0)).alias("oos_coverage"),
        F.count_distinct(F.when(made, F.col("fold"))).alias("fold_count"),
        F.count_if(made).alias("oos_samples"),
    )


def information_coefficient(df: DataFrame, prediction: str, outcome: str, keys: Sequence[str]) -> DataFrame:
    """Documented extra: correlation and directional hit rate of predictions, per group (for example regime)."""
    both = F.col(prediction).isNotNull() & F.col(outcome).isNotNull()
    same = F.signum(prediction) == F.signum(outcome)
    return df.where(both).groupBy(*keys).agg(
        F.corr(prediction, outcome).alias("information_coefficient"),
        F.avg(F.when(same, 1.0).otherwise(0.0)).alias("directional_accuracy"),
        F.count(F.lit(1)).alias("samples"),
    )


__all__ = [
    "ExpandingFolds", "PurgedFolds", "coverage", "elastic_net_solver", "gram_columns", "information_coefficient",
    "purged_oos", "ridge_solver", "solve_grams", "walk_forward_ridge", "with_date_numbers",
]
