"""Models by name: linear ones and boosted trees for all folds at once, forests and own estimators by Spark ML fold by fold."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..session import interim, shared_dir
from .boosting import BoostConfig, boosted_oos
from .folds import PurgedFolds
from .linear import MIN_TRAIN_ROWS, known, purged_oos

LINEAR = ("ridge", "elastic_net")
FORESTS = ("random_forest",)
BOOSTED = ("hist_gb", "hist_gradient_boosting")


@dataclass(frozen=True)
class ModelConfig:
    """A model by name, or any Spark ML regressor: ``estimator()`` makes one, and its columns are set here."""

    name: str
    params: Mapping[str, Any] = field(default_factory=dict)
    seed: int = 7
    estimator: Callable[[], Estimator] | None = None

    def __post_init__(self) -> None:
        if self.estimator is None and self.name not in (*LINEAR, *FORESTS, *BOOSTED):
            raise ValueError(f"unsupported model_type: {self.name}")


def tree_estimator(config: ModelConfig, label: str) -> Estimator:
    """Spark ML estimator of a tree model. Parameter names follow the model's own vocabulary. Histogram boosting by Spark ML
    has no leaf cap or L2 term; :func:`train_oos` fits it by :mod:`boosting`, which has both."""
    given = dict(config.params)
    if config.estimator is not None:
        return config.estimator().setParams(featuresCol="_x", labelCol=label, predictionCol="_p", **given)
    if config.name in FORESTS:
        est = RandomForestRegressor(
            featuresCol="_x", labelCol=label, predictionCol="_p", seed=config.seed, featureSubsetStrategy="all",
            numTrees=int(given.pop("n_estimators", 120)), maxDepth=int(given.pop("max_depth", 8)),
            minInstancesPerNode=int(given.pop("min_samples_leaf", 4)),
        )
    elif config.name in BOOSTED:
        leaves = int(given.pop("max_leaf_nodes", 15))
        est = GBTRegressor(
            featuresCol="_x", labelCol=label, predictionCol="_p", seed=config.seed,
            stepSize=float(given.pop("learning_rate", 0.05)), maxIter=int(given.pop("max_iter", 150)),
            maxDepth=max(1, (leaves - 1).bit_length()), minInstancesPerNode=20,
        )
        if given.pop("l2_regularization", 0.0):
            raise ValueError(f"unsupported {config.name} params: Spark ML boosting has no L2 term")
    else:
        raise ValueError(f"unsupported model_type: {config.name}")
    if given:
        raise ValueError(f"unsupported {config.name} params: {sorted(given)}")
    return est


def tree_oos(
    df: DataFrame, features: Sequence[str], target: str, folds: PurgedFolds, n_dates: int, config: ModelConfig, parallel: int = 4
) -> DataFrame:
    """Out-of-sample predictions of a panel with ``date_idx``: one distributed fit per fold, ``parallel`` at a time.

    One aggregate tells which folds have enough rows. Predictions of a fold are written to its folder of one table, so the
    plan does not grow with the folds. ``df`` should be stored; every fold reads its own dates.
    """
    spark, total, day = df.sparkSession, folds.count(n_dates), F.col("date_idx")
    usable = known(features) & finite(target).isNotNull()
    trained = df.where(usable).select(F.explode(folds.train_folds(day, total)).alias("fold"), F.lit(1).alias("train"))
    tested = df.where(known(features)).select(folds.test_fold(day, total).alias("fold"), F.lit(0).alias("train"))
    sizes = {
        row["fold"]: (row["train"], row["n"] - row["train"])
        for row in trained.unionByName(tested).where("fold IS NOT NULL").groupBy("fold").agg(
            F.sum("train").alias("train"), F.count(F.lit(1)).alias("n")).collect()  # one row per fold
    }
    fitted = [k for k, (train, test) in sorted(sizes.items()) if train >= MIN_TRAIN_ROWS and test]
    nothing = df.select("*", F.lit(None).cast("bigint").alias("fold"), F.lit(None).cast("double").alias("prediction"))
    if not fitted:
        return nothing
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(
        df.withColumns({f: finite(f) for f in features})
    )
    base = f"{shared_dir(spark).rstrip('/')}/folds/{uuid.uuid4().hex}"

    def one(k: int) -> None:
        start, first_test = k * folds.step, folds.first_test + k * folds.step
        train = assembled.where((day >= start) & (day < start + folds.train_periods) & usable)
        test = assembled.where(day.between(first_test, first_test + folds.test_periods - 1) & known(features))
        scored = tree_estimator(config, target).fit(train).transform(test)
        scored.select(*df.columns, F.lit(k).cast("bigint").alias("fold"), F.col("_p").cast("double").alias("prediction")).write.parquet(f"{base}/k={k}")

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(one, fitted))
    predicted = spark.read.schema(nothing.schema).parquet(*[f"{base}/k={k}" for k in fitted])
    skipped = sorted(set(sizes) - set(fitted))
    fold = folds.test_fold(day, total)
    return predicted.unionByName(nothing.where(fold.isNull() | fold.isin(skipped) | ~known(features)))


def train_oos(
    df: DataFrame, features: Sequence[str], target: str, folds: PurgedFolds, n_dates: int, config: ModelConfig
) -> DataFrame:
    """Dispatch by model name; non-finite predictions fail the job."""
    if config.estimator is None and config.name in LINEAR:
        out = purged_oos(df, features, target, folds, n_dates, config.name, dict(config.params))
    elif config.estimator is None and config.name in BOOSTED:
        out = boosted_oos(interim(df), features, target, folds, n_dates, BoostConfig.of(dict(config.params)))
    else:
        out = tree_oos(interim(df), features, target, folds, n_dates, config)
    bad = F.col("prediction").isNotNull() & finite("prediction").isNull()
    error = F.raise_error(F.lit("model produced non-finite out-of-sample predictions")).cast("double")
    return out.withColumn("prediction", F.when(bad, error).otherwise(F.col("prediction")))
