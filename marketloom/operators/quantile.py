"""Exact quantiles without collecting a group.

Each pass counts the values of a group in equal-width bins (map-side combined, a bounded number of rows
per group), keeps the bin that holds the wanted rank and repeats inside it; the last pass counts the
distinct values that are left. Binning is monotone in floating point, so ranks stay exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .series import join_keys

BINS = 4096


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, passes: int = 2) -> DataFrame:
    """Linear-interpolated ``q`` quantile of ``value`` per group: one row of ``keys, out`` each."""
    if not keys:
        raise ValueError("a quantile needs group keys")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    target = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).select(
        *keys, "_lo", "_hi",
        F.floor(q * (F.col("_n") - 1)).alias("_k"),
        (q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1))).alias("_frac"),
    )
    done, level = [], 0
    while True:
        # One row per group; cutting here keeps every pass a single scan of the rows.
        picked = cut(_pick(rows, target, keys, distinct=level >= passes))
        done.append(picked.where(F.col("_b").isNotNull()).select(*keys, "_a", "_b", "_frac"))
        target = picked.where(F.col("_b").isNull()).select(*keys, "_lo", "_hi", "_k", "_frac")
        level += 1
        if target.isEmpty():
            break
    both = reduce(DataFrame.unionByName, done)
    return both.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias(out))


def _pick(rows: DataFrame, target: DataFrame, keys: list[str], distinct: bool) -> DataFrame:
    """The bin that holds rank ``_k``; ``_a``/``_b`` are ranks k and k+1 once they are certain."""
    joined = join_keys(rows, target, keys)
    inside = joined.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    width = F.col("_hi") - F.col("_lo")
    scaled = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width) * BINS)
    bin_no = F.col("_v") if distinct else F.least(F.lit(BINS - 1), F.coalesce(scaled, F.lit(0)))
    hist = (
        inside.withColumn("_bin", bin_no)
        .groupBy(*keys, "_bin")
        .agg(
            F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.first("_k").alias("_k"), F.first("_frac").alias("_frac"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("_bin")
    ranked = hist.withColumn("_upto", F.sum("_n").over(w)).withColumn("_next", F.lead("_min").over(w))
    hit = ranked.where((F.col("_k") >= F.col("_upto") - F.col("_n")) & (F.col("_k") < F.col("_upto")))
    last_in_bin = F.col("_k") == F.col("_upto") - 1
    flat = F.col("_min") == F.col("_max")
    return hit.select(
        *keys,
        F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
        F.when(last_in_bin, F.col("_max")).otherwise(F.col("_min")).alias("_a"),
        F.when(last_in_bin, F.coalesce("_next", "_max")).when(flat, F.col("_min")).alias("_b"),
        (F.col("_k") - (F.col("_upto") - F.col("_n"))).alias("_k"),
        "_frac",
    )
