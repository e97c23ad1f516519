"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Each source takes all its documents a whole number of times, and then those whose hash is below a threshold. The
threshold is found from histograms of words by (source, hash digits): the running sum names the digit in which the
budget ends, and only that bucket is counted again by the next digits. Documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import word_count
from marketloom.session import interim

WEIGHTS = (5, 2, 1)
MOST = 3
HASH_BITS, DIGIT_BITS = 60, 12


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, size in words and a 60-bit hash of the id; stored, since every round reads it."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10)
    return interim(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), hashed.cast("long").alias("h"),
    ))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_size, weight, target (double) and the whole words of it (long).

    The table has one row per source name, so its windows see a few dozen bytes per source. Sources are taken in
    code point order (null last) for the weights and in order of size per weight for the limit: the sources that
    meet it are the first ones in that order, and the rest share what is left by weight.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    left_words = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    held = most * F.col("source_size") * left_weight <= F.col("weight") * left_words
    sources = sources.select("*", held.alias("held"), total.alias("total"))
    rest_words = F.col("total") - most * F.sum(F.when(F.col("held"), F.col("source_size")).otherwise(0)).over(every)
    rest_weight = F.sum(F.when(F.col("held"), F.lit(0)).otherwise(F.col("weight"))).over(every)
    sources = sources.select("*", rest_words.alias("rest_words"), rest_weight.alias("rest_weight"))
    limit = most * F.col("source_size")
    return sources.select(
        "source", "source_size", "weight",
        F.when(F.col("held"), limit.cast("double"))
        .otherwise((F.col("weight") * F.col("rest_words")).cast("double") / F.col("rest_weight").cast("double")).alias("target"),
        F.when(F.col("held"), limit).otherwise(F.expr("(weight * rest_words) div nullif(rest_weight, 0)")).alias("words"),
    )


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source with a budget below its size: the hash at which it ends, the words left there, the words there."""
    state = interim(
        plan.where("source_size > 0").select(
            F.col("source").alias("s"), (F.col("words") % F.col("source_size")).alias("budget"),
            F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("there"),
        ).where("budget > 0")
    )
    running = Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = rows.where("size > 0").join(
            state, rows.source.eqNullSafe(state.s) & (F.shiftright(rows.h, shift + DIGIT_BITS) == state.path))
        bins = inside.groupBy("s", F.shiftright("h", shift).alias("digit")).agg(
            F.sum("size").cast("long").alias("words"), F.first("budget").alias("budget"))
        bins = bins.withColumn("upto", F.sum("words").over(running))
        state = interim(bins.where("upto - words < budget AND budget <= upto").select(
            "s", (F.col("budget") - F.col("upto") + F.col("words")).cast("long").alias("budget"),
            F.col("digit").alias("path"), F.col("words").alias("there")))
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``taken`` is the whole words of the document times its repeats, and for the one document in which its
    source's budget ends the words up to that end, so each source meets its target to the word. Rows that share
    an id share a hash; if the budget ends among them, each takes its part by size. A null text has no words, a
    null source is a source of its own, an empty table gives no rows.
    """
    rows = sized(docs, id_col, text_col, source_col)
    plan = interim(targets(rows, weights, most))
    ends = thresholds(rows, plan)
    p = plan.withColumnRenamed("source", "ps")
    joined = rows.join(p, rows.source.eqNullSafe(p.ps)).join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0) * F.col("size")
    extra = (
        F.when(F.col("h") < F.col("path"), F.col("size"))
        .when(F.col("h") == F.col("path"), F.expr("(budget * size) div there")).otherwise(0)
    )
    # without a threshold (no budget beyond whole repeats) path is null and nothing is added
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole + extra)
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
                         F.col("source").alias("mixed_source"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the row in which a budget ends counts as whole
    if at least half of it is taken. Rows without words are in no source's budget and stay once."""
    decided = mix(docs, id_col, text_col, source_col)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    # rows of one id, source and size share hash and answer
    chosen = decided.select(
        F.col("doc_id").alias("__id"), F.col("mixed_source").alias("__source"), F.col("size").alias("__size"),
        times.cast("int").alias("__times")).where("__times > 0").distinct()
    left = docs.withColumn("__words", word_count(F.col(text_col)))
    same = (left[id_col].eqNullSafe(chosen["__id"]) & left[source_col].eqNullSafe(chosen["__source"])
            & (left["__words"] == chosen["__size"]))
    return (
        left.join(chosen, same).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*[left[c] for c in docs.columns])
    )
