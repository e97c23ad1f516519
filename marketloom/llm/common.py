"""Small pieces that several of these operators use."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import interim

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(c: str, divisor: int) -> Column:
    """Remainder of the crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % divisor


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator works on, so that extra columns can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def put_back(df: DataFrame, chosen: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``chosen`` (null keys match null keys), in ``df``'s own columns."""
    marks = [f"__key_{i}" for i in range(len(keys))]
    left = df.withColumns({m: c for m, (_, c) in zip(marks, keys)})
    right = chosen.select(*[F.col(name).alias(f"{m}_r") for m, (name, _) in zip(marks, keys)])
    same = F.lit(True)
    for m in marks:
        same = same & left[m].eqNullSafe(right[f"{m}_r"])
    return left.join(right, same, "left_semi").drop(*marks)


def own_texts(texts: pa.Array) -> pa.Array:
    """Texts with null as empty, in buffers of their own: Arrow's ascii_lower misreads slices of large strings."""
    kind = pa.large_string()
    return pa.concat_arrays([pa.array([], kind), pc.fill_null(texts.cast(kind), "")])


def forget(stored: DataFrame) -> None:
    """Delete the files of an interim table that no later result reads."""
    jvm, conf = stored.sparkSession._jvm, stored.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts are at most ``most`` bytes together, or one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        done = sizes[at - 1] if at else 0
        n = max(1, int(np.searchsorted(sizes, done + most, "right")) - at)
        yield b.slice(at, n)
        at += n


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b long): columns node, root (the smallest node).

    Large-star and small-star steps alternate until no edge changes; each step is written to the shared
    folder, so a lost executor costs one step. A hub is met as a grouped minimum and a join, never as a list.
    """
    spark = edges.sparkSession
    now = interim(_clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    if now.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    seen = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _clean(both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = interim(large)
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = interim(_clean(small))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return interim(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def integer_vectors(df: DataFrame, vector_col: str, scale: int, largest: float, *columns: str) -> tuple[DataFrame, int]:
    """Stored rows (``columns``, v array<long>) with floor(scale * x) of each component, and the length of v.

    Rows whose vector is null or holds null or non-finite components are left out, and so are those whose integers'
    squares add up to ``largest`` or more. Shorter vectors get zeros at their end, up to the longest.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * float(scale)))
    squares = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * float(scale)).cast("double"), 2))
    small = F.forall(x, lambda c: F.abs(c) * float(scale) < 2.0**62)
    kept = df.where(whole).where(small).where(squares < largest)
    kept = interim(kept.select(*[F.col(f"`{c}`") for c in columns], scaled.alias("__v")))
    length = kept.agg(F.coalesce(F.max(F.size("__v")), F.lit(0))).first()[0]
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("__v"))
    return kept.select(*columns, F.concat("__v", zeros).alias("v")), length


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column whose lists are all ``width`` long."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), width)
