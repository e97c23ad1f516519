"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks: tasks are keyed by (query block, row block) and hold one of each. A
pass counts each query's scores in equal bins of its current range; the counts of all blocks are added up, and the bin
that holds the k-th highest score becomes the range of the next pass. After the last pass bins are one wide, so each k-th
value is known. A further pass keeps what lies above it, and of its ties the smallest ids, so a crowd of equal rows
never leaves its block. Scores are computed again in each pass instead of being stored: there are rows x queries of them.

A block sends no bins below the one in which its own k-th highest score lies, for the k-th of all can't be lower.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import integer_vectors, matrix
from marketloom.session import interim

#: Squares of a vector's integers stay below this, so every inner product fits a long.
LARGEST = 2.0**62


@dataclass(frozen=True)
class TopKSettings:
    k: int = 5
    every: int = 50  # ids divisible by this are queries
    scale: int = 256
    bins: int = 512  # of a histogram
    row_block: int = 4096
    query_block: int = 4096


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False).astype(np.int64)


def _scores(queries: pa.Table, rows: pa.Table, length: int, exact: bool):
    """(first query, scores, own) of some queries at a time; own marks the rows that share a query's id."""
    q = matrix(_column(queries, "v"), length)
    r = matrix(_column(rows, "v"), length)
    ids = _column(rows, "vec_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids, own_ids = ids.fill_null(0).to_numpy(zero_copy_only=False), _numbers(queries, "vec_id")
    kind = np.float64 if exact else np.int64  # sums below 2^53 are exact in both, and doubles are faster
    right = r.T.astype(kind)
    step = max(1, (2 << 20) // max(len(r), 1))
    for at in range(0, len(q), step):
        s = (q[at:at + step].astype(kind) @ right).astype(np.int64)
        yield at, s, (ids[None, :] == own_ids[at:at + step, None]) & known[None, :]


def _count(queries: pa.Table, rows: pa.Table, length: int, exact: bool, width: int, k: int, bins: int) -> pa.Table:
    low = _numbers(queries, "low")
    out = []
    for at, s, own in _scores(queries, rows, length, exact):
        n = len(s)
        bin_ = (s - low[at:at + n, None]) // width
        inside = (bin_ >= 0) & (bin_ < bins) & ~own
        row, col = np.nonzero(inside)
        counts = np.bincount(row * bins + bin_[row, col], minlength=n * bins).reshape(n, bins)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        i, b = np.nonzero((counts > 0) & (above < k))
        out.append((i + at, b, counts[i, b]))
    i, b, c = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))
    return pa.table({"query": _numbers(queries, "query")[i], "bin": b.astype(np.int64), "n": c.astype(np.int64)})


def _keep(queries: pa.Table, rows: pa.Table, length: int, exact: bool, k: int) -> pa.Table:
    low, above = _numbers(queries, "low"), _numbers(queries, "above")
    ids = _column(rows, "vec_id")
    order = np.argsort(ids.fill_null(0).to_numpy(zero_copy_only=False), kind="stable")
    nulls = ids.is_null().to_numpy(zero_copy_only=False)[order]
    order = np.concatenate([order[~nulls], order[nulls]])  # smallest ids first, null ids last
    query, vec, score = [], [], []
    for at, s, own in _scores(queries, rows, length, exact):
        s, own, n = s[:, order], own[:, order], len(s)
        least = low[at:at + n, None]
        tie = (s == least) & ~own
        tie &= tie.cumsum(1) <= k - above[at:at + n, None]
        i, j = np.nonzero(tie | ((s > least) & ~own))
        query.append(i + at), vec.append(order[j]), score.append(s[i, j])
    i, j, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, vec, score))
    return pa.table({
        "query": _numbers(queries, "query")[i], "query_id": _numbers(queries, "vec_id")[i], "vec_id": ids.take(pa.array(j, pa.int64())), "score": s,
    })


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: TopKSettings = TopKSettings()) -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank, vec_id, score; ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; rows with the query's id are its own and no answers. Rows
    that repeat an id are queries each, with ranks of their own, and answers each; rows with a null id are answers, after
    all ids at ties, and never queries. Vectors that are null, hold null or non-finite components, or whose integers'
    squares add up to 2^62 or more take no part; shorter ones count as padded with zeros. A query with fewer than k other
    rows lists them all. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    s = settings
    chosen = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("x"))
    rows, length = integer_vectors(chosen, "x", s.scale, LARGEST, "vec_id")
    # Rows are numbered as the stored table is scanned, so a task that runs again gives the same numbers.
    queries = interim(rows.where(F.col("vec_id") % s.every == 0).withColumn("query", F.monotonically_increasing_id()))
    squares = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    n, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(squares), F.lit(0))).first()
    most, exact = int(most), int(most) < 2**53
    row_blocks, query_blocks = max(1, ceil(n / s.row_block)), max(1, ceil(queries.count() / s.query_block))
    tasks = min(row_blocks * query_blocks, 10_000)

    def dealt(df: DataFrame, number, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        df = df.select("*", F.pmod(number, F.lit(own_blocks)).cast("int").alias(own)).select("*", every.alias(other))
        return df.repartition(tasks, "rb", "qb").groupBy("rb", "qb")

    def met(state: DataFrame, work, schema: str) -> DataFrame:
        asked = dealt(queries.join(state, "query"), F.xxhash64("query"), "qb", query_blocks, "rb", row_blocks)
        return asked.cogroup(dealt(rows, F.monotonically_increasing_id(), "rb", row_blocks, "qb", query_blocks)).applyInArrow(work, schema)

    # By Cauchy and Schwarz scores lie in [-most, most].
    width = 1
    while width * s.bins < 2 * most + 1:
        width *= s.bins
    def counting(width: int):
        return lambda q, r: _count(q, r, length, exact, width, s.k, s.bins)

    state = queries.select("query", F.lit(-most).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    while True:
        counts = met(state, counting(width), "query long, bin long, n long")
        counts = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        # The highest bin with which the scores seen reach k; the lowest bin with scores where there are fewer.
        found = (
            counts.join(state, "query").withColumn("upto", F.col("above") + F.sum("n").over(down))
            .where(F.col("upto") - F.col("n") < s.k)
            .groupBy("query").agg(F.min_by(F.struct("low", "bin", "upto", "n"), "bin").alias("b"))
            .select("query", (F.col("b.low") + F.col("b.bin") * width).alias("low"), (F.col("b.upto") - F.col("b.n")).alias("above"))
        )
        state = interim(found)
        if width == 1:
            break
        width //= s.bins
    kept = met(state, lambda q, r: _keep(q, r, length, exact, s.k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
