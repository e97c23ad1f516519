"""Vector codes: each quarter of a vector is named by the nearest of 256 learned entries, in integers only.

Distances are taken in the Walsh-Hadamard domain. For a part and an entry padded with zeros to a power of two ``s``, the
squared differences of their transforms add up to ``s`` times their squared distance, whatever the order. In order of
sequency (sign changes of the basis row) slow components come first, so that partial sums grow early; an entry whose
partial sum exceeds a whole distance already known is out. All values are integers, so nothing is rounded.

A round is one scan: every task sums the parts of each entry, Spark adds the sums up, and the driver holds the codebook
(entries x length of a vector) and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import integer_vectors, matrix
from marketloom.session import interim

#: Squares of a vector's integers stay below this, so that padded squared distances of up to 32 terms a part fit 64 bits.
LARGEST = 2.0**55


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 4
    entries: int = 256  # of each part's codebook; at most 256, as an index is two hex digits
    rounds: int = 4
    scale: int = 1024


def sequency_order(size: int) -> np.ndarray:
    """Positions of the fast transform's outputs (natural order), by rising number of sign changes."""
    bits = size.bit_length() - 1
    at = np.arange(size)
    turned = np.zeros(size, np.int64)
    for b in range(bits):
        turned |= ((at >> b) & 1) << (bits - 1 - b)
    changes = turned.copy()
    shift = 1
    while shift < size:
        changes ^= changes >> shift
        shift *= 2
    return np.argsort(changes)


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """Transform of each row, padded with zeros to a power of two, in order of sequency."""
    n, length = rows.shape
    size = 1 << max(length - 1, 0).bit_length()
    x = np.zeros((n, size), np.int64)
    x[:, :length] = rows
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x[:, sequency_order(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties to the lower index) and its squared distance."""
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    e = walsh_hadamard(entries)
    size = e.shape[1]
    step = max(1, size // 8)
    for at in range(0, len(rows), 2048):
        t = walsh_hadamard(rows[at:at + 2048])
        partial, bound, done = np.zeros((len(t), len(e)), np.int64), np.full(len(t), np.iinfo(np.int64).max), 0
        alive = np.ones(partial.shape, bool)
        # Whole tables while many entries are left, then the pairs that are left.
        while done < size and alive.mean() > 1 / 8:
            for k in range(done, done + step):
                partial += np.square(t[:, k, None] - e[None, :, k])
            done += step
            bound = np.minimum(bound, np.square(t - e[partial.argmin(1)]).sum(1))
            alive = partial <= bound[:, None]
        row, entry = np.nonzero(alive)
        got = partial[row, entry]
        for k in range(done, size, step):
            got += np.square(t[row, k:k + step] - e[entry, k:k + step]).sum(1)
            stay = got <= bound[row]
            row, entry, got = row[stay], entry[stay], got[stay]
        least = np.minimum.reduceat(got, np.searchsorted(row, np.arange(len(t))))
        hit = np.flatnonzero(got == least[row])  # rows and entries ascend
        _, first_hit = np.unique(row[hit], return_index=True)
        index[at:at + 2048] = entry[hit[first_hit]]
        error[at:at + 2048] = least // size
    return index, error


def _sum_parts(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, length = books.shape
    total, n = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
    for b in batches:
        rows = matrix(b.column(0), parts * length).reshape(b.num_rows, parts, length)
        for p in range(parts):
            index, _ = nearest(rows[:, p], books[p])
            np.add.at(total[p], index, rows[:, p])
            n[p] += np.bincount(index, minlength=entries)
    part, entry, position = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
    yield pa.RecordBatch.from_pydict({
        "part": part, "entry": entry, "position": position, "total": total[part, entry, position], "n": n[part, entry],
    })


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts, _, length = books.shape
    for b in batches:
        rows = matrix(b.column(2), parts * length).reshape(b.num_rows, parts, length)
        found = [nearest(rows[:, p], books[p]) for p in range(parts)]
        code = [row.tobytes().hex() for row in np.stack([i for i, _ in found], axis=1).astype(np.uint8)]
        error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=schema)


def learn_codebooks(vectors: DataFrame, length: int, settings: CodeSettings = CodeSettings()) -> np.ndarray:
    """Codebooks (part, entry, position) from rows (vec_id, v array<long> of ``length``, a multiple of the parts)."""
    s = settings
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(s.entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), s.parts, length // s.parts).transpose(1, 0, 2).copy()
    if not len(first) or not length:
        return books
    for _ in range(s.rounds):
        sums = vectors.select("v").mapInArrow(
            lambda batches, books=books: _sum_parts(batches, books), "part long, entry long, position long, total long, n long")
        total = F.sum(F.col("total").cast("decimal(38,0)"))
        for r in sums.groupBy("part", "entry", "position").agg(total.alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.position] = int(r.total) // r.n
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    settings: CodeSettings = CodeSettings(),
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Left out are vectors that are null, hold null or non-finite components, or whose integers' squares add up to 2^55 or
    more (components beyond about 10^5; with parts of over 32 components to 2^60 / padded length of a part). Shorter vectors, and lengths the parts don't divide, count as padded with zeros.
    First entries follow (id, vector) with null ids last, so rows that repeat an id have an order; fewer rows than entries
    make a smaller codebook. Rows that repeat are coded each. Labels are grouped with nulls together; a sum beyond a long
    is null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    s = settings
    if not 0 < s.entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    rows, length = integer_vectors(chosen, "x", s.scale, LARGEST, "vec_id", "label")
    more = -length % s.parts
    if more:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), more)))
        length += more
    if length > 32 * s.parts:
        size = 1 << (length // s.parts - 1).bit_length()
        squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(c.cast("double"), 2))
        rows = rows.where(squares < 2.0**60 / size)
    books = learn_codebooks(rows, length, s)
    names = T.StructType([rows.schema["vec_id"], rows.schema["label"]]).add("code", "string").add("error", "long")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(names)
    coded = interim(rows.mapInArrow(lambda batches: _codes(batches, books, arrow), names))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(totals, coded.label.eqNullSafe(totals.of)).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
