"""Near-duplicates by SimHash, found with deletion-variant signatures.

Fingerprints that differ in at most four of 64 bits differ in at most one bit of one of three segments. So each
fingerprint is indexed once for every bit of every segment with that bit left out: 64 keys. Equal keys are joined and
each pair is verified on all 64 bits. Identical fingerprints are one node, however many documents they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import components, put_back
from marketloom.llm.exact_dedup import one_per_text
from marketloom.session import interim

SHINGLE = 4
SEED = 42
#: (lowest bit, width) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4
#: Rows of a run compared at once; longer runs are compared in blocks of this size.
BLOCK = 2048
#: Fingerprints under one key that a task takes; longer runs are dealt over tasks as pairs of blocks.
RUN = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes: a bit is set if it is set in over half the XXH64 hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], seed) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        ones += np.unpackbits(digests[at: at + 65536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and row, a hash of the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b"".join(fingerprint(t.as_py()) for t in b.column(1))
            fp = np.frombuffer(found, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "row"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, row long")


def variants(nodes: DataFrame) -> DataFrame:
    """64 keys per fingerprint: the position of the bit left out, and the segment without that bit."""
    parts = []
    for low, width in SEGMENTS:
        for bit in range(low, low + width):
            kept = ((1 << width) - 1) << low & ~(1 << bit)
            parts.append(F.col("fp").bitwiseAND(F.lit(kept if kept < 1 << 63 else kept - (1 << 64))))
    keys = F.transform(F.array(*parts), lambda key, at: F.struct(at.cast("int").alias("at"), key.alias("key")))
    return nodes.select("fp", F.explode(keys).alias("v")).select("v.at", "v.key", "fp")


def _parts(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each row the first row that links within ``max_bits`` connect it with.

    Rows are compared block by block; links between parts already joined are dropped at once, so memory stays at
    one block whatever the number of links.
    """
    part = np.arange(len(fps))
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            a, b = np.nonzero(np.bitwise_count(fps[i: i + BLOCK, None] ^ fps[None, j: j + BLOCK]) <= max_bits)
            a, b = a + i, b + j
            while True:
                x, y = part[a], part[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
                while (part != part[part]).any():
                    part = part[part]
    return part


def dealt(keys: DataFrame, most: int = RUN) -> DataFrame:
    """``keys`` with runs of over ``most`` fingerprints cut into pairs of blocks, each pair a key of its own.

    Every two fingerprints of a run meet in the key of their two blocks, so no link is lost and no task holds a run. A run of
    n fingerprints is sent to tasks 2 n / ``most`` times. Pair keys that collide only compare more.
    """
    hot = interim(keys.groupBy("at", "key").count().where(F.col("count") > most))
    if hot.isEmpty():
        return keys
    blocks = F.ceil(F.col("count") / F.lit(max(1, most // 2))).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = keys.join(hot, ["at", "key"]).withColumn("blocks", blocks).select(
        "at", "key", "fp", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    split = pairs.select("at", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    return keys.join(hot, ["at", "key"], "left_anti").select("at", "key", "fp").unionByName(split)


def links(keys: DataFrame, max_bits: int = MAX_BITS, most: int = RUN) -> DataFrame:
    """Pairs of fingerprints (a, b) whose components are those of all links within ``max_bits``.

    Long runs are dealt over tasks first (:func:`dealt`). Rows with equal keys are next to each other after a sort by key. Short runs yield their links; a run of over 32
    yields one pair per row, with the first row of its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at0, key0, fp0 = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            at, key, fp = (np.concatenate((x, y)) for x, y in zip((at0, key0, fp0), (c.to_numpy() for c in b.columns)))
            last = len(key) - 1
            start = last - int(np.argmax(((key != key[last]) | (at != at[last]))[::-1])) + 1
            if key[0] == key[last] and at[0] == at[last]:
                start = 0
            yield _pairs(at[:start], key[:start], fp[:start], max_bits)
            at0, key0, fp0 = at[start:], key[start:], fp[start:]
        yield _pairs(at0, key0, fp0, max_bits)

    count = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = dealt(keys, most).repartition(int(count), "at", "key").sortWithinPartitions("at", "key")
    return ordered.mapInArrow(run, "a long, b long")


def _pairs(at: np.ndarray, key: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    a, b = [none], [none]
    if len(key) > 1:
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        run = np.repeat(np.arange(len(starts)), sizes)
        bits = fp.view(np.uint64)
        short = sizes[run] <= 32
        for step in range(1, int(min(32, sizes.max()))):
            same = (run[step:] == run[:-step]) & short[step:]
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= max_bits]
            a.append(fp[i])
            b.append(fp[i + step])
        for r in np.flatnonzero(sizes > 32):
            own = fp[starts[r]: starts[r] + sizes[r]]
            part = _parts(own.view(np.uint64), max_bits)
            rest = np.flatnonzero(part != np.arange(len(part)))
            a.append(own[rest])
            b.append(own[part[rest]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, root (names the component), row (hash of the text).

    ``component_id`` is the smallest id reachable over links, the row's own included. A text without words has
    fingerprint zero and is linked like any other, a null text counts as empty; null ids take no part in the minimum.
    """
    if max_bits > 2 * len(SEGMENTS) - 1 or max_bits < 0:
        raise ValueError(f"max_bits: {max_bits} is outside 0 to {2 * len(SEGMENTS) - 1}")
    rows = interim(fingerprints(docs, id_col, text_col))
    nodes = interim(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(variants(nodes), max_bits))
    named = nodes.join(found, nodes.fp == found.node, "left").select(
        nodes.fp, "least", F.coalesce("root", nodes.fp).alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = interim(named.join(least, "root").select(F.col("fp").alias("node_fp"), "root", "component_id"))
    return rows.join(table, rows.fp == table.node_fp).select("doc_id", "fp", "component_id", "root", "row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    A component without ids keeps one row; of rows that share the smallest id, the one with the smallest text hash stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = found.groupBy("root").agg(first).select("first.doc_id", "first.row")
    rows = put_back(docs, kept, [("doc_id", F.col(id_col)), ("row", F.xxhash64(F.col(text_col)))])
    return one_per_text(rows, id_col, text_col)
