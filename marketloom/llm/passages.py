"""Finding passages of a fixed length that texts share, as spans of each text.

A text is a sequence of symbols. The rolling hash of every ``gram`` symbols is taken. A window of ``length`` symbols is held by
its first trigger, a gram whose hash ``modulus`` divides; a window without one, or any if no modulus is given, by the
least hash inside it. Either way equal windows are held by the same gram at the same place. Windows that follow each
other and are held by one gram are a stretch. So two equal windows always meet in the group of their gram's hash, and a
group holds one row per stretch rather than one per position. Stretches with equal content are one class; only groups
with several classes have to be looked into, and only there is content compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices
from marketloom.session import interim

#: Stands for no smaller id.
NOBODY = (1 << 63) - 1
PRIME = 0x9E3779B97F4A7C15
#: Symbols hashed at once; longer texts are read in blocks that overlap by a window.
BLOCK = 1 << 20
#: Bytes of text taken at once, or one longer text.
SLICE = 4 << 20


@dataclass(frozen=True)
class Passage:
    length: int
    gram: int
    words: bool  # symbols are words, else bytes
    earlier: bool  # a window counts if a smaller doc_id holds it, else if it starts anywhere else
    modulus: int = 0  # a gram is a trigger if this divides its hash; 0: none is
    #: Classes of one group that a task takes; larger groups are dealt by the content of each window.
    most: int = 20_000
    classes_per_task: int = 20_000


_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(PRIME, -1, 1 << 64)
    up = np.full(n, PRIME, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Mixed rolling hash of every run of ``gram`` 64-bit symbols."""
    size = 1 << max(14, int(len(symbols) + 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = _powers(size)
    up, down = _POWERS[size]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)], dtype=np.uint64)))
    h = (upto[gram:] - upto[:-gram]) * down[: len(symbols) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima towards both ends of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def trigger_places(symbols: np.ndarray, p: Passage) -> np.ndarray:
    """Where the triggers of a text of bytes start."""
    found = [np.empty(0, np.int64)]
    for at in range(0, len(symbols) - p.gram + 1, BLOCK):
        g = gram_hashes(_BYTES[symbols[at: at + BLOCK + p.gram - 1]], p.gram)
        found.append(np.flatnonzero(g % np.uint64(p.modulus) == 0) + at)
    return np.concatenate(found)


def holders(g: np.ndarray, p: Passage) -> np.ndarray:
    """For each window the place of the gram that holds it."""
    m = p.length - p.gram + 1
    n = len(g) - m + 1
    place = np.full(n, len(g) + m)
    if p.modulus:
        at = np.flatnonzero(g % np.uint64(p.modulus) == 0)
        place = np.repeat(np.append(at, len(g) + m), np.diff(np.concatenate(([-1], at, [len(g) - 1]))))[:n]
    lone = place - np.arange(n) >= m
    if lone.any():
        low = np.uint64((1 << 24) - 1)
        least = sliding_least((g & ~low) | np.arange(len(g), dtype=np.uint64), m) & low
        place = np.where(lone, least.astype(np.int64), place)
    return place


def stretches(symbols: np.ndarray, content: bytes, width: int, p: Passage) -> tuple[np.ndarray, ...]:
    """key, class, start, windows, trigger place after start of each stretch; ``width`` is bytes of content per symbol."""
    out: list[tuple] = []
    for at in range(0, len(symbols) - p.length + 1, BLOCK):
        part = symbols[at: at + BLOCK + p.length - 1]
        if not p.words:
            part = _BYTES[part]
        g = gram_hashes(part, p.gram)
        place = holders(g, p)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        triggers = place[first]
        keys = g[triggers].view(np.int64)
        after = triggers - first
        for key, start, n, a in zip(keys.tolist(), (first + at).tolist(), count.tolist(), after.tolist()):
            own = content[start * width: (start + n - 1 + p.length) * width]
            out.append((key, xxhash.xxh3_64_intdigest(own, a) - (1 << 63), start, n, a))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.array(c, np.int64) for c in zip(*out))


def symbols_of(texts: list[bytes], p: Passage) -> Iterator[tuple[np.ndarray, bytes, int, int]]:
    """For each text: its symbols, their content, bytes of content per symbol, the number of symbols."""
    if not p.words:
        for t in texts:
            yield np.frombuffer(t, np.uint8), t, 1, len(t)
        return
    known: dict[bytes, int] = {}
    for t in texts:
        words = t.split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        yield codes, codes.tobytes(), 8, len(words)
        if len(known) > 500_000:
            known.clear()


def _encode(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def row_key(doc_id: int | None, text: bytes) -> int:
    """Names a row by its whole id (null has a mark of its own) and text; rows that repeat both have one name."""
    name = xxhash.xxh3_64(bytes(9) if doc_id is None else b"\1" + doc_id.to_bytes(8, "little", signed=True))
    name.update(text)
    return name.intdigest() - (1 << 63)


def whole(text: bytes, p: Passage) -> str:
    return hashlib.sha256(b" ".join(text.split()) if p.words else text).hexdigest()


def _scan(docs: DataFrame, p: Passage) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, size, digest of the whole text, arrays of its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                texts = _encode(b.column(1))
                rows = []
                for doc, text, (codes, content, width, n) in zip(b.column(0).to_pylist(), texts, symbols_of(texts, p)):
                    found = stretches(codes, content, width, p)
                    rows.append((row_key(doc, text), doc, n, whole(text, p), *found))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]),
                     *[pa.array(c, pa.list_(pa.int64())) for c in cols[4:6]], *[pa.array(c, pa.list_(pa.int32())) for c in cols[6:]]],
                    names=["rid", "doc_id", "size", "digest", "key", "seg", "start", "n", "after"])

    return docs.mapInArrow(run, "rid long, doc_id long, size long, digest string, key array<long>, seg array<long>, "
                                "start array<int>, n array<int>, after array<int>")


def _packed(docs: DataFrame) -> DataFrame:
    """rid and compressed text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in (part for batch in batches for part in slices(batch, 1, SLICE)):
            ids, texts = b.column(0).to_pylist(), _encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row_key(d, t) for d, t in zip(ids, texts)], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary())],
                names=["rid", "packed"])

    return docs.mapInArrow(run, "rid long, packed binary")


def shared_spans(docs: DataFrame, p: Passage, inside: Callable, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and for each rid with shared windows its compressed text and its spans of covered symbols.

    ``inside(texts, classes)`` finds inside groups which windows of a class count: it gets (rid, packed, wanted), wanted
    naming a stretch of each class (``large``: of a group of over ``most`` classes), and the classes by (key, seg). It
    returns (key, seg, runs), runs being arrays of (first window, last window, smallest doc_id).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = interim(_scan(rows, p))
    each = base.select("rid", "doc_id", F.explode(F.arrays_zip("key", "seg", "start", "n", "after")).alias("s")).select(
        "rid", "doc_id", "s.*")
    keys = each.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("c"),
                                   F.min("seg").alias("low"), F.max("seg").alias("high"))
    keys = keys.where("owner < last" if p.earlier else "c > 1").select("key", "owner", (F.col("low") != F.col("high")).alias("mixed"))
    hits = each.join(interim(keys), "key")
    hits = interim(hits.where("mixed OR doc_id > owner") if p.earlier else hits)
    mixed = hits.where("mixed")
    classes = interim(mixed.groupBy("key", "seg").agg(
        F.min(F.struct("doc_id", "rid", "start", "n", "after")).alias("rep"), F.coalesce(F.min("doc_id"), F.lit(NOBODY)).alias("owner"), F.count(F.lit(1)).alias("c")))
    marked = classes.withColumn("large", F.lit(False))
    if p.modulus:
        large = interim(classes.groupBy("key").count().where(F.col("count") > p.most).select("key", F.lit(True).alias("many")))
        marked = classes.join(large, "key", "left").withColumn("large", F.coalesce("many", F.lit(False)))
    wanted = marked.select("rep.rid", F.struct("key", "seg", "c", "owner", "rep.start", "rep.n", "rep.after", "large").alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted"))  # at most the stretches of one text
    touched = hits.select("rid").distinct()
    texts = interim(_packed(rows).join(touched.join(wanted, "rid", "left"), "rid"))
    runs = interim(inside(texts.where("wanted IS NOT NULL"), classes))
    single = hits.where("NOT mixed").select("rid", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + p.length).alias("b"))
    several = mixed.join(runs, ["key", "seg"]).select("rid", "doc_id", "start", F.explode("runs").alias("r"))
    several = several.where("doc_id > r.owner") if p.earlier else several
    several = several.select("rid", (F.col("start") + F.col("r.first")).alias("a"), (F.col("start") + F.col("r.last") + p.length).alias("b"))
    spans = single.unionByName(several).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return base, texts.select("rid", "packed").join(spans, "rid")


def _pieces(texts: DataFrame, p: Passage) -> DataFrame:
    """The content of one stretch of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (part for batch in batches for part in slices(batch, 0, SLICE // 8)):
            raw = [unpack.decompress(x) if x else b"" for x in b.column(0).to_pylist()]
            rows = []
            for wanted, (_, content, width, _) in zip(b.column(1).to_pylist(), symbols_of(raw, p)):
                for w in wanted:
                    own = content[w["start"] * width: (w["start"] + w["n"] - 1 + p.length) * width]
                    rows.append((w["key"], w["seg"], w["c"], w["owner"], w["n"], w["after"], own))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["key", "seg", "c", "owner", "n", "after", "content"])

    return texts.select("packed", "wanted").mapInArrow(
        run, "key long, seg long, c long, owner long, n int, after int, content binary")


RUNS = "key long, seg long, runs array<struct<first:int,last:int,owner:long>>"


def by_pieces(p: Passage, look: Callable) -> Callable:
    """An ``inside`` whose ``look`` gets (key, seg, c, owner, n, after, content) of whole groups."""

    def inside(texts: DataFrame, classes: DataFrame) -> DataFrame:
        return _inside(interim(_pieces(texts, p)), p, look)

    return inside


def _inside(pieces: DataFrame, p: Passage, look: Callable) -> DataFrame:
    """(key, seg, runs) for the classes of groups with several classes."""
    large = interim(pieces.groupBy("key").count().where(F.col("count") > p.most).select("key"))
    tasks = max(1, -(-pieces.count() // p.classes_per_task))
    columns = ("key", "seg", "c", "owner", "n", "after", "content")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = look(f)
        return pd.DataFrame(out, columns=["key", "seg", "runs"])

    few = pieces.join(large, "key", "left_anti").select(*columns, F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
    found = few.groupBy("task").applyInPandas(run, RUNS)
    if large.isEmpty():
        return found
    return found.unionByName(by_content(pieces.join(large, "key"), p))


def by_content(pieces: DataFrame, p: Passage) -> DataFrame:
    """Windows of large groups meet by content, wherever their classes are."""
    width = 8 if p.words else 1
    many = interim(pieces.select("key", "seg", "c", "owner", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.struct((F.col("after") - i).alias("ahead"), F.xxhash64(F.substring(F.col("content"), i * width + 1, F.lit(p.length * width))).alias("h"),
                           F.crc32(F.substring(F.col("content"), i * width + 1, F.lit(p.length * width))).alias("h2"))))
        .alias("i", "w")).select("key", "seg", "c", "owner", "i", "w.*"))
    met = many.groupBy("key", "ahead", "h", "h2").agg(F.sum("c").alias("all"), F.min("owner").alias("first_owner"))
    met = met.where("all > 1")
    hit = many.join(met, ["key", "ahead", "h", "h2"]).select("key", "seg", "i", F.col("first_owner").alias("o"))
    return hit.groupBy("key", "seg").agg(F.collect_list(
        F.struct(F.col("i").alias("first"), F.col("i").alias("last"), F.col("o").alias("owner"))).alias("runs"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans [a, b) joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def to_runs(flags: np.ndarray, owners: np.ndarray) -> list[dict]:
    """Neighbouring flagged windows with one owner, as (first, last, owner)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    own = owners[at]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (own[1:] != own[:-1]))))
    last = np.append(new[1:], len(at)) - 1
    return [{"first": int(at[i]), "last": int(at[j]), "owner": int(own[i])} for i, j in zip(new, last)]


def cut(base: DataFrame, spans: DataFrame, p: Passage) -> DataFrame:
    """One row per scanned row: doc_id, size, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (part for batch in batches for part in slices(batch, 1, SLICE // 8)):
            rows = []
            for rid, raw, spans in zip(*(c.to_pylist() for c in b.columns)):
                text = unpack.decompress(raw) if raw else b""
                units = text.split() if p.words else text
                gone = merged(spans)
                kept, at = [], 0
                for a, z in gone:
                    kept.append(units[at:a])
                    at = z
                kept.append(units[at:])
                left = b" ".join(w for k in kept for w in k) if p.words else b"".join(kept)
                rows.append((rid, sum(z - a for a, z in gone), len(gone), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
                names=["id", "n_removed", "n_spans", "kept"])

    done = interim(spans.mapInArrow(run, "id long, n_removed long, n_spans long, kept string").dropDuplicates(["id"]))
    return base.join(done, base.rid == done.id, "left").select(
        "doc_id", "size", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "digest").alias("kept_sha256"))
