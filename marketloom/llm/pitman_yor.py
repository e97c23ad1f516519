"""A hierarchical Pitman-Yor language model with Chinese-restaurant seating.

A token is drawn from the restaurant of its context, the word before it (the end token before a text's first word); all
contexts share the root restaurant, whose base is uniform over the vocabulary and one unknown word. Every word of the
corpus has a restaurant of its own, so contexts, counts, tables and vocabulary grow with the corpus.

Work is dealt by words. Texts are read once into chunks of word codes, and ranges of word hashes number the words of all
chunks. Each chunk asks every range about its distinct (word, context) pairs; a range adds up the counts of all chunks, and in each Gibbs sweep the customers of
every pair leave and sit down again, given everyone else's tables. Sweeps are tied together by the tables of each context:
every range reports those of its contexts to the task that owns a context, which sends back the totals.
The predictive probabilities are averaged over the sweeps and sent back to the chunks that asked. A frequent word
costs a chunk one pair per context, however often it occurs, so no word or context gathers tokens in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import crc_mod, forget, own_texts
from marketloom.session import bucketed, interim


@dataclass(frozen=True)
class Settings:
    classes: int = 4096  # most tasks that own contexts and add up their tables; every context is told apart
    sweeps: int = 3  # samples averaged; one more sweep before them settles the tables
    strength: float = 2.0  # of the context restaurants
    root_strength: float = 10.0
    chunk: int = 1 << 21  # tokens
    seed: int = 17


#: No word can hold a space.
END = xxhash.xxh3_64_intdigest(b" end")


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight lie together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append((a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def load(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n))
    return out


def encode(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the frequent ones first, how often each occurs, tokens as places among them, bounds of the texts."""
    lower = pc.ascii_lower(own_texts(texts))
    parts = pc.ascii_split_whitespace(lower)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(filled)))
    bounds = upto[offsets - offsets[0]]
    flat = flat.filter(pa.array(filled)).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [w.encode("utf-8", "surrogatepass") for w in flat.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in raw] + [END], np.uint64)
    codes = np.insert(codes, bounds[1:], len(raw))
    bounds = bounds + np.arange(len(bounds))
    many = np.bincount(codes, minlength=len(hashes))
    order = np.argsort(-many, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    return hashes[order], many[order], place[codes], bounds


def _chunks(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(chunk, doc_ids, held_out, blob): a bounded number of tokens, or one longer text, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        kept: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, kept, size
            t = pa.Table.from_batches(kept)
            hashes, _, codes, bounds = encode(pa.concat_arrays(t.column("text").chunks), s)
            blob = dump(hashes, codes, bounds)
            row = pa.RecordBatch.from_pylist(
                [{"chunk": number, "doc_ids": t.column("doc_id").to_pylist(), "held_out": t.column("held_out").to_pylist(), "blob": blob}],
                schema=pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("blob", pa.binary())]))
            number, kept, size = number + 1, [], 0
            return row

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)) // 6
            at = 0
            while at < b.num_rows:
                done = sizes[at - 1] if at else 0
                n = max(1, int(np.searchsorted(sizes, done + s.chunk - size, "right")) - at)
                kept.append(b.slice(at, n))
                size += int(sizes[at + n - 1] - done)
                at += n
                if size >= s.chunk or at < b.num_rows:
                    yield close()
        if kept:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       (crc_mod(id_col, 10) == 0).alias("held_out"))
    return rows.mapInArrow(run, "chunk long, doc_ids array<long>, held_out array<boolean>, blob binary")


def _pairs(blob: bytes, held_out):
    """Of a chunk: word hashes, distinct pairs (word place * words + place of the word before), how often each occurs in
    training texts, the pair of each token, bounds of the texts."""
    hashes, codes, bounds = load(blob)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key = place[codes]
    del codes
    key = key * len(order) + np.roll(key, 1)  # every text ends in an end token, so one stands before each first word
    pairs, at = np.unique(key, return_inverse=True)
    del key
    at = at.astype(np.uint32)
    train = np.repeat(~np.asarray(held_out, bool), np.diff(bounds))
    return hashes[order], pairs, np.bincount(at[train], minlength=len(pairs)), at, bounds


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in sorted hashes."""
    own = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64))


def _numbers(chunks: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, blob, words): the places of a chunk's words among the words of a range; how many those are (chunk null)."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for chunk, blob in zip(f.chunk, f.blob):
                hashes = np.sort(load(blob)[0])
                cuts = _cuts(hashes, ranges)
                yield pd.DataFrame([(r, chunk, dump(hashes[cuts[r]: cuts[r + 1]])) for r in range(ranges)], columns=["range", "chunk", "blob"])

    def number(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own = [load(b)[0] for b in f.blob]
        words = np.unique(np.concatenate(own))
        rows = [(key[0], None, None, len(words))]
        rows += [(key[0], c, dump(_steps(np.searchsorted(words, x))), None) for c, x in zip(f.chunk, own)]
        return pd.DataFrame(rows, columns=["range", "chunk", "blob", "words"]).astype({"chunk": "Int64", "words": "Int64"})

    asked = chunks.select("chunk", "blob").mapInPandas(ask, "range int, chunk long, blob binary")
    return asked.groupBy("range").applyInPandas(number, "range int, chunk long, blob binary, words long")


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which are small and undone by a running sum."""
    steps = np.diff(ascending, prepend=0)
    return steps.astype(np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64)


def _asks(chunks: DataFrame, numbers: DataFrame, first: list[int]) -> DataFrame:
    """(range, chunk, blob): the words and pairs of a chunk by range; ``first`` is the first number of each range."""
    ranges = len(first) - 1

    def run(chunk: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        hashes, pairs, counts, _, _ = _pairs(chunk.blob.iloc[0], chunk.held_out.iloc[0])
        words = _cuts(hashes, ranges)
        own = [np.cumsum(load(b)[0], dtype=np.int64) for b in places.sort_values("range").blob]
        numbers = np.concatenate([x + at for x, at in zip(own, first)]).astype(np.uint32 if first[-1] < 1 << 32 else np.uint64)
        ends = np.searchsorted(pairs, words * len(hashes))
        out = []
        for r in range(ranges):
            word, before = np.divmod(pairs[ends[r]: ends[r + 1]], len(hashes))
            many = np.bincount(word - words[r], minlength=words[r + 1] - words[r])
            out.append((r, chunk.chunk.iloc[0], dump(_steps(own[r]), many.astype(np.uint32), numbers[before],
                                                     counts[ends[r]: ends[r + 1]].astype(np.uint32))))
        return pd.DataFrame(out, columns=["range", "chunk", "blob"])

    return chunks.select("chunk", "held_out", "blob").groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInPandas(
        run, "range int, chunk long, blob binary")


def _reports(contexts: np.ndarray, everything: int, owners: int, *values: np.ndarray) -> list[dict]:
    """Values of ascending contexts, for each of the tasks that own them."""
    cuts = np.searchsorted(contexts, [everything * q // owners for q in range(owners + 1)])
    return [{"owner": q, "blob": dump(_steps(contexts[a:b]), *(x[a:b] for x in values))} for q, (a, b) in enumerate(zip(cuts, cuts[1:]))]


SENT = "sent array<struct<owner:int,blob:binary>>"


def _merge(first: list[int], owners: int):
    """All asks of a range -> its table of pairs (chunk null), and for each chunk the places of what it asked."""
    wide = first[-1]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        words = first[key[0] + 1] - first[key[0]]
        asks = {c: load(b) for c, b in sorted(zip(f.chunk, f.blob))}
        keys = {c: np.repeat(np.cumsum(a[0], dtype=np.int64), a[1]) * wide + a[2].astype(np.int64) for c, a in asks.items()}
        pairs = np.unique(np.concatenate(list(keys.values())))
        at = {c: np.searchsorted(pairs, keys.pop(c)) for c in list(keys)}
        counts = np.zeros(len(pairs), np.int64)
        for c, a in asks.items():
            counts[at[c]] += a[3]
        word, before = np.divmod(pairs, wide)
        contexts, kinds = np.unique(before, return_inverse=True)
        many = np.bincount(word, minlength=words).astype(np.uint32)
        tables = (counts > 0).astype(np.uint32)
        total = np.bincount(word, counts, minlength=words)
        none = np.zeros(0, np.uint32)
        state = dump(many, kinds.astype(np.uint32), counts.astype(np.uint64), tables, np.minimum(total, 1).astype(np.uint32), none,
                     _steps(contexts), np.zeros(0, np.int64), none, np.zeros(0, np.int64))
        sent = _reports(contexts, wide, owners, *(np.bincount(kinds, x, minlength=len(contexts)).astype(np.int64) for x in (tables, counts)))
        rows = [(key[0], None, state, int(total.sum()), int((total > 0).sum()), *_ones(counts), *_ones(np.bincount(word, tables, minlength=words)),
                 int(tables.sum()), int((total > 0).sum()), sent)]
        for c, a in asks.items():
            rows.append((key[0], c, dump(a[0], _steps(at[c])), *[None] * 9))
        out = pd.DataFrame(rows, columns=["range", "chunk", "blob", "n", "v", "one", "two", "root_one", "root_two", "tables", "root_tables", "sent"])
        return out.astype({c: "Int64" for c in ("chunk", "n", "v", "one", "two", "root_one", "root_two", "tables", "root_tables")})

    return run, ("range int, chunk long, blob binary, n long, v long, one long, two long, root_one long, root_two long, "
                 f"tables long, root_tables long, {SENT}")


def _totals(states: DataFrame) -> DataFrame:
    """(range, owner, blob): what all ranges report of the contexts of an owner, added up, in the order each range has them."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        reports = [load(b) for b in f.blob]
        _, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.int64) for x in reports]), return_inverse=True)
        cuts = np.cumsum([len(x[0]) for x in reports])[:-1]
        sums = [np.split(np.bincount(at, np.concatenate(v)).astype(np.int64)[at], cuts) for v in zip(*(x[1:] for x in reports))]
        return pd.DataFrame([(r, key[0], dump(*x)) for r, x in zip(f.range, zip(*sums))], columns=["range", "owner", "blob"])

    sent = states.select("range", F.explode("sent").alias("s")).select("range", "s.owner", "s.blob")
    return sent.groupBy("owner").applyInPandas(run, "range int, owner int, blob binary")


def _joined(replies: pd.DataFrame) -> list[np.ndarray]:
    """The totals of all contexts of a range, from those of each owner."""
    return [np.concatenate(x) for x in zip(*(load(b) for b in replies.sort_values("owner").blob))]


def _ones(counts: np.ndarray) -> tuple[int, int]:
    return int((counts == 1).sum()), int((counts == 2).sum())


@dataclass(frozen=True)
class Totals:
    """What a task needs to know of the others: numbers, and totals of the contexts it meets."""

    n: int  # training tokens
    v: int  # distinct ones
    discount: float
    root_discount: float
    customers: np.ndarray | None  # by context
    tables: np.ndarray | None  # by context
    root_tables: float
    everyone: float | None = None  # tables of all contexts; the sum of those given if None
    words: int = 0  # numbers of words, held out or not
    ranges: int = 1


def sit(rng: np.random.Generator, counts: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables after ``counts`` customers of a dish sat down one by one; ``weight`` is that of a new table.

    Customers sit in blocks that grow with those seated, so a frequent dish takes few steps.
    """
    tables = (counts > 0).astype(np.int64)
    live = np.flatnonzero(counts > 1)
    seated = 1
    while len(live):
        block = max(1, seated // 16)
        step = np.minimum(block, counts[live] - seated)
        t, w = tables[live], weight[live]
        p = w / (w + seated - discount * t)
        if block == 1:
            tables[live] += rng.random(len(live)) < p
        else:
            tables[live] += rng.binomial(step, np.minimum(p, 1))
        seated += block
        live = live[counts[live] > seated]
    return tables


def _predict(many, kinds, counts, tables, root_tables, t: Totals, s: Settings, without_own: bool = False):
    """Root probability and predictive probability of each pair."""
    word = np.repeat(np.arange(len(many)), many)
    customers = np.bincount(word, tables, minlength=len(many))[word]
    base = 1 / (t.v + 1)
    everyone = t.tables.sum() if t.everyone is None else t.everyone
    if without_own:
        customers = customers - tables
        everyone = everyone - tables
    spare = (s.root_strength + t.root_discount * t.root_tables) * base
    root = (np.maximum(customers - t.root_discount * np.where(customers > 0, root_tables[word], 0), 0) + spare) / (s.root_strength + everyone)
    if without_own:
        return root, None
    own = np.maximum(counts - t.discount * tables, 0.0)
    free = s.strength + t.discount * t.tables[kinds]
    return root, (own + free * root) / (s.strength + t.customers[kinds])


def _sweep(states: DataFrame, t: Totals, number: int, s: Settings) -> DataFrame:
    """One Gibbs sweep over all ranges; from the third on the tables before it are kept as a sample,
    so those before the first sweep settled and after it are not."""

    def run(state: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        r = int(state.range.iloc[0])
        many, kinds, counts, tables, root_tables, kept, steps, customers, kept_roots, kept_seats = load(state.blob.iloc[0])
        counts, tables = counts.astype(np.int64), tables.astype(np.int64)
        seats, *first = _joined(replies)
        customers = first[0] if first else customers  # they do not change
        own = replace(t, customers=customers, tables=seats)
        rng = np.random.default_rng([s.seed, number, r])
        if number > 1:
            kept = np.concatenate((kept, tables.astype(np.uint32)))
            kept_roots, kept_seats = np.concatenate((kept_roots, root_tables)), np.concatenate((kept_seats, seats))
        root, _ = _predict(many, kinds, counts, tables, root_tables, own, s, without_own=True)
        weight = (s.strength + t.discount * np.maximum(seats[kinds] - tables, 0)) * root
        tables = sit(rng, counts, weight, t.discount)
        word = np.repeat(np.arange(len(many)), many)
        sitting = np.bincount(word, tables, minlength=len(many)).astype(np.int64)
        spare = (s.root_strength + t.root_discount * t.root_tables) / (t.v + 1)
        root_tables = sit(rng, sitting, np.full(len(many), spare), t.root_discount)
        blob = dump(many, kinds, counts.astype(np.uint64), tables.astype(np.uint32), root_tables.astype(np.uint32), kept, steps,
                    customers, kept_roots, kept_seats)
        sent = _reports(np.cumsum(steps, dtype=np.int64), t.words, len(replies), np.bincount(kinds, tables, minlength=len(steps)).astype(np.int64))
        return pd.DataFrame([(r, blob, int(tables.sum()), int(root_tables.sum()), sent)], columns=["range", "blob", "tables", "root_tables", "sent"])

    pairs = states.select("range", "blob").groupBy("range").cogroup(_totals(states).groupBy("range"))
    return bucketed(pairs.applyInPandas(run, f"range int, blob binary, tables long, root_tables long, {SENT}"), "range", t.ranges)


def _answers(states: DataFrame, asks: DataFrame, samples: list[Totals], s: Settings) -> DataFrame:
    """(chunk, range, blob): to each chunk the counts of its words and the averaged probability of its pairs."""

    def run(state: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        many, kinds, counts, tables, root_tables, kept, _, customers, kept_roots, kept_seats = load(state.blob.iloc[0])
        counts = counts.astype(np.int64)
        asked = given[given.owner.isna()]
        seats = np.concatenate((kept_seats, _joined(given[given.owner.notna()])[0]))
        each = [np.concatenate(x).astype(np.int64).reshape(len(samples), -1) for x in ((kept, tables), (kept_roots, root_tables))]
        mean = np.zeros(len(counts))
        for t, own, root, at in zip(samples, *each, seats.reshape(len(samples), -1)):
            mean += _predict(many, kinds, counts, own, root, replace(t, customers=customers, tables=at), s)[1] / len(samples)
        word = np.bincount(np.repeat(np.arange(len(many)), many), counts, minlength=len(many)).astype(np.uint64)
        out = []
        for r, chunk, blob in zip(asked.range, asked.chunk, asked.blob):
            words, pairs = (np.cumsum(x, dtype=np.int64) for x in load(blob))
            out.append((chunk, r, dump(word[words], mean[pairs].astype(np.float32))))
        return pd.DataFrame(out, columns=["chunk", "range", "blob"])

    given = asks.withColumn("owner", F.lit(None).cast("int")).unionByName(_totals(states).withColumn("chunk", F.lit(None).cast("long")))
    return states.select("range", "blob").groupBy("range").cogroup(given.groupBy("range")).applyInPandas(run, "chunk long, range int, blob binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A text is its lower-cased words and one end token; a null text counts as empty. Texts whose id's crc32 ends in 0
    are scored but not learnt from, nor are they if all texts are such: then every probability is the base's.
    """
    spark = docs.sparkSession
    texts = interim(_chunks(docs, id_col, text_col, s))
    ranges = max(8, texts.count() // 2)
    chunks = bucketed(texts, "chunk", ranges)  # met twice by what comes back to a chunk
    forget(texts)
    numbers = interim(_numbers(chunks, ranges))
    first = [0] * (ranges + 1)
    for r, words in numbers.where("chunk IS NULL").select("range", "words").collect():
        first[r + 1] = words
    first = np.cumsum(first).tolist()
    merge, kind = _merge(first, min(s.classes, max(4, ranges // 8)))
    asks = _asks(chunks, numbers.where("chunk IS NOT NULL").select("range", "chunk", "blob"), first)
    merged = bucketed(asks.repartition(ranges, "range").groupBy("range").applyInPandas(merge, kind), "range", ranges)
    states, places = merged.where("chunk IS NULL"), merged.where("chunk IS NOT NULL").select("range", "chunk", "blob")
    row = states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "one", "two", "root_one", "root_two", "tables", "root_tables")]).first()

    def discount(one: int, two: int) -> float:
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    t = Totals(row["n"], row["v"], discount(row["one"], row["two"]), discount(row["root_one"], row["root_two"]), None, None,
               row["root_tables"], row["tables"], first[-1], ranges)
    samples = []
    for number in range(s.sweeps + 1):  # the first settles the tables
        if number > 1:
            samples.append(t)
        before, states = states, _sweep(states, t, number, s)
        if number:
            forget(before)  # the next state is stored
        row = states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tables", "root_tables")]).first()
        t = replace(t, root_tables=row["root_tables"], everyone=row["tables"])
    answers = _answers(states, places, [*samples, t], s)
    n, v = t.n, t.v

    def finish(chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        held = chunk.held_out.iloc[0]
        hashes, pairs, _, at, bounds = _pairs(chunk.blob.iloc[0], held)
        got = [load(b) for b in answer.sort_values("range").blob]
        count, p = (np.concatenate(x) for x in zip(*got))
        count = count[pairs // len(hashes)]
        known = np.add.reduceat((count > 0).astype(np.int64)[at], bounds[:-1])
        base = np.add.reduceat(np.log10((count + 0.1) / (n + 0.1 * (v + 1)))[at], bounds[:-1])
        own = np.add.reduceat(np.log10(p.astype(np.float64))[at], bounds[:-1])
        return pd.DataFrame({
            "doc_id": pd.array(chunk.doc_ids.iloc[0], "Int64"), "held_out": np.asarray(held, bool), "n_tokens": np.diff(bounds),
            "n_known": known, "train_tokens": n, "base_score": base, "score": own})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
