"""Removing byte strings that occur more than once, by prefix-free parsing.

Triggers are the grams whose rolling hash a modulus divides. They cut a text into phrases that run from one trigger to the end of
the next: no phrase is a proper prefix of another. The distinct phrases are the dictionary, a text is a sequence of
phrases, its parse. Phrases longer than a window are only kept to its length, as no window reads on; windows in them
that hold no trigger are held by their least gram, and their parse starts there (see ``passages``).

Groups of equal triggers are dealt over tasks. A task gets each phrase that its groups name once, sorts this dictionary with
the common prefixes of neighbours, sorts the parses behind the triggers by the ranks of their phrases, and adds up
the common prefixes of neighbouring parses from whole phrases and one look into the dictionary. The phrases that end in the
triggers are sorted from back to front. A window takes some bytes before its trigger and the rest after it, so its
place in corpus order is the pair of the ranks at those depths: windows with one pair are equal. Highly repetitive text
costs little, because equal stretches are one class and equal phrases one entry before anything is sorted.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices
from marketloom.llm.passages import NOBODY, RUNS, SLICE, Passage, by_content, cut, shared_spans, symbols_of, to_runs, trigger_places
from marketloom.session import interim

LENGTH = 400
#: Mean distance of triggers.
MODULUS = 100
NAME = 16


def name(phrase: bytes) -> bytes:
    return xxhash.xxh3_128_digest(phrase)


def phrases_from(text: bytes, at: int, triggers: list[int], p: Passage) -> list[bytes]:
    """The parse of the ``length`` bytes from ``at`` on, or up to the end of the text."""
    out, start = [], at
    for k in range(bisect_right(triggers, at), len(triggers) + 1):
        end = triggers[k] + p.gram if k < len(triggers) else len(text)
        out.append(text[start: min(end, start + p.length)])
        if end >= at + p.length or k == len(triggers):
            break
        start = triggers[k]
    return out


def phrase_before(text: bytes, first: int, at: int, triggers: list[int], p: Passage) -> bytes:
    """The phrase that ends in the gram at ``at``; only what windows from ``first`` on read, where that is less."""
    k = bisect_left(triggers, at)
    start = first - 1 if k and triggers[k - 1] == first - 1 and at + p.gram - first < p.length else first
    return text[start: at + p.gram]


def phrase_array(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of distinct phrases, and the common prefix of each with the one before it (-1 for the first)."""
    order = sorted(range(len(phrases)), key=phrases.__getitem__)
    common = np.full(len(order), -1, np.int64)
    for at in range(0, len(order), 4096):
        rows = order[max(0, at - 1): at + 4096]
        width = max(len(phrases[i]) for i in rows) + 1
        table = np.zeros((len(rows), width), np.uint8)
        for r, i in enumerate(rows):
            table[r, : len(phrases[i])] = np.frombuffer(phrases[i], np.uint8)
        size = np.array([len(phrases[i]) for i in rows])
        differ = table[1:] != table[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        common[max(1, at): at + 4096] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    return np.array(order, np.int64), common


def least_between(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low + 1: high + 1]) for each pair low < high, from minima over powers of two."""
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.empty(len(low), x.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(levels[k][low[own] + 1], levels[k][high[own] + 1 - (1 << k)])
    return out


def parse_array(parses: list[list[int]], size: np.ndarray, common: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of parses, given as ranks of phrases, and the common prefix in bytes of each with the one before it.

    ``size`` and ``common`` are of the dictionary, by rank. Equal parses have all bytes in common.
    """
    many = np.array([len(x) for x in parses])
    table = np.full((len(parses), int(many.max())), -1, np.int64)
    table[np.arange(table.shape[1]) < many[:, None]] = [r for x in parses for r in x]
    order = np.lexsort(table.T[::-1])
    table = table[order]
    differ = table[1:] != table[:-1]
    at = differ.argmax(1)
    upto = np.cumsum(np.where(table >= 0, size[table] - gram, 0), axis=1)
    rows = np.arange(len(at))
    whole = np.where(at > 0, upto[rows, at - 1], 0)
    low, high = table[rows, at], table[rows + 1, at]
    inside = np.full(len(at), NOBODY >> 1)
    unlike = differ.any(1) & (low >= 0)
    inside[unlike] = least_between(common, low[unlike], high[unlike])
    inside[differ.any(1) & (low < 0)] = 0
    return order, np.append(-1, whole + inside)


def look(p: Passage) -> Callable:
    def run(f: pd.DataFrame) -> list[tuple]:
        entries = f.phrase.notna()
        dictionary = list(dict.fromkeys(f.phrase[entries]))
        f = f[~entries]
        n, after, twice = f.n.to_numpy(np.int64), f.after.to_numpy(np.int64), f.c.to_numpy() > 1
        number = {name(x): i for i, x in enumerate(dictionary)}
        order, common = phrase_array(dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        size = np.array([len(x) for x in dictionary])[order]
        parses = [rank[[number[x[i: i + NAME]] for i in range(0, len(x), NAME)]].tolist() for x in f.parse]
        right, right_common = parse_array(parses, size, common, p.gram)
        ends = [number[x] for x in f.before]
        used = sorted(set(ends))
        back, back_common = phrase_array([dictionary[i][::-1] for i in used])
        place = dict(zip((used[i] for i in back.tolist()), range(len(back))))
        left = np.array([place[i] for i in ends])
        flags = np.zeros((len(f), int(n.max())), bool)
        pair = np.empty((2, len(f)), np.int64)
        for before in range(int((after - n).min()) + 1, int(after.max()) + 1):
            pair[0] = np.cumsum(back_common - p.gram < before)[left]
            pair[1, right] = np.cumsum(right_common < p.length - before)
            own = np.flatnonzero((before <= after) & (before > after - n))
            _, at, many = np.unique(pair[0, own] * (len(f) + 1) + pair[1, own], return_inverse=True, return_counts=True)
            flags[own, after[own] - before] = (many[at] > 1) | twice[own]
        nobody = np.full(flags.shape[1], NOBODY)
        return [(k, s, to_runs(row[:m], nobody)) for k, s, row, m in zip(f.key.tolist(), f.seg.tolist(), flags, n)]

    return run


def _parsed(texts: DataFrame, p: Passage, tasks: int) -> DataFrame:
    """A row with its parse for each class, and a row for each phrase that a task reads; content only for large groups."""
    kind = pa.schema([("task", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()), ("c", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()),
                      ("after", pa.int32()), ("before", pa.binary()), ("parse", pa.binary()), ("phrase", pa.binary()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (part for batch in batches for part in slices(batch, 0, SLICE // 8)):
            raw = [unpack.decompress(x) if x else b"" for x in b.column(0).to_pylist()]
            rows, entries = [], set()
            for wanted, (symbols, text, _, _) in zip(b.column(1).to_pylist(), symbols_of(raw, p)):
                triggers = trigger_places(symbols, p).tolist()
                for w in wanted:
                    first, at, task = w["start"], w["start"] + w["after"], (w["key"] >> 16) % tasks
                    row = (task, w["key"], w["seg"], w["c"], w["owner"], w["n"], w["after"])
                    if w["large"]:
                        rows.append((*row, None, None, None, text[first: first + w["n"] - 1 + p.length]))
                        continue
                    before, parse = phrase_before(text, first, at, triggers, p), phrases_from(text, at, triggers, p)
                    entries.update((task, x) for x in (before, *parse))
                    rows.append((*row, name(before), b"".join(map(name, parse)), None, None))
            rows += [(task, 0, 0, 0, 0, 0, 0, None, None, x, None) for task, x in entries]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return texts.select("packed", "wanted").mapInArrow(
        run, "task int, key long, seg long, c long, owner long, n int, after int, before binary, parse binary, phrase binary, content binary")


def by_parse(p: Passage) -> Callable:
    """Finds the windows of classes that are equal, group by group; large groups are dealt by the content of each window."""

    def inside(texts: DataFrame, classes: DataFrame) -> DataFrame:
        tasks = max(1, -(-classes.count() // p.classes_per_task))
        parsed = interim(_parsed(texts, p, tasks))
        find = look(p)

        def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(find(f), columns=["key", "seg", "runs"])

        dealt = parsed.where("content IS NULL").select("task", "key", "seg", "c", "n", "after", "before", "parse", "phrase")
        dealt = dealt.repartitionById(tasks, "task")  # one to a partition, whatever the size of the input
        found = dealt.groupBy("task").applyInPandas(run, RUNS)
        large = parsed.where("content IS NOT NULL")
        if large.isEmpty():
            return found
        return found.unionByName(by_content(large.select("key", "seg", "c", "owner", "n", "after", "content"), p))

    return inside


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = 100,
                        modulus: int = MODULUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.
    Null and short texts lose nothing; rows that repeat id and text are occurrences of their own.
    """
    p = Passage(length=length, gram=gram, words=False, earlier=False, modulus=modulus)
    base, spans = shared_spans(docs, p, by_parse(p), id_col, text_col)
    return cut(base, spans, p).select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
