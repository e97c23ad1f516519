"""Sum-of-squares packing of token sequences.

A document is cut into full windows and a rest. Each rest is placed online: of all fill levels at which an open
window can take it (a new window included), the one that makes the sum of the squared counts of open windows by level
least. The counts live in one array with an entry per level. Every task packs the documents it reads, so nothing is
shuffled. What is still open at the end of a task, or beyond a fixed number of open windows, is laid end to end and cut
at full windows; the last rest is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import own_texts, slices

WINDOW = 2048
END_ID = 1
#: Open windows a task holds (their ids are kept in memory: 8 kB a window); the fullest half is closed beyond it.
MAX_OPEN = 8192
#: Bytes of text encoded at once, or one longer text.
SLICE = 8 << 20
#: Words whose ids a Python worker remembers, in each of two generations.
MAX_WORDS = 250_000
MARKS = ".,;:!?%*#&$"
SCHEMA = ("doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class WordIds:
    """Token ids of texts, encoded word by word.

    The tokenizer drops white space and its pattern never crosses it, so a text's ids are the ids of its
    white-space-separated parts in order; each distinct part is encoded once. It lower-cases, and cuts between a
    Latin letter or digit and the marks in ``MARKS``, so parts are told apart in lower case and without such marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def remember(self, words: list[str]) -> dict[str, bytes]:
        """Ids of all ``words`` as bytes; the last two generations of words are remembered."""
        out = {}
        new = []
        for w in words:
            ids = self.young.get(w) or self.old.get(w)
            if ids is None:
                new.append(w)
            else:
                out[w] = ids
        for at in range(0, len(new), 4096):
            part = new[at: at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                out[w] = array("I", e.ids).tobytes()
        if len(self.young) + len(out) > MAX_WORDS:
            self.young, self.old = {}, self.young
        if len(out) <= MAX_WORDS:
            self.young.update(out)
        return out

    def of(self, words: list[str], plain: bool) -> list[bytes]:
        if not plain:
            known = self.remember(words)
            return [known[w] for w in words]
        cuts = []
        for w in words:
            head = w.rstrip(MARKS)
            if len(head) == len(w) or not head or head[-1] >= "\u0250" or not head[-1].isalnum():
                cuts.append(len(w))
            else:
                cuts.append(len(head))
        parts = {w[:n] for w, n in zip(words, cuts)}
        parts.update(w[n:] for w, n in zip(words, cuts))
        parts.discard("")
        known = self.remember(list(parts))
        known[""] = b""
        return [known[w[:n]] + known[w[n:]] for w, n in zip(words, cuts)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by the end id, and the bounds of each text."""
        texts = own_texts(texts)
        # names of special tokens are matched before anything is lower-cased
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        offsets = parts.offsets.to_numpy()
        flat = parts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self.of(flat.dictionary.to_pylist(), plain)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.concatenate((np.frombuffer(b"".join(ids), np.uint32), np.array([END_ID], np.uint32)))
        begins = np.concatenate((np.cumsum(sizes) - sizes, [len(table) - 1]))
        sizes = np.append(sizes, 1)
        offsets = offsets - offsets[0]
        codes = np.insert(codes, offsets[1:], len(ids))
        bounds = offsets + np.arange(len(offsets))
        out, cuts = [], [0]
        for i in range(len(bounds) - 1):  # document by document, so that one long text costs its own size only
            own = codes[bounds[i]: bounds[i + 1]]
            n = sizes[own]
            ends = np.cumsum(n)
            at = np.repeat(begins[own] - (ends - n), n) + np.arange(ends[-1])
            out.append(table[at])
            cuts.append(cuts[-1] + len(at))
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.array(cuts)


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list] = defaultdict(list)
        self.total = 0

    def place(self, size: int) -> int:
        """The level whose window takes ``size``; 0 is a new window. Ties go to the fullest."""
        count, window = self.count, self.window
        top = window - size
        change = 2 * (count[size: window + 1] - count[: top + 1]) + 2
        change[top] = 1 - 2 * count[top]  # a window that becomes full is open no more
        change[0] = 2 * count[size] + 1 if top else 0
        usable = count[: top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))

    def take(self, level: int) -> list:
        if not level:
            return []
        self.count[level] -= 1
        self.total -= 1
        return self.open[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.total += 1
        self.open[level].append(pieces)

    def drain(self, keep: int) -> list:
        """Pieces of the fullest open windows until ``keep`` windows are left."""
        out = []
        for level in range(self.window - 1, 0, -1):
            while self.count[level] and self.total > keep:
                out += self.take(level)
        return out


def pack_task(pieces: Iterator[tuple], window: int, first_id: int) -> Iterator[tuple]:
    """(doc, start, ids, doc_tokens) per document -> one row per piece."""
    levels, made = Levels(window), first_id

    def close(group: list) -> list[tuple]:
        nonlocal made
        rows, at = [], 0
        for doc, start, ids, total in group:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, made, at))
            at += len(ids)
        made += 1
        return rows

    def lay(group: list) -> Iterator[tuple]:
        """Pieces end to end, cut at full windows and, at the end, at powers of two."""
        left = sum(len(p[2]) for p in group)
        full: list = []
        room = min(window, 1 << (left.bit_length() - 1)) if left else 0
        for doc, start, ids, total in group:
            at = 0
            while at < len(ids):
                n = min(room, len(ids) - at)
                full.append((doc, start + at, ids[at: at + n], total))
                at, room, left = at + n, room - n, left - n
                if not room:
                    yield from close(full)
                    full = []
                    room = min(window, 1 << (left.bit_length() - 1)) if left else 0

    for doc, ids in pieces:
        total, rest = len(ids), len(ids) % window
        for at in range(0, total - rest, window):
            yield from close([(doc, at, ids[at: at + window], total)])
        if rest:
            level = levels.place(rest)
            group = [*levels.take(level), (doc, total - rest, ids[total - rest:].copy(), total)]
            if level + rest == window:
                yield from close(group)
            else:
                levels.put(level + rest, group)
                if levels.total > MAX_OPEN:
                    yield from lay(levels.drain(MAX_OPEN // 2))
    yield from lay(levels.drain(0))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with the end id, so an empty or null text is one piece of one token. Rows that repeat an
    id are packed like any others. ``sequence_id`` is the task's number times 2**32 plus the window's in the task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = SCHEMA.format(kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        shape = None

        def each() -> Iterator[tuple]:
            nonlocal shape
            for b in batches:
                shape = b.schema.field(0).type
                for part in slices(b, 1, SLICE):
                    ids, cuts = words.texts(part.column(1))
                    for i, doc in enumerate(part.column(0).to_pylist()):
                        yield doc, ids[cuts[i]: cuts[i + 1]]

        held: list[tuple] = []
        for row in pack_task(each(), window, TaskContext.get().partitionId() << 32):
            held.append(row)
            if len(held) >= 20_000:
                yield _batch(held, shape)
                held = []
        if held:
            yield _batch(held, shape)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)
