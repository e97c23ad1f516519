"""Removing passages of words that an earlier document holds, with suffix automata of reference shards.

The reference of a document is all documents with a smaller id, so every shared passage is reference for someone. Shared
passages are dealt into shards by their triggers (see ``passages``); each shard's distinct stretches become one suffix
automaton whose states know the smallest document that holds them. The stretches are then streamed through it:
wherever the matching statistic reaches the window length, the state of the last ``length`` words tells the owner.
A shard is built and used in one task. Automata of the whole corpus have no size bound, so none is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.passages import NOBODY, Passage, by_pieces, cut, shared_spans, to_runs

WINDOW = 50


class SuffixAutomaton:
    """Of several sequences; every state knows the smallest owner of its substrings."""

    def __init__(self, sequences: list[list[int]], owners: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        self.owner = [NOBODY] * len(self.link)
        owner = self.owner
        for sequence, own in zip(sequences, owners):
            state = 0
            for symbol in sequence:
                state = self.next[state][symbol]
                if own < owner[state]:
                    owner[state] = own
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if owner[state] < owner[up]:
                owner[up] = owner[state]

    def _extend(self, last: int, symbol: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, symbol, known)
        new = len(link)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last >= 0 and symbol not in nexts[last]:
            nexts[last][symbol] = new
            last = link[last]
        if last >= 0:
            known = nexts[last][symbol]
            link[new] = known if length[known] == length[last] + 1 else self._clone(last, symbol, known)
        return new

    def _clone(self, last: int, symbol: int, known: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(link)
        nexts.append(dict(nexts[known]))
        length.append(length[last] + 1)
        link.append(link[known])
        link[known] = copy
        while last >= 0 and nexts[last].get(symbol) == known:
            nexts[last][symbol] = copy
            last = link[last]
        return copy

    def owners_of(self, sequence: list[int], window: int) -> Iterator[int]:
        """For each window of a streamed sequence the smallest owner that holds it, or ``NOBODY``."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = window
            if at >= window - 1:
                yield self.owner[state] if matched >= window else NOBODY


def look(window: int):
    def run(f: pd.DataFrame) -> list[tuple]:
        out = []
        for key, group in f.groupby("key"):
            sequences = [np.frombuffer(c, np.uint64).tolist() for c in group.content]
            shard = SuffixAutomaton(sequences, group.owner.tolist())
            for seg, sequence in zip(group.seg.tolist(), sequences):
                owners = np.fromiter(shard.owners_of(sequence, window), np.int64)
                out.append((key, seg, to_runs(owners < NOBODY, owners)))
        return out

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, n_spans, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. Null and
    short texts lose nothing; a null id is smaller than none and larger than none; rows that share an id are no
    reference for each other.
    """
    p = Passage(length=window, gram=gram, words=True, earlier=True)
    base, spans = shared_spans(docs, p, by_pieces(p, look(window)), id_col, text_col)
    return cut(base, spans, p).select("doc_id", F.col("size").alias("n_words"), "n_removed", "n_spans", "kept_sha256")
