"""Decision cycles as a stream: each account's book is keyed state, walked by the same :class:`Book` as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gates import SafeguardConfig
from ..session import keyed_state
from ..plans.sequence import END, HELD_FIELDS, ORDER, READ, WALK_TYPES, Book, walked_table

HELD_DDL = "place bigint, symbol string, " + ", ".join(f"{x} double" for x in HELD_FIELDS[2:-1]) + ", opened_at bigint"


class BookProcessor(StatefulProcessor):
    """Map state of open positions and of realised profit per day, and one row of numbers, per account.

    A micro-batch brings whole cycles of an account, later than those it brought before; one that is not later fails
    the stream, since the book has gone on.
    """

    def __init__(self, safeguard: SafeguardConfig) -> None:
        self.safeguard = safeguard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "decision_id string", HELD_DDL)
        self.days = handle.getMapState("days", "day bigint", "gain double")
        self.numbers = handle.getValueState("numbers", "base double, realized double, peak double, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(ORDER, na_position="first", kind="stable", ignore_index=True)
        book, last = Book(self.safeguard), None
        if self.numbers.exists():
            *numbers, last = self.numbers.get()
            if numbers[0] is not None:
                book.start(*numbers)
            book.held = {name: list(p) for _, name, p in sorted((row[0], k[0], row[1:]) for k, row in self.held.iterator())}
            book.days = {k[0]: v[0] for k, v in self.days.iterator()}
        moments = pdf.loc[pdf["kind"] != END, "at"]
        if last is not None and len(moments) and moments.min() <= last:
            raise ValueError(f"account {key[0]}: a cycle came after a later one")
        before = dict(book.held)
        made, plans, results = [], [], []
        book.feed({x: pdf[x].tolist() for x in READ}, 0, len(pdf), made, plans, results)
        written: list = []
        book.refresh(written)  # a last cycle may have marks and no plans
        made += [(*x, key[0]) for x in written]
        for name in before.keys() - book.held.keys():
            self.held.removeKey((name,))
        for place, (name, p) in enumerate(book.held.items()):
            self.held.updateValue((name,), (place, *p[:-1], int(p[-1])))
        for day, gain in book.days.items():
            self.days.updateValue((int(day),), (gain,))
        self.numbers.update((book.base, book.realized, book.peak, int(moments.max()) if len(moments) else last))
        yield walked_table(pdf, made, plans, results)

    def close(self) -> None:
        pass


def book_stream(rows: DataFrame, safeguard: SafeguardConfig = SafeguardConfig()) -> DataFrame:
    """Walk a stream of rows as :func:`marketloom.plans.sequence.walk_rows` makes them; ``split_walk`` names its results."""
    keyed_state(rows.sparkSession)
    types = {"account_id": rows.schema["account_id"].dataType.simpleString(), **WALK_TYPES}
    return rows.groupBy("account_id").transformWithStateInPandas(
        statefulProcessor=BookProcessor(safeguard), outputStructType=", ".join(f"{x} {t}" for x, t in types.items()),
        outputMode="append", timeMode="none")
