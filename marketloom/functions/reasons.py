"""Ordered reason codes: the shared shape of every rule gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def reason_codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Codes of the rules that fire, in rule order. An undecidable (NULL) condition does not fire."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """Only the first code that fires (cascading gates), NULL if none does."""
    chain = F.lit(None).cast("string")
    for cond, code in reversed(list(rules)):
        chain = F.when(cond, F.lit(code)).otherwise(chain)
    return chain


def passes(reasons: Column) -> Column:
    return F.size(reasons) == 0


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def not_positive(c: Column) -> Column:
    return not_finite(c) | (c <= 0.0)


def negative(c: Column) -> Column:
    return not_finite(c) | (c < 0.0)


def outside_unit(c: Column) -> Column:
    return not_finite(c) | (c < 0.0) | (c > 1.0)
