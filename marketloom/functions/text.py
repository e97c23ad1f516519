"""Text rules: strict timestamps and the direct-order guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col

# Fixed value: wording a research hypothesis must not contain.
DIRECT_ORDER_PATTERN = (
    r"(?i)\b(execute|place|send)\s+(a\s+)?(live\s+)?(order|trade)\b|\b(buy|sell)\s+[A-Z]{1,6}\s+now\b"
)
ZONE_SUFFIX = r"(Z|z|[+-]\d\d:?\d\d)$"


def parse_zoned_time(text: str | Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is refused (NULL)."""
    raw = F.trim(as_col(text))
    return F.when(raw.rlike(ZONE_SUFFIX), F.try_to_timestamp(raw))


def has_direct_order(text: str | Column) -> Column:
    return as_col(text).rlike(DIRECT_ORDER_PATTERN)


def hypothesis_text(
    hypothesis: str | Column,
    proposed_change: str | Column,
    *lists: str | Column,
) -> Column:
    parts = [as_col(hypothesis), as_col(proposed_change), *[F.array_join(as_col(a), " ") for a in lists]]
    return F.concat_ws(" ", *parts)
