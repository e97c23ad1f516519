"""Tamper audit of hash-chained journals.

Every line is checked on its own and against its predecessor, which it meets in a group of
(journal, sequence). That spreads a journal of any length; nothing walks it in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS_HASH = "0" * 64
LINK_DDL = "sequence bigint, previous_hash string, entry_hash string"


def audit_journal(lines: DataFrame, journal: str = "journal_id", line: str = "value") -> DataFrame:
    """One row per line with ``failure``: NULL, SEQUENCE, HASH_CHAIN or ENTRY.

    The hash covers the line's own canonical bytes: keys are sorted and compact, so removing the hash
    field restores them. Sequences must be 1..n without gap or repeat.
    """
    text = F.col(line)
    rows = (
        lines.where(F.trim(text) != "")
        .withColumn("_l", F.from_json(text, LINK_DDL))
        .select(
            journal, "_l.*",
            F.sha2(F.regexp_replace(text, r'^\{"entry_hash":"[0-9a-f]{64}",', "{"), 256).alias("computed_hash"),
        )
    )
    # A line once as itself and once as the predecessor of the next: lines are read, parsed and hashed once, nothing is joined.
    itself = F.struct("sequence", "previous_hash", "entry_hash", "computed_hash", F.lit(True).alias("_own"))
    none = F.lit(None).cast("string")
    ahead = F.struct((F.col("sequence") + 1).alias("sequence"), none.alias("previous_hash"), F.col("entry_hash"),
                     none.alias("computed_hash"), F.lit(False).alias("_own"))
    both = rows.select(journal, F.explode_outer(F.array(itself, ahead)).alias("_x")).select(journal, "_x.*")
    both = both.where("_own OR sequence IS NOT NULL")
    apart = F.when(F.col("sequence").isNull(), F.col("computed_hash"))  # lines without a sequence meet nothing
    same = Window.partitionBy(journal, "sequence", apart)
    joined = both.withColumns({
        "_before": F.min(F.when(~F.col("_own"), F.col("entry_hash"))).over(same), "_copies": F.count_if("_own").over(same)}).where("_own")
    seq = F.col("sequence")
    broken_order = (
        seq.isNull() | (seq < 1) | (F.col("_copies") > 1) | ((seq > 1) & F.col("_before").isNull())
    )
    expected = F.when(seq == 1, F.lit(GENESIS_HASH)).otherwise(F.col("_before"))
    failure = (
        F.when(broken_order, "SEQUENCE")
        .when(F.coalesce(F.col("previous_hash") != expected, F.lit(True)), "HASH_CHAIN")
        .when(F.coalesce(F.col("entry_hash") != F.col("computed_hash"), F.lit(True)), "ENTRY")
    )
    return joined.select(journal, "sequence", "previous_hash", "entry_hash", "computed_hash", failure.alias("failure"))


def journal_summary(audit: DataFrame, journal: str = "journal_id") -> DataFrame:
    """Per journal: entries, first bad sequence and its failure; intact means neither."""
    bad = F.when(F.col("failure").isNotNull(), F.struct("sequence", "failure"))
    return audit.groupBy(journal).agg(
        F.count(F.lit(1)).alias("entries"), F.max("sequence").alias("last_sequence"), F.min(bad).alias("_f")
    ).select(
        journal, "entries", "last_sequence", F.col("_f.sequence").alias("first_bad_sequence"),
        F.col("_f.failure").alias("failure"), F.col("_f").isNull().alias("intact"),
    )


def require_intact(summary: DataFrame) -> DataFrame:
    message = F.concat(F.lit("journal integrity failure: "), F.col("failure"))
    return summary.withColumn("intact", F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(message)))
