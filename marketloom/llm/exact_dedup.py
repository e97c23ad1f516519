"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

Digests are counted with Misra-Gries (Spark's ``freqItems``), which names at most ``1 / support`` candidates and
misses no digest above that share. The candidates are counted exactly; those that hold are broadcast, so their
copies are settled where they are read. All other digests go through an ordinary grouped join in which no group
can exceed ``support`` of the rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, put_back
from marketloom.session import interim

#: Share of the rows from which a digest counts as heavy; at most 1 / SUPPORT rows are ever broadcast.
SUPPORT = 1 / 4096


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and all empty texts are
    one group. The largest id of a group stays. A group whose ids are all null keeps its rows (keep_id null).
    Rows that repeat both id and text can't be told apart and share one answer. An empty table gives no rows.
    """
    digest = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    rows = interim(docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256")))
    least = max(2, ceil(rows.count() * support))
    named = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = interim(
        rows.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = heavy.unionByName(light.join(groups, "text_sha256"))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat both id and text, one stays."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256").distinct()
    digest = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    rows = put_back(docs, kept, [("doc_id", F.col(id_col)), ("text_sha256", digest)])
    return one_per_text(rows, id_col, text_col)


def one_per_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One of the rows that repeat both id and text."""
    from pyspark.sql import Window

    same = Window.partitionBy(F.col(id_col), F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).orderBy(F.lit(1))
    return docs.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")
