"""How far the vocabularies of sources lie apart, exactly, and which terms set a source apart from its language.

Counts are gathered once: tasks count the terms of whole texts into tables of a bounded size, which Spark adds up by
(lang, source, term). What follows works on counts.

* A source's terms are not ranked one by one. All terms with equal (count in the source, count in the language) have equal
  values, so values are computed per cell of these two counts; cells of equal value are merged, their terms counted from
  the highest value down, and only the cells that the wanted ranks reach are expanded to terms.
* Pairs of sources add a value over all kept terms. Each task holds some terms of one language as a table of
  terms x sources and sends one sum per pair of sources, so no term's pairs are ever rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import interim

#: A to Z become small, a to z and all bytes of other characters stay, the rest parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ONE = 1_000_000_000


@dataclass(frozen=True)
class DivergenceSettings:
    least_docs: int = 10  # documents of a language that must hold a term
    ranks: int = 10  # of the terms of a source
    held: int = 400_000  # counters a task holds before it sends them on
    piece: int = 1 << 20  # bytes of a long text cut into terms at once
    cells: int = 1 << 18  # of a block of terms x sources


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text, in lists: maximal runs of letters A-Z (made small), a-z and characters beyond ASCII."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            cut = cut if cut > at else text.find(b" ", end)
            end = cut if cut > 0 else len(text)
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch], s: DivergenceSettings) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0
    for b in batches:
        langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        for lang, source, text in zip(langs, sources, texts):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in terms_of(text.as_py(), s.piece):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held >= s.held:
                yield from _sent(seen)
                seen, held = {}, 0
    yield from _sent(seen)


def _sent(seen: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in seen.items():
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()),
            "term": pa.array([t.decode("utf-8", "replace") for t in n], pa.string()),
            "n": pa.array(list(n.values()), pa.int64()), "docs": pa.array([docs[t] for t in n], pa.int64()),
        })


def term_counts(docs: DataFrame, settings: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """Occurrences and documents of each term per lang and source: lang, source, term, n, docs.

    ``docs`` needs lang, source, text; nulls count as ''. Rows that repeat are documents each.
    """
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named = named.withColumn("text", F.col("text").cast("binary"))
    parts = named.mapInArrow(lambda b: _count(b, settings), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)) in whole numbers; null without kept terms."""
    top = F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, F.nullif((total + 2 * kinds).cast("decimal(19,0)"), F.lit(0)))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(block: pd.DataFrame, cells: int) -> pd.DataFrame:
    """Sums over a block's terms for each two sources: lang, a, b, value; rows without a term name sources and their p0."""
    base = block[block.term.isna()].sort_values("source")
    sources, p0 = base.source.to_numpy(), base.p.to_numpy(np.int64, na_value=1)
    held = block[block.term.notna()]
    term, kinds = pd.factorize(held.term)
    source = pd.Index(sources).get_indexer(held.source)
    p = held.p.to_numpy(np.int64, na_value=1)
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    sums = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, cells // max(len(sources), 1))
    for at in range(0, len(kinds), step):
        some = slice(*np.searchsorted(term, [at, at + step]))
        table = np.tile(p0[:, None], (1, min(step, len(kinds) - at)))
        table[source[some], term[some] - at] = p[some]
        for i in range(len(sources) - 1):
            d = table[i + 1:] - table[i]
            sums[i, i + 1:] += (d * d // (table[i + 1:] + table[i])).sum(1)
    i, j = np.triu_indices(len(sources), 1)
    return pd.DataFrame({"lang": block.lang.iloc[0], "a": sources[i], "b": sources[j], "value": sums[i, j]})


def source_divergence(docs: DataFrame, settings: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """Each source against the others of its language (part 'pair') and its most telling terms (part 'term').

    Columns lang, source, part, item, value, rank. Null texts, langs and sources count as ''. Sources without terms are
    compared too, with every kept term at count 0; in a language without kept terms values are 0. Equal values are
    ordered by the item's UTF-8 bytes. A language of one source has no pairs. Rows that repeat are documents each. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    s = settings
    counts = interim(term_counts(docs, s))
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("docs")).where(F.col("docs") >= s.least_docs)
    kept = interim(counts.drop("docs").join(terms.drop("docs"), ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["kinds", "lang_total", "total"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kinds") * F.count(F.lit(1)).over(Window.partitionBy("lang")) / s.cells)).cast("int")
    groups = interim(groups.withColumn("blocks", blocks))
    return _pairs(groups, kept, s).unionByName(_terms(groups, kept, s))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(down).alias("rank"))


def _pairs(groups: DataFrame, kept: DataFrame, s: DivergenceSettings) -> DataFrame:
    base = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("string").alias("term"), _share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")).alias("p"))
    held = kept.join(groups, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term",
        _share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    sums = base.unionByName(held).groupBy("lang", "block").applyInPandas(
        lambda block: _pair_sums(block, s.cells), "lang string, a string, b string, value long")
    once = interim(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return _ranked(both, "pair")


def _terms(groups: DataFrame, kept: DataFrame, s: DivergenceSettings) -> DataFrame:
    cells = kept.groupBy("lang", "source", "n", "m").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("kinds"))
    q = _share(F.col("m"), F.col("lang_total"), F.col("kinds"))
    cells = cells.select("lang", "source", "n", "m", "terms", p.alias("p"), q.alias("q")).where("p > q")
    cells = interim(cells.withColumn("value", _apart(F.col("p"), F.col("q"))))
    # Each merged value has a term at least, so no more values than ranks are reached.
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(own)).where(F.col("place") <= s.ranks)
    values = values.withColumn("upto", F.sum("terms").over(own)).where(F.col("upto") - F.col("terms") < s.ranks)
    reached = cells.join(values.select("lang", "source", "value"), ["lang", "source", "value"])
    rows = kept.join(reached.select("lang", "source", "n", "m", "value"), ["lang", "source", "n", "m"])
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), "value"), "term").where(F.col("rank") <= s.ranks)
