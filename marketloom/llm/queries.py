"""The queries of this folder, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import (
    exact_dedup, html_text, mixing, packing, pitman_yor, simhash, source_divergence, substring_bytes, substring_words, top_k, toxicity,
    vector_codes, vector_graph,
)
from marketloom.llm.common import WORD, read
from marketloom.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(use_utc(spark), sf_dir)
    return fn


@query
def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.linked_vectors(read(spark, sf_dir, "embeddings"))


@query
def op2_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("mixed_source")


@query
def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.drop_repeated_bytes(read(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.drop_repeated_passages(read(spark, sf_dir, "documents")).drop("n_spans")


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(read(spark, sf_dir, "documents"))


@query
def op13_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op6_source_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER before, 0))
            <= w * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0)) AS held
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, (sum(source_size) OVER () - 3 * sum(CASE WHEN held THEN source_size ELSE 0 END) OVER ())::BIGINT AS rest_words,
         (sum(CASE WHEN held THEN 0 ELSE w END) OVER ())::BIGINT AS rest_weight
  FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN held THEN (3 * source_size)::DOUBLE ELSE (w * rest_words)::DOUBLE / rest_weight::DOUBLE END AS target,
         CASE WHEN held THEN 3 * source_size ELSE (w * rest_words) // nullif(rest_weight, 0) END AS words
  FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, words // nullif(t.source_size, 0) AS times,
         words % nullif(t.source_size, 0) AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS there
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE times * size
         + CASE WHEN upto <= budget THEN size WHEN upto - there >= budget THEN 0
                ELSE ((budget - upto + there) * size) // there END END::BIGINT AS taken
FROM r
"""

ORACLE["op8_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _codes_sql(rounds: int = 4) -> str:
    """Assignments and means of each round as tables of their own, over one row per vector and component."""
    whole = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {whole}
), named AS (
  SELECT *, len(v) // 4 AS length, row_number() OVER (ORDER BY vec_id, v) AS place FROM kept
), x AS MATERIALIZED (
  SELECT vec_id, place, (i - 1) // length AS part, (i - 1) % length AS position, v[i] AS x
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM named)
), book0 AS MATERIALIZED (SELECT part, place - 1 AS entry, position, x AS c FROM x WHERE place <= 256)"""]
    for r in range(rounds + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
  SELECT place, part, min(d * 256 + entry) AS best
  FROM (SELECT place, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN book{r} USING (part, position) GROUP BY ALL) GROUP BY ALL
)""")
        if r < rounds:
            parts.append(f"""
mean{r} AS (
  SELECT part, best % 256 AS entry, position, sum(x) AS t, count(*) AS n FROM x JOIN near{r} USING (place, part) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT part, entry, position, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM book{r} LEFT JOIN mean{r} USING (part, entry, position)
)""")
    parts.append(f"""
codes AS (
  SELECT place, string_agg(printf('%02x', (best % 256)::BIGINT), '' ORDER BY part) AS code, sum(best // 256) AS error
  FROM near{rounds} GROUP BY place
), books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error::BIGINT AS error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN named USING (place), books
""")
    return ",".join(parts)


ORACLE["op11_hadamard_codes"] = _codes_sql()

ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS MATERIALIZED (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), c AS MATERIALIZED (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), v AS (SELECT lang, count(*) AS kinds, sum(m) AS lang_total FROM k GROUP BY lang),
g AS MATERIALIZED (
  SELECT s.lang, s.source, coalesce(kinds, 0) AS kinds, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v ON s.lang = v.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) n ON s.lang = n.lang AND s.source = n.source
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * kinds) AS p,
         1 + (1000000000::HUGEINT * (m + 2)) // (lang_total + 2 * kinds) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM items QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE["op13_histogram_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
