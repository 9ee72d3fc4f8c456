"""Registered queries of the operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (curriculum, exact_topk, graph_ann, html_extract, license_scan, line_chunks, minhash, prefix_trie,
                          sp_viterbi, spelling, token_counts, token_files, toxicity)
from tillbook.llm.common import read_table
from tillbook.llm.tokenizer_files import public

END_ID = 2                 # closes each document in the token files


def _asks() -> Column:
    """The query set of both searches."""
    return F.col("vec_id") % 20 == 0


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every query vector."""
    return graph_ann.graph_top_k(read_table(spark, sf_dir, "embeddings"), _asks(), 20)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return curriculum.mix_report(read_table(spark, sf_dir, "documents"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and removed, length and checksum of each cleaned text."""
    found = line_chunks.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed",
                        F.octet_length("cleaned").cast("long").alias("n_bytes"),
                        F.crc32(F.col("cleaned").cast("binary")).alias("text_crc32"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases and labels of each document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of highest integer inner product for every query vector."""
    return exact_topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), _asks(), 20)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's range and checksum, as read back from the token files."""
    docs = read_table(spark, sf_dir, "documents")
    return token_files.token_files_digest(docs, public("word_bpe_49k.json"), END_ID).drop("shard")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether decoding them gives the text again."""
    return sp_viterbi.digest(read_table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of each document."""
    return toxicity.grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of each document."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Much more frequent near word, if any, and root of each word."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_graph_ann, op2_curriculum_mix, op3_line_chunks, op4_license_scan, op5_token_counts, op6_exact_topk, op7_token_files,
    op8_sentencepiece, op9_toxicity, op10_minhash, op11_prefix_trie, op12_html_extract, op13_spelling_variants)}

ORACLE = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_curriculum_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM src),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
t AS (SELECT 1.5::DOUBLE * sum(source_size) AS words, sum(weight) AS weight FROM w),
-- sources in the order in which they reach their caps; the level after the first k of them are capped
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT k, cap / weight AS ratio,
    (SELECT words FROM t) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE) AS rest,
    (SELECT weight FROM t) - coalesce(sum(weight) OVER b, 0) AS left_weight
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest / left_weight AS level FROM l WHERE rest / left_weight <= ratio ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, kind, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM level)) AS target FROM o),
p AS (SELECT d.*, g.source_size, g.kind, g.target, CAST(floor(g.target) AS BIGINT) AS whole,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, greatest(0, least(size, whole - start)) AS one, greatest(0, least(size, whole - source_size - start)) AS two FROM p),
u AS (SELECT *, CASE WHEN one > 0 THEN CAST(start AS DOUBLE) / whole WHEN two > 0 THEN CAST(source_size + start AS DOUBLE) / whole END AS share FROM e)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  COALESCE(CAST(floor(1000000 * CASE WHEN share IS NULL THEN NULL WHEN share <= 0 THEN 0.0::DOUBLE
    WHEN kind = 0 THEN 2.0::DOUBLE * (share * 5.0::DOUBLE) / (7.5::DOUBLE + sqrt(56.25::DOUBLE + -10.0::DOUBLE * (share * 5.0::DOUBLE)))
    WHEN kind = 1 THEN 2.0::DOUBLE * (share * 2.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 0.0::DOUBLE * (share * 2.0::DOUBLE)))
    ELSE 2.0::DOUBLE * (share * 1.0::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE))) END) AS BIGINT), -1) AS first_slot
FROM u""",
}
