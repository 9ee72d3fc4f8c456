"""Stages of the corpus pipeline: each applies one operator's decisions to documents and keeps their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import curriculum, line_chunks, minhash, sp_viterbi, toxicity
from tillbook.llm.common import materialize, pack, read_table
from tillbook.llm.tokenizer_files import public


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents graded toxic go; the model is fitted on the labelled documents."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    graded = pack(docs).withColumn("s", toxicity.severity(F.col("row.text"), model))
    return graded.filter(~F.col("s.toxic")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts lose the multi-line chunks another document holds already; a document of which nothing
    is left goes."""
    cleaned = line_chunks.dedup_lines(docs).filter("n_removed = 0 or length(cleaned) > 0")
    return line_chunks.with_text(cleaned, docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each near-duplicate group the document with the smallest id stays.  Of rows that repeat its id
    and text one stays, another text under its id is a row of its own; of rows without id one of each exact text
    stays (null texts are equal)."""
    found = minhash.near_duplicates(docs)
    kept = materialize(found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("kept_id"))
                       .agg(F.count(F.lit(1)).alias("n_rows")), "kept")
    rows = pack(docs)
    named, same = rows.filter("row.doc_id is not null"), F.col("row.doc_id").cast("long") == F.col("kept_id")
    once = named.join(kept.filter("n_rows = 1"), same, "left_semi")
    often = named.join(kept.filter("n_rows > 1"), same, "left_semi")
    return once.select("row.*").unionByName(_one_of_each(often.unionByName(rows.filter("row.doc_id is null")), docs.columns))


def _one_of_each(rows: DataFrame, names: list[str]) -> DataFrame:
    """One of the rows that are equal in doc_id and text, the smallest by its other columns as JSON."""
    rest = [F.col(f"row.`{n}`").alias(n) for n in names if n not in ("doc_id", "text")]
    other = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    one = (rows.groupBy(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
           .agg(F.min_by(other, F.to_json(other)).alias("rest")))
    return one.select(*[F.col(n) if n in ("doc_id", "text") else F.col(f"rest.`{n}`").alias(n) for n in names])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each document as often as the mix takes it, in training order."""
    return curriculum.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: (doc_id, n_tokens, ids) of each document of the mix."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (sp_viterbi.encode(named, public("piece_bpe_32k.model"))
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))
