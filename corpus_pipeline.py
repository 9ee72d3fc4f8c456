"""The training-data pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import stages
from tillbook.llm.common import materialize, read_table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("mix_sources", stages.mix_sources),
    ("sentencepiece", stages.encode_pieces),
]

# Hash-based chunk boundaries, minima and a fitted classifier have no SQL form; the stages are tested against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows cut from the lineage in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
