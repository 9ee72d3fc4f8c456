"""Operators of a training-data pipeline: near-duplicate removal, vector search, mixing, line dedup, licence
scans, tokenisation and toxicity, all as Spark jobs over ``documents`` / ``embeddings`` tables.

Nothing outside this folder imports it (except the guard in ``__spark_entry__.py`` and ``corpus_pipeline.py``).
"""
