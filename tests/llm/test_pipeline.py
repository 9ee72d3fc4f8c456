from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import SMALL, TEXTS, components, documents, shingle_set
from tillbook.llm import stages
from tillbook.llm.common import materialize


def test_stages_in_order_on_the_small_tables(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "mix_sources", "sentencepiece"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SMALL), name)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert not [i for i in gone if labels.get(i) == 0]
        if name == "minhash_near_dedup":
            sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
            ids = sorted(sets)
            linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
                      if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            root = components(ids, linked)
            assert sorted(r.doc_id for r in docs.collect()) == [i for i in ids if root[i] == i]
        if name == "mix_sources":
            counts = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert set(counts.values()) <= {1, 2} and set(counts) <= set(ids)
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_each_stage_takes_odd_rows_and_no_rows(spark):
    for rows in (TEXTS, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "sentencepiece" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if not rows else n > 0
    kept = stages.keep_one_of_each_group(spark, documents(spark, TEXTS), SMALL)
    assert kept.filter("doc_id is null").count() == 1


def test_one_row_of_repeated_ids_and_texts_stays(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, a), (1, a), (1, b), (2, a), (3, "x y z"), (3, "x y z"), (None, a), (None, a), (None, b), (None, None), (None, None)]
    docs = documents(spark, rows)
    kept = stages.keep_one_of_each_group(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
    assert [(i, t) for i, t, _ in got] == sorted([(1, a), (1, b), (3, "x y z"), (None, a), (None, b), (None, None)], key=str)
    bare = stages.keep_one_of_each_group(spark, docs.select("text", "doc_id"), SMALL)
    assert bare.columns == ["text", "doc_id"] and bare.count() == 6
