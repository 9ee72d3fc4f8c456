import duckdb
import pytest
from pyspark.sql import functions as F

from llm.helpers import SMALL, TEXTS, WORDS, documents
from tillbook.llm import curriculum
from tillbook.llm.queries import ORACLE

WEIGHT = [5, 2, 1]


def water_level(sizes):
    """Targets by plain re-sharing: cap, share the excess by weight, repeat until nothing is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: WEIGHT[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= set(full)
    return target


def check(spark, rows):
    docs = documents(spark, rows)
    got = curriculum.mix_report(docs).collect()
    assert len(got) == len(rows)
    source = {i: f"src{(i or 0) % 3}" if i != 4 else None for i, _ in rows}
    sizes = {}
    for i, t in rows:
        sizes[source[i]] = sizes.get(source[i], 0) + len(WORDS.findall(t or ""))
    target, taken = water_level(sizes), {}
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and (r.first_slot == -1) == (r.taken == 0)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1
    again = curriculum.mix_report(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edge_cases(spark):
    check(spark, TEXTS)
    check(spark, [(i, "a b c " * (i + 1)) for i in range(40)] + [(4, "null source words")])


def test_empty_and_wordless_tables(spark):
    assert curriculum.mix_report(documents(spark, [])).count() == 0
    got = curriculum.mix_report(documents(spark, [(1, ""), (2, None)])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}
    assert curriculum.mix(documents(spark, [])).count() == 0


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(ORACLE["op2_curriculum_mix"]).fetchall()
    got = curriculum.mix_report(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("knots", [*curriculum.SCHEDULES, [(0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (1.0, 2.0)]])
def test_position_inverts_the_integral(spark, knots):
    """Integrating the schedule up to the position gives back the share."""
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for r in df.select("u", curriculum.position(F.col("u"), knots).alias("t")).collect():
        area = 0.0
        for (a, v), (b, w) in zip(knots, knots[1:]):
            x = min(max(r.t - a, 0), b - a)
            area += v * x + (w - v) / (b - a) * x * x / 2
        assert area == pytest.approx(r.u * curriculum.integral(knots), abs=1e-9)


def test_mix_is_in_training_order_and_whole(spark):
    rows = [(i, f"t{i} " * (3 + i % 7)) for i in range(200)]
    docs = documents(spark, rows)
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.select("doc_id").collect()]
    plan = {r.doc_id: r for r in curriculum.mix_report(docs).collect()}
    assert {i: ids.count(i) for i in set(ids)} == {i: round(r.taken / r.size + 1e-9) for i, r in plan.items() if round(r.taken / r.size + 1e-9)}
    first = [plan[i].first_slot for n, i in enumerate(ids) if i not in ids[:n]]
    assert first == sorted(first)


def test_report_is_in_training_order(spark):
    report = curriculum.mix_report(documents(spark, [(i, f"t{i} " * (3 + i % 7)) for i in range(300)]))
    got = [(r.first_slot, r.doc_id) for r in report.collect()]
    assert got == sorted(got) and len(got) == 300 and len({s for s, _ in got}) > 100
    assert "rangepartitioning(first_slot" in report._jdf.queryExecution().toString()


def test_no_python_on_the_plan(spark):
    text = curriculum.mix_report(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
