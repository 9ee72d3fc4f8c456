"""Name lists in parts (D16, D25) and the search through grams (B4), against plain Python and the scan."""

import uuid

import pytest

from tests.helpers import products
from tillbook.operators import name_lists
from tillbook.operators.inventory import search_products
from tillbook.plans.session import scratch_dir
from tillbook.sources import name_index


def _parts(df, key):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (str(r[key]), r.part_no)):
        found.setdefault(r[key], []).append(list(r.names))
        assert r.n_names == len(r.names) and r.part_no == len(found[r[key]])
    return found


@pytest.mark.parametrize("run_rows", [7, 1 << 20])
def test_parts_of_a_hot_key(spark, run_rows):
    rows = [("hot", f"n{i % 40:03d}", i) for i in range(100)] + [("one", "x", 1), ("one", None, 0), (None, "y", 2), ("one", "x", 1)]
    df = spark.createDataFrame(rows, "kind string, name string, id int")
    found = _parts(name_lists.numbered_parts(df, "kind", ["name", "id"], size=8, run_rows=run_rows), "kind")
    hot = sorted((n, i) for k, n, i in rows if k == "hot")
    assert [len(p) for p in found["hot"]] == [8] * 12 + [4]
    assert sum(found["hot"], []) == [n for n, _ in hot]
    assert found["one"] == [[None, "x", "x"]] and found[None] == [["y"]]


def test_parts_of_nothing(spark):
    df = spark.createDataFrame([], "kind string, name string, id int")
    assert name_lists.numbered_parts(df, "kind", ["name", "id"]).count() == 0


def test_parts_join_to_the_whole_lists(spark, model):
    from tillbook.operators.inventory import ingredient_product_names
    found = _parts(name_lists.ingredient_name_lists(model["product_ingredients"], model["products"], size=3), "raw_material_id")
    want = {}
    for r in ingredient_product_names(model["product_ingredients"], model["products"]).collect():
        want.setdefault(r.raw_material_id, []).append(r.product_name)
    assert {k: sum(v, []) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(len(p) for v in found.values() for p in v) <= 3


@pytest.fixture(scope="module")
def shelf(spark):
    names = ["Brown Bread", "bread roll", "Brioche", "Ab", "a", "", None, "Crème brûlée", "xbreadbread", "bre ead", "İstanbul ab", "50% off_a"]
    return products(spark, [(i, n, "Bread", "1", "1", 1, 1, i % 5 != 3) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def index(spark, shelf):
    out = scratch_dir(spark, f"names-{uuid.uuid4().hex}")
    name_index.write_name_index(spark, shelf, out)
    return out


@pytest.mark.parametrize("q", ["bread", "BREAD", "br", "b", "a", "ab", "rea", "ûlé", "eadbre", "% of", "_", "zzz", "", None, "bread roll and more", "\u0000"])
def test_index_equals_scan(spark, shelf, index, q):
    found = name_index.search(spark, index, shelf, "All", q)
    want = search_products(shelf, "All", q)
    assert sorted(r.product_id for r in found.collect()) == sorted(r.product_id for r in want.collect())


def test_search_pushes_its_grams_down(spark, shelf, index):
    plan = name_index.search(spark, index, shelf, None, "bread")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [bre,ead,rea])" in plan
    plan = name_index.search(spark, index, shelf, None, "br")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,br)" in plan


def test_index_of_no_products(spark, shelf):
    out = scratch_dir(spark, f"names-{uuid.uuid4().hex}")
    name_index.write_name_index(spark, shelf.limit(0), out)
    assert name_index.search(spark, out, shelf.limit(0), "All", "bread").count() == 0
