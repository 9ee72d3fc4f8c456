"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_all_queries_match_duckdb(spark):
    from oracle_check import compare
    res = compare(spark, "/root/testdata/sf0.001", verbose=True)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS-ONLY")}
    assert not bad, bad
