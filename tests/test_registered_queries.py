"""A sample of the registered queries against their SQL; check_queries.py runs them all."""

import importlib.util
import os

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
NAMES = ["p9_fingerprint", "r4_type_clusters", "m2_spearman", "m4_macro_auroc", "e2_fold_theta",
         "b9_next_item", "t6_window_agents", "m13_cluster_bootstrap"]


def load(name):
    spec = importlib.util.spec_from_file_location(name, f"{HERE}/{name}.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_queries_match_sql(spark):
    check, entry = load("check_queries"), load("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    con = check.connect(DATA)
    for name in NAMES:
        diff = check.compare(queries[name](spark, DATA).toPandas(), con.execute(sql[name]).df())
        assert diff is None, f"{name}: {diff}"
    assert entry.entry(spark).count() == 1
