import pytest

import __spark_entry__ as entry
from scriptorium import catalogue


def test_names():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["t4_normalize_text", "c1_split_text", "k3_bm25_topk", "f2_search_weighted", "d4_session_summary"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
