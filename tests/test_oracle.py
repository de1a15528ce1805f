"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as se
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(se.queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF, name, se.queries()[name], se.oracle_sql().get(name), con)
    assert res["ok"], res


GRAPH_QUERIES = ("friends_two_hop_raw", "friends_two_hop_strict", "common_friend_count",
                 "common_friend_table", "relation_table", "common_friend_all_callers",
                 "relation_all_callers", "two_hop_raw_all_callers", "common_friend_count_many")


def test_loaded_graph_with_hot_accounts(spark, con, monkeypatch):
    """A load whose hot threshold is tiny, so many accounts are hot: the
    bucketed tables are joined cold-on-bucket plus salted-hot, and every
    graph query still equals its oracle."""
    from amity.plans import loaded
    spark.conf.set("amity.skew.hotRows", "3")
    try:
        roots = loaded._build(spark, SF)
        key = (spark.sparkContext.applicationId, SF)
        monkeypatch.setitem(loaded._LOADED, key, roots)
        assert loaded.hot(spark, SF).count() > 10
        for name in GRAPH_QUERIES:
            res = compare(spark, SF, name, se.queries()[name], se.oracle_sql()[name], con)
            assert res["ok"], res
    finally:
        spark.conf.unset("amity.skew.hotRows")
