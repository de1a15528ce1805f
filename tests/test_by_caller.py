"""Two-hop rows of all callers: shuffled once, by caller, where no owner is a hub;
the same rows as the general way, which graphs with hubs take."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from amity.operators import common_friends as cf
from amity.operators import relations as rel
from amity.operators import roster as ro
from amity.plans import loaded
from amity.session import scratch_path
from amity.sources import fills
from amity.sources import snapshots as sn
from conftest import rows

SF = "/root/testdata/sf0.001"
ROSTER = "rosterID bigint, username string, loginAccount string, userID bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Self-loops, repeated rows, null accounts and ids, an account with several ids,
    ids of several accounts, a listed account that lists nobody."""
    rnd, data = random.Random(7), []
    for k in range(160):
        a, b = rnd.randrange(14), rnd.randrange(17)
        uid = None if b % 6 == 5 else b // 2 if b % 3 else b + 100 * rnd.randrange(3)
        data.append((k, None if k % 40 == 1 else f"u{a}", None if k % 40 == 2 else f"u{b}", uid))
    return spark.createDataFrame(data + data[:20], ROSTER)


@pytest.fixture()
def conf(spark):
    keys = []

    def put(key, value):
        keys.append(key)
        spark.conf.set(key, value)

    yield put
    for key in keys:
        spark.conf.unset(key)


def _callers(spark, how):
    return None if how == "all" else spark.createDataFrame([("u1",), ("u3",), ("u16",), ("nobody",), (None,)], "caller string")


@pytest.mark.parametrize("hot", ["4000000", "3"])
@pytest.mark.parametrize("how", ["all", "some"])
def test_the_same_rows_as_the_general_way(spark, odd, conf, monkeypatch, how, hot):
    general = replace(ro.FriendGraph.of(odd), has_hubs=None)
    asked = _callers(spark, how)
    q = (cf.common_friend_table, rel.relation_table_many, ro.two_hop_raw)
    want = [rows(f(general, asked)) for f in q]
    assert all(want)
    conf("amity.skew.hotRows", hot)
    g = ro.FriendGraph.of(odd)
    assert g.has_hubs is False
    monkeypatch.setattr(cf, "counts_by_id", None)       # no requests are formed
    assert [rows(f(g, asked)) for f in q] == want


@pytest.mark.parametrize("hot", ["4000000", "3"])
def test_relations_asked_by_many(spark, odd, conf, monkeypatch, hot):
    ask = spark.createDataFrame([(f"u{a}", str(u)) for a in range(18) for u in list(range(12)) + [109, 212]], "caller string, user_id string")
    g = ro.FriendGraph.of(odd)
    want = rows(rel.person_relation_many(replace(g, has_hubs=None), ask, include_strangers=True))
    assert {r[2] for r in want} == {1, 2, 3}
    if hot == "3":
        conf("amity.skew.hotRows", hot)     # ids that many requests name are expanded
    else:
        monkeypatch.setattr(rel, "_meeting", None)
    assert rows(rel.person_relation_many(g, ask, include_strangers=True)) == want


def test_a_hub_takes_the_general_way(spark, odd, monkeypatch):
    monkeypatch.setattr(ro, "PACKED_FRIENDS", 4)
    g = ro.FriendGraph.of(odd)
    assert g.has_hubs is True and not ro.by_caller(g, None)


def test_two_hop_rows_are_shuffled_once(spark, conf):
    """By caller alone; the only other shuffle by caller is that of the names."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = loaded.graph(spark, SF)
    for q in (cf.common_friend_table, rel.relation_table_many, ro.two_hop_raw):
        plan = q(g, None)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(cid#") == 2, q
        assert "hashpartitioning(dst#" not in plan.split("ShuffledHashJoin")[1].split("REPARTITION_BY_NUM")[0], q


def test_paths_set_the_tasks(spark, odd, monkeypatch):
    g = ro.FriendGraph.of(odd)
    deg = {r["src"]: r["degree"] for r in g.degrees.collect()}
    assert g.paths == sum(1 + deg.get(r["dst"], 0) for r in g.edges.collect()) > 500
    monkeypatch.setattr(ro, "PATHS_PER_TASK", 50)
    assert rel.relation_table_many(g, None).rdd.getNumPartitions() == -(-g.paths // 50)


def test_hot_accounts_are_loaded_by_several_tasks(spark, conf, monkeypatch):
    conf("amity.skew.hotRows", "5")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    roots = loaded._build(spark, SF)
    files = spark.read.parquet(roots["hot"]).select(F.input_file_name()).distinct().count()
    assert files > 1


def test_callers_that_lie_together_are_not_shuffled_again(spark):
    data = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("caller"), F.col("id").alias("x"))
    root, asked = scratch_path(spark, "t-together"), data.select("caller").distinct()
    fills.fill_missing(spark, root, 1, asked, lambda todo: data.join(todo, "caller", "left_semi").repartition(3, "caller"), together=True)
    got = spark.read.parquet(root).select("caller", F.input_file_name().alias("f"))
    assert got.select("f").distinct().count() == 3
    assert got.distinct().count() == 20
    assert rows(sn.derived_for(spark, root, 1, asked), "caller", "x") == rows(data, "caller", "x")
