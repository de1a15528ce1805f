"""Friend graph operators on hand-made edge tables (self-loops, asymmetric
edges, a caller without edges, duplicate candidates)."""

from conftest import rows
from pyspark.sql import functions as F

from amity.operators import common_friends as cf
from amity.operators import relations as rel
from amity.operators import roster as ro

SCHEMA = "rosterID bigint, username string, loginAccount string, userID bigint"


def edges(spark, pairs):
    ids = {n: i for i, n in enumerate("abcdefghijklmnopqrstuvwxyz", start=1)}
    data = [(k, u, la, ids[la]) for k, (u, la) in enumerate(pairs, start=1)]
    return spark.createDataFrame(data, SCHEMA)


def test_load_filter(spark):
    view = spark.createDataFrame(
        [(1, "a", "b", 2, 3), (2, "a", "c", None, 3), (3, "a", "d", 4, 1)],
        "rosterID bigint, username string, loginAccount string, userID bigint, sub int")
    assert rows(ro.load_roster(view)) == [(1, "a", "b", 2)]


def test_selfloop(spark):
    r = edges(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")])
    assert rows(ro.friends_one_hop(r, "a")) == [("b",)]
    # raw two hop keeps the friend's own self-loop
    assert rows(ro.friends_two_hop_raw(r, "a")) == [("b",), ("c",)]
    assert rows(ro.friends_two_hop_strict(r, "a")) == [("c",)]
    assert rows(ro.friends_reachable(r, "a")) == [("b",), ("c",)]


def test_raw_two_hop_contains_caller_and_friends(spark):
    r = edges(spark, [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "d")])
    assert rows(ro.friends_two_hop_raw(r, "a")) == [("a",), ("c",), ("d",)]
    assert rows(ro.friends_two_hop_strict(r, "a")) == [("d",)]


def test_empty_caller(spark):
    r = edges(spark, [("a", "b")])
    assert ro.friends_one_hop(r, "z").count() == 0
    assert ro.friends_two_hop_raw(r, "z").count() == 0
    assert rel.relation_table(r, "z").count() == 0


def test_common_friends_duplicates_order_zero_fill(spark):
    r = edges(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "a"), ("a", "a")])
    cands = spark.createDataFrame([(0, "b"), (1, "c"), (2, "b"), (3, "z"), (4, "a")], "pos int, username string")
    got = rows(cf.common_friend_count(r, "a", cands))
    # a itself: own degree without the self-loop (x, y); c lists a, never counted
    assert got == [(0, "b", 2), (1, "c", 1), (2, "b", 2), (3, "z", 0), (4, "a", 2)]


def test_common_friends_asymmetric(spark):
    # a -> b and c -> b, nothing back: one common friend, but c is not
    # reachable from a, so the cached-domain table leaves it out
    r = edges(spark, [("a", "b"), ("c", "b")])
    cands = spark.createDataFrame([(0, "c")], "pos int, username string")
    assert rows(cf.common_friend_count(r, "a", cands)) == [(0, "c", 1)]
    assert cf.common_friend_table(r, "a").count() == 0


def test_common_friend_table(spark):
    r = edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("d", "c")])
    got = rows(cf.common_friend_table(r, "a"), "userName", "comFriendsNum")
    # reachable: b, c (one hop), d (two hops); counts with A(a) = {b, c}
    assert got == [("b", 1), ("d", 1)]


def test_relations(spark):
    r = edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "a"), ("d", "e")])
    got = rows(rel.relation_table(r, "a"))
    assert got == [("2", 1), ("3", 1), ("4", 2)]
    ids = spark.createDataFrame([("4",), ("4",), ("9",), ("2",)], "user_id string")
    assert rows(rel.person_relation(r, "a", ids)) == [("2", 1), ("4", 2)]
    assert rows(rel.person_relation(r, "a", ids, include_strangers=True)) == [("2", 1), ("4", 2), ("9", 3)]


def test_many_callers_equal_single(spark):
    r = edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "a"), ("d", "e"), ("e", "a")])
    callers = spark.createDataFrame([("a",), ("b",), ("e",)], "caller string")
    many = rows(rel.relation_table_many(r, callers))
    single = sorted((c,) + t for c in "abe" for t in rows(rel.relation_table(r, c)))
    assert many == single
    many_cf = rows(cf.common_friend_table(r, callers))
    single_cf = sorted((c,) + t for c in "abe" for t in rows(cf.common_friend_table(r, c), "userName", "comFriendsNum"))
    assert many_cf == single_cf


def _brute_common(pairs, c, u):
    a = {(x, y) for x, y in pairs if x != y}
    fc = {y for x, y in a if x == c}
    fu = {y for x, y in a if x == u}
    return len(fc & fu)


def test_hot_keys_split_same_result(spark):
    # a hub h listed by everyone; force every account with degree > 2 hot
    names = "abcdefghij"
    pairs = [(n, "h") for n in names if n != "h"] + [("h", n) for n in names if n != "h"]
    pairs += [("a", "b"), ("b", "c"), ("c", "a")]
    r = edges(spark, pairs)
    callers = spark.createDataFrame([(n,) for n in names], "caller string")
    plain = rows(cf.common_friend_table(r, callers))
    spark.conf.set("amity.skew.hotRows", "2")
    try:
        g = ro.FriendGraph.of(r)
        assert g.hot.count() >= 1
        salted = rows(cf.common_friend_table(g, callers))
        rel_salted = rows(rel.relation_table_many(g, callers))
        all_salted = rows(rel.relation_table_many(g, None))
    finally:
        spark.conf.unset("amity.skew.hotRows")
    assert salted == plain
    assert rel_salted == rows(rel.relation_table_many(r, callers))
    assert all_salted == rel_salted  # every caller of the test graph is an owner
    for c, u, n in plain:
        assert n == _brute_common(pairs, c, u)


def test_hub_is_dealt_over_a_grid(spark):
    """A hub with 300 owners and 300 friends: 90,000 two-hop rows of one key, in
    cells of about the target size, and the same rows as the plain join."""
    from amity.plans.skew import hot_keys, skew_join
    left = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("l")).union(
        spark.range(5).select(F.lit(2), F.col("id")))
    right = left.withColumnRenamed("l", "r")
    grid = hot_keys(left, right, ["k"], 1000).collect()
    assert [(g["k"], g["_sl"], g["_sr"]) for g in grid] == [(1, 10, 9)]
    got = skew_join(left, right, ["k"], hot_rows=1000)
    assert got.count() == 300 * 300 + 25 == got.distinct().count()
