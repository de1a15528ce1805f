"""Plans of the friend-graph queries on the loaded tables: which folders are read,
what is shuffled, and how hubs lie on disk."""

import pytest
from pyspark.sql import functions as F

from amity.operators import common_friends as cf
from amity.operators import relations as rel
from amity.operators import roster as ro
from amity.plans import loaded
from amity.session import scratch_path
from test_paging import _parts_read

SF = "/root/testdata/sf0.001"


def scans(df, of):
    """For every file scan of the planned frame whose columns are ``of``: the names
    of the nodes above it, nearest first."""
    found = []

    def walk(node, above):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.initialPlan(), above)
        if name == "FileSourceScanExec" and set(of) <= {a.name() for a in _each(node.output())}:
            found.append(above[::-1])
        for child in _each(node.children()):
            walk(child, [*above, name])

    walk(df._jdf.queryExecution().executedPlan(), [])
    return found


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.fixture(scope="module")
def graph(spark):
    return loaded.graph(spark, SF)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_second_hop_of_one_caller_reads_some_folders(spark, graph):
    caller = graph.roster.groupBy("username").count().orderBy("count").first()["username"]
    cid = ro.caller_ids(graph, caller)
    hop = ro.second_hop_of_one(graph, cid)
    friends = [r["dst"] for r in graph.edges.where(F.col("src") == cid).collect()]
    wanted = {f % graph.hop_parts for f in friends}
    assert len(wanted) < graph.hop_parts
    read = _parts_read(hop)
    assert min(read) <= len(wanted) and all(n < graph.hop_parts for n in read)
    for q in (ro.friends_two_hop_raw(graph, caller), rel.relation_table(graph, caller)):
        assert "dynamicpruning" in q._jdf.queryExecution().toString().lower()


def test_second_hop_without_a_broadcast(spark, graph, monkeypatch):
    caller = "Customer#000000005"
    near = sorted(map(tuple, ro.friends_two_hop_raw(graph, caller).collect()))
    monkeypatch.setattr(ro, "BROADCAST_FRIENDS", 1)
    far = ro.friends_two_hop_raw(graph, caller)
    assert "dynamicpruning" not in far._jdf.queryExecution().toString().lower()
    assert sorted(map(tuple, far.collect())) == near


def test_common_friends_leave_the_edges_where_they_are(spark, graph, no_broadcast):
    """The packed friends meet the requests in a join without a shuffle of theirs."""
    counts = cf.common_friend_table(graph, None)
    packed = scans(counts, ["src", "ids"])
    assert len(packed) == 2
    for above in packed:
        upto = next(i for i, name in enumerate(above) if "Join" in name)
        assert not any("Exchange" in name for name in above[:upto]), above


def test_relations_of_asked_ids_build_no_two_hop_set(spark, graph, no_broadcast):
    """Edges into the asked ids are read by id; no scan of raw edges or hops, and
    the owner-keyed edges are only met on the caller's side."""
    ids = spark.createDataFrame([("3",), ("7",), ("3",), ("x",), ("07",), (None,)], "user_id string")
    q = rel.person_relation(graph, "Customer#000000005", ids)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "hops-" not in plan
    whole = {r["user_id"]: r["type"] for r in rel.person_relation(graph, "Customer#000000005", spark.createDataFrame(
        [(str(i),) for i in range(200)], "user_id string")).collect()}
    table = {r["userID"]: r["friendType"] for r in rel.relation_table(graph, "Customer#000000005").collect()}
    assert whole == table
    got = {r["user_id"]: r["type"] for r in q.collect()}
    assert got == {k: v for k, v in table.items() if k in ("3", "7")}
    strangers = {r["user_id"]: r["type"] for r in rel.person_relation(
        graph, "Customer#000000005", ids.where("user_id is not null"), include_strangers=True).collect()}
    assert strangers == {k: table.get(k, 3) for k in ("3", "7", "x", "07")}


def test_a_hub_is_written_by_several_tasks(spark):
    """2,000 accounts list the hub and it lists 2,000: its edges are several files
    of its bucket, ordinary buckets stay one file each, and joins still find all."""
    hub = 7
    edges = (spark.range(2_000).select((F.col("id") + 100).alias("src"), F.lit(hub).cast("bigint").alias("dst"))
             .unionByName(spark.range(2_000).select(F.lit(hub).cast("bigint").alias("src"), (F.col("id") + 5_000).alias("dst"))))
    spark.conf.set("amity.graph.hubRows", "500")
    try:
        names = {k: loaded.write_bucketed(edges, scratch_path(spark, "t-hub"), k, 8) for k in ("src", "dst")}
    finally:
        spark.conf.unset("amity.graph.hubRows")
    for key, name in names.items():
        files = spark.table(name).where(F.col(key) == hub).select(F.input_file_name()).distinct().count()
        assert files >= 3
        bucket = F.pmod(F.hash(key), F.lit(8))
        others = spark.table(name).where(F.col(key) != hub).select(bucket.alias("b"), F.input_file_name().alias("f"))
        assert all(r["count"] == 1 for r in others.distinct().groupBy("b").count().collect())
    out, into = spark.table(names["src"]), spark.table(names["dst"])
    two = into.select(F.col("src").alias("a"), F.col("dst").alias("via")).join(out.withColumnRenamed("src", "via"), "via")
    assert two.count() == 2_000 * 2_000


def test_common_friends_with_hubs_and_hot_accounts(spark, monkeypatch):
    """Arrays of two friends at most, and a hot threshold of three: hubs and hot
    accounts take the expanded way, with the same counts."""
    pairs = [(a, b) for a in range(12) for b in range(12) if a != b and (a * 7 + b * 5) % 3]
    roster = spark.createDataFrame([(k, f"u{a}", f"u{b}", b) for k, (a, b) in enumerate(pairs)],
                                   "rosterID bigint, username string, loginAccount string, userID bigint")
    want = sorted(map(tuple, cf.common_friend_table(ro.FriendGraph.of(roster), None).collect()))
    for limit, hot in ((2, "1000000"), (4096, "3"), (7, "3")):
        monkeypatch.setattr(ro, "PACKED_FRIENDS", limit)
        monkeypatch.setattr(cf, "PACKED_FRIENDS", limit)
        spark.conf.set("amity.skew.hotRows", hot)
        try:
            assert sorted(map(tuple, cf.common_friend_table(ro.FriendGraph.of(roster), None).collect())) == want
        finally:
            spark.conf.unset("amity.skew.hotRows")
    friends = {a: {y for x, y in pairs if x == a} for a in range(12)}
    assert want == sorted((f"u{a}", f"u{b}", len(friends[a] & friends[b])) for a in range(12) for b in range(12)
                          if a != b and friends[a] & friends[b]
                          and (b in friends[a] or any(b in friends[f] for f in friends[a])))
