"""Relation degree: friend ids of type 1 (one hop) and type 2 (strict two
hops, not already type 1), keyed by the friend's numeric ``userID`` and
returned as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amity.operators.roster import (PACKED_FRIENDS, FriendGraph, as_graph, by_caller, caller_ids, callers_friends,
                                    meet, named_by_caller, one_hop_ids, scope_ids, second_hop, shuffled_by_caller,
                                    with_caller)
from amity.plans.skew import hot_rows_setting, skew_join, split_table
from amity.session import staged

FRIEND = 1
FRIEND_OF_FRIEND = 2
STRANGER = 3


def relation_table_many(graph, callers) -> DataFrame:
    """C6 for any callers: (caller, userID string, friendType int).

    Type 1: ids of the caller's friends.  Type 2: ids reached through a
    friend whose account is neither the caller nor a direct friend.  One
    aggregation makes ids distinct and lets type 1 win over type 2.  Where no owner
    is a hub, a caller's friends come along as one array, so its direct friends fall
    out at the second hop, and only (cid, userID) is shuffled, once."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    e = g.edges_ids.where(F.col("userID").isNotNull())
    first = scope_ids(e, cids).select("cid", "userID", F.lit(FRIEND).alias("friendType"))
    if by_caller(g, cids):
        found = meet(g, callers_friends(g, cids), e.withColumnRenamed("src", "_via"))
        second = (found.where((F.col("dst") != F.col("cid")) & ~F.array_contains("_mine", F.col("dst")))
                  .select("cid", "userID", F.lit(FRIEND_OF_FRIEND).alias("friendType")))
        both = (shuffled_by_caller(g, first.unionByName(second))
                .groupBy("cid", "userID").agg(F.min("friendType").alias("friendType")))
        return _as_texts(named_by_caller(g, both, callers, cids))
    second = (second_hop(g, cids, e).where((F.col("dst") != F.col("cid")) & F.col("userID").isNotNull())
              .select("cid", "dst", "userID").distinct()   # before the anti join: far fewer rows
              .join(one_hop_ids(g, cids), ["cid", "dst"], "left_anti")
              .select("cid", "userID", F.lit(FRIEND_OF_FRIEND).alias("friendType")))
    both = (first.unionByName(second)
            .groupBy("cid", "userID").agg(F.min("friendType").alias("friendType")))
    return _as_texts(with_caller(g, both, callers, cids))


def _as_texts(rows: DataFrame) -> DataFrame:
    return rows.select("caller", F.col("userID").cast("string").alias("userID"),
                       F.col("friendType").cast("int").alias("friendType"))


def relation_table(graph, caller: str) -> DataFrame:
    """The per-caller relation table: (userID, friendType)."""
    return relation_table_many(graph, caller).select("userID", "friendType")


def _meeting(g: FriendGraph, req: DataFrame, own: DataFrame) -> DataFrame:
    """(cid, uid, dst): edges to an asked id ``uid`` owned by one of the caller's
    friends. ``req``: cid, uid; ``own``: the callers' edges (cid, via).

    Either the caller's friends or the edges into the asked id are expanded,
    whichever are fewer for that request, and looked up on the other side: no
    caller's two-hop set is ever built."""
    out = g.degrees.select(F.col("src").alias("cid"), F.col("degree").alias("_out"))
    into = g.in_degrees.select(F.col("userID").alias("uid"), F.col("indegree").alias("_in"))
    req = staged(req.join(out, "cid").join(into, "uid"), "relation-requests")
    edge = g.ids_in.select(F.col("userID").alias("uid"), F.col("src").alias("via"), "dst")
    forth, back = req.where(F.col("_out") <= F.col("_in")), req.where(F.col("_out") > F.col("_in"))
    forth = skew_join(forth.select("cid", "uid"), own, ["cid"], hot=_pivots(forth, "cid", "_out")).join(edge, ["uid", "via"])
    back = (skew_join(back.select("cid", "uid"), edge, ["uid"], hot=_pivots(back, "uid", "_in"))
            .join(own, ["cid", "via"], "left_semi"))
    return forth.select("cid", "uid", "dst").unionByName(back.select("cid", "uid", "dst"))


def _pivots(req: DataFrame, key: str, degree: str) -> DataFrame:
    """The keys whose requests times edges are too much for one task."""
    per_key = req.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(degree).alias("_m"))
    return split_table(per_key, [key], F.col("_n"), F.col("_m"), hot_rows_setting(req))


def _second_by_arrays(g: FriendGraph, req: DataFrame, own: DataFrame) -> DataFrame:
    """(cid, uid) of the requests ``req`` (cid, uid) whose id belongs to a friend of a
    friend: the caller's friends, as one array, meet the owners who list the id, as
    another. Ids listed by more owners than an array holds, and ids that very many
    requests name, are expanded (``_meeting``)."""
    into = g.in_degrees.select(F.col("userID").alias("uid"), F.col("indegree").alias("_in"))
    # the caller comes last: its array is met by a request that lies by id
    asked = req.groupBy("uid").agg(F.count(F.lit(1)).alias("_n")).join(into, "uid")
    rows = F.col("_n").cast("double") * F.col("_in").cast("double")
    expanded = (F.col("_in") > PACKED_FRIENDS) | (rows > F.lit(float(hot_rows_setting(req))))
    heavy = staged(asked.where(expanded).select("uid"), "relation-heavy")
    light = g.ids_in.withColumnRenamed("userID", "uid")
    few, some = req, not heavy.isEmpty()
    if some:
        light, few = light.join(heavy, "uid", "left_anti"), few.join(heavy, "uid", "left_anti")
    listed = light.groupBy("uid", "dst").agg(F.collect_list("src").alias("_owners"))
    mine = g.packed.select(F.col("src").alias("cid"), F.col("ids").alias("_mine"))
    met = (few.join(mine, "cid").join(listed, "uid")
           .where((F.col("dst") != F.col("cid")) & ~F.array_contains("_mine", F.col("dst"))
                  & F.arrays_overlap("_mine", "_owners")).select("cid", "uid"))
    return met.unionByName(_second_by_meeting(g, req.join(heavy, "uid", "left_semi"), own)) if some else met


def _second_by_meeting(g: FriendGraph, req: DataFrame, own: DataFrame) -> DataFrame:
    return (_meeting(g, req, own).where(F.col("dst") != F.col("cid")).distinct()
            .join(own.withColumnRenamed("via", "dst"), ["cid", "dst"], "left_anti").select("cid", "uid"))


def _relations(g: FriendGraph, req: DataFrame, cids) -> DataFrame:
    """(cid, uid, type) of the distinct requests ``req`` (cid, uid) that are a
    friend or a friend of a friend."""
    own = scope_ids(g.edges, cids).select("cid", F.col("dst").alias("via"))
    named = scope_ids(g.edges_ids.where(F.col("userID").isNotNull()), cids)
    first = req.join(named.select("cid", F.col("userID").alias("uid")).distinct(), ["cid", "uid"], "left_semi")
    second = (_second_by_arrays if by_caller(g, cids) else _second_by_meeting)(g, req, own)
    both = (first.select("cid", "uid", F.lit(FRIEND).alias("type"))
            .unionByName(second.select("cid", "uid", F.lit(FRIEND_OF_FRIEND).alias("type"))))
    return both.groupBy("cid", "uid").agg(F.min("type").alias("type"))


def _answered(req: DataFrame, found: DataFrame, key: list[str], include_strangers: bool) -> DataFrame:
    kind = F.coalesce("type", F.lit(STRANGER)) if include_strangers else F.col("type")
    return req.join(found, key, "left" if include_strangers else "inner").select(*key, kind.cast("int").alias("type"))


def _as_id(user_id: str = "user_id"):
    """The numeric id of a text; null where it is not one as the ids are written."""
    n = F.col(user_id).try_cast("bigint")
    return F.when(n.cast("string") == F.col(user_id), n)


def person_relation_many(graph, requests: DataFrame, include_strangers: bool = False) -> DataFrame:
    """C7 for many callers. ``requests``: (caller, user_id string).
    Duplicate requests collapse; strangers are absent unless asked for, then
    they get type 3."""
    g = as_graph(graph)
    req = staged(requests.select("caller", F.col("user_id").cast("string").alias("user_id")).distinct(),
                 "asked-relations")
    cids = caller_ids(g, req.select("caller"))
    coded = staged(req.join(cids, "caller").select("cid", _as_id().alias("uid")).where(F.col("uid").isNotNull()),
                   "coded-requests")
    found = (_relations(g, coded, cids).join(cids, "cid")
             .select("caller", F.col("uid").cast("string").alias("user_id"), "type"))
    return _answered(req, found, ["caller", "user_id"], include_strangers)


def person_relation(graph, caller: str, user_ids: DataFrame,
                    include_strangers: bool = False) -> DataFrame:
    """``searchPersonRelation``: ids (column ``user_id``) -> (user_id, type)."""
    g = as_graph(graph)
    cid = caller_ids(g, caller)
    req = user_ids.select(F.col("user_id").cast("string").alias("user_id")).distinct()
    coded = req.select(F.lit(cid).cast("bigint").alias("cid"), _as_id().alias("uid")).where(F.col("uid").isNotNull())
    found = _relations(g, coded, cid).select(F.col("uid").cast("string").alias("user_id"), "type")
    return _answered(req, found, ["user_id"], include_strangers)
