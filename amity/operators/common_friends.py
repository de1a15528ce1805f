"""Common-friend counts.

For a caller ``c`` and a candidate ``u`` the count is the number of accounts
``f`` that both list as friends, never counting ``c`` or ``u`` themselves.
With self-loops dropped this is |A(c) ∩ A(u)| over the distinct friend edges
A, which is symmetric in ``c`` and ``u``; a candidate equal to the caller gets
the caller's own degree.

Plan for many callers (no pairs are formed inside a friend group), on ids:
1. attach both out-degrees to each distinct request, written once;
2. fetch the friends of the account with fewer of them, then those of the other,
   as packed arrays from the bucketed adjacency table, and count what they share.
   The edges are never shuffled, and only the smaller array travels;
3. requests with a hub (more friends than an array holds), or with an account that
   very many requests name, expand the smaller side and look its friends up among
   the edges of the accounts named.

The table of all accounts in two hops (``common_friend_table``) of many callers forms
no requests first: the array of a caller meets those of its friends and of their
friends at each friend, so one array travels for an edge and none for a two-hop row;
only pairs that share a friend are shuffled, once, by caller. Where an owner is a
hub, its pairs are requests as above.

One caller needs no pivot: the candidates' edges, read on their bucket key,
are kept where they lead to one of the caller's friends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amity.operators.roster import (PACKED_FRIENDS, FriendGraph, as_graph, by_caller, caller_ids, callers_friends,
                                    meet, name_of, named_by_caller, reachable_ids, scope_ids, shuffled_by_caller,
                                    with_caller)
from amity.plans.skew import hot_rows_setting, skew_join, split_table
from amity.session import staged


def _hot(req: DataFrame, key: str) -> DataFrame:
    """Accounts that requests name so often that their friends are too much for
    one task: (key)."""
    per_key = req.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("_few").alias("_m"))
    rows = F.col("_n").cast("double") * F.col("_m").cast("double")
    return per_key.where(rows > F.lit(float(hot_rows_setting(req)))).select(key, F.lit(True).alias("_hot" + key))


def counts_by_id(g: FriendGraph, req: DataFrame) -> DataFrame:
    """(cid, uid) distinct requests -> (cid, uid, comm_friend_num > 0)."""
    deg = g.degrees
    req = req.join(deg.select(F.col("src").alias("cid"), F.col("degree").alias("_dc")), "cid")
    req = req.join(deg.select(F.col("src").alias("uid"), F.col("degree").alias("_du")), "uid")
    small_is_caller = F.col("_dc") <= F.col("_du")
    req = staged(req.select(
        "cid", "uid",
        F.when(small_is_caller, F.col("cid")).otherwise(F.col("uid")).alias("_small"),
        F.when(small_is_caller, F.col("uid")).otherwise(F.col("cid")).alias("_big"),
        F.least("_dc", "_du").alias("_few"), F.greatest("_dc", "_du").alias("_many")), "friend-requests")
    split = (F.col("_many") > PACKED_FRIENDS) | F.col("_hot_small").isNotNull() | F.col("_hot_big").isNotNull()
    marked = (req.join(_hot(req, "_small"), "_small", "left").join(_hot(req, "_big"), "_big", "left")
              .withColumn("_split", split))
    mine = g.packed.select(F.col("src").alias("_small"), F.col("ids").alias("_mine"))
    theirs = g.packed.select(F.col("src").alias("_big"), F.col("ids").alias("_theirs"))
    shared = F.size(F.array_intersect("_mine", "_theirs"))
    packed = (marked.where(~F.col("_split")).join(mine, "_small").join(theirs, "_big")
              .select("cid", "uid", shared.alias("comm_friend_num")).where(F.col("comm_friend_num") > 0))
    return packed.unionByName(_split_counts(g, marked.where("_split")))


def _split_counts(g: FriendGraph, req: DataFrame) -> DataFrame:
    """The same for requests with a hub, whose friends are no single array, or with
    an account that very many requests name: the friends of the smaller side are
    expanded, a pivot that many requests share is dealt over several tasks, and
    they are looked up among the edges of the other accounts named."""
    pivots = req.groupBy("_small").agg(F.count(F.lit(1)).alias("_n"), F.max("_few").alias("_m"))
    hot = split_table(pivots, ["_small"], F.col("_n"), F.col("_m"), hot_rows_setting(req))
    named = lambda key: (g.edges.join(req.select(F.col(key).alias("src")).distinct(), "src", "left_semi")
                         .withColumnRenamed("src", key))
    expanded = skew_join(req.select("cid", "uid", "_small", "_big"), named("_small"), ["_small"], hot=hot)
    hits = expanded.join(named("_big"), ["_big", "dst"], "left_semi")
    return hits.groupBy("cid", "uid").agg(F.count(F.lit(1)).cast("int").alias("comm_friend_num"))


def common_friend_counts(graph, requests: DataFrame) -> DataFrame:
    """(caller, candidate, comm_friend_num) for every distinct request with a
    count above zero."""
    g = as_graph(graph)
    a = g.accounts
    req = (requests.select("caller", "candidate").distinct()
           .join(a.select(F.col("account").alias("caller"), F.col("aid").alias("cid")), "caller")
           .join(a.select(F.col("account").alias("candidate"), F.col("aid").alias("uid")), "candidate"))
    counts = counts_by_id(g, req.select("cid", "uid"))
    return req.join(counts, ["cid", "uid"]).select("caller", "candidate", "comm_friend_num")


def common_friend_count_many(graph, requests: DataFrame) -> DataFrame:
    """C4 for many callers. ``requests``: (caller, pos, candidate), duplicates
    and order kept through ``pos``; candidates without a common friend get 0."""
    counts = common_friend_counts(graph, requests)
    return (requests.select("caller", "pos", "candidate")
            .join(counts, ["caller", "candidate"], "left")
            .select("caller", "pos", "candidate",
                    F.coalesce("comm_friend_num", F.lit(0)).cast("int").alias("comm_friend_num")))


def common_friend_count(graph, caller: str, candidates: DataFrame) -> DataFrame:
    """``searchCommonFriendNum``: candidates (pos, username) ->
    (pos, username, comm_friend_num), one row per input row.

    The caller's id is a point lookup and its friends one filtered read of the
    edges; every join key on the way is a candidate or one of its friends."""
    g = as_graph(graph)
    cid = caller_ids(g, caller)
    uids = (candidates.select("username").distinct()
            .join(g.accounts.select(F.col("account").alias("username"), F.col("aid").alias("src")),
                  "username"))
    mine = g.edges.where(F.col("src") == F.lit(cid)).select("dst")
    counts = (uids.join(g.edges, "src").join(mine, "dst", "left_semi")
              .groupBy("username").agg(F.count(F.lit(1)).alias("_n")))
    return (candidates.select("pos", "username").join(counts, "username", "left")
            .select("pos", "username", F.coalesce("_n", F.lit(0)).cast("int").alias("comm_friend_num")))


def _reached_friends(g: FriendGraph, cids) -> DataFrame:
    """(_via, uid, _theirs, userName): for every account, itself and its friends, each
    with its name and its own friends. Of some callers only their friends' rows."""
    edges = g.edges if cids is not None or g.edges_in is None else g.edges_in
    near = (edges.select(F.col("src").alias("_via"), F.col("dst").alias("uid"))
            .unionByName(g.degrees.select(F.col("src").alias("_via"), F.col("src").alias("uid"))))
    if cids is not None:
        vias = scope_ids(g.edges, cids).select(F.col("dst").alias("_via")).distinct()
        near = near.join(staged(vias, "callers-friends"), "_via", "left_semi")
    theirs = g.packed.select(F.col("src").alias("uid"), F.col("ids").alias("_theirs"))
    names = g.accounts.select(F.col("aid").alias("uid"), F.col("account").alias("userName"))
    return near.join(theirs, "uid").join(names, "uid")


def common_friend_table(graph, callers) -> DataFrame:
    """C5 (the cached common-friend table) for any callers: every account
    reachable within two hops with a count above zero.
    (caller, userName, comFriendsNum)."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    if by_caller(g, cids):
        shared = F.size(F.array_intersect("_mine", "_theirs"))
        pairs = (meet(g, callers_friends(g, cids), _reached_friends(g, cids)).where(F.col("cid") != F.col("uid"))
                 .select("cid", "userName", shared.alias("comFriendsNum")).where(F.col("comFriendsNum") > 0))
        pairs = shuffled_by_caller(g, pairs).distinct()
        return named_by_caller(g, pairs, callers, cids).select("caller", "userName", "comFriendsNum")
    reach = reachable_ids(g, cids).select("cid", F.col("dst").alias("uid"))
    counts = counts_by_id(g, reach)
    out = name_of(g, counts, "uid", "userName")
    return (with_caller(g, out, callers, cids)
            .select("caller", "userName", F.col("comm_friend_num").alias("comFriendsNum")))
