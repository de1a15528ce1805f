"""Friend-edge table and one- and two-hop neighbourhoods.

A roster row (username, loginAccount, userID) is a directed edge: the owner
``username`` lists ``loginAccount`` as a friend, whose numeric id is
``userID``.  Edges need not be symmetric; lookups follow them outward from
the owner.

Every operator takes ``callers`` as one account (a string), as a DataFrame
with a ``caller`` column, or as ``None`` for every owner, so one job serves
any number of callers.  Results always carry the ``caller`` column.

A ``FriendGraph`` holds the raw roster and what every query derives from
it, built once per snapshot (``amity.plans.loaded``) or for one session with
``FriendGraph.of(roster)``:

* ``accounts``: every account name with a ``long`` id (``aid``) of its own - exact,
  no hash collisions;
* ``edges`` (src, dst): distinct friend edges without self-loops, in ids;
* ``edges_ids`` (src, dst, userID) and ``raw_edges`` (with self-loops);
* ``degrees`` (src, degree) and ``hot`` (account = aid, indeg, outdeg) for the
  accounts through which many two-hop paths lead.

All joins inside the operators run on the 8-byte ids; names are restored on
the outputs only.  Every expansion joins on a friend account, whose work is
in-degree x out-degree, and splits hot accounts (``amity.plans.skew``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amity.plans.skew import degree_hot_keys, hot_rows_setting, skew_join, split_hot_join, split_table
from amity.session import staged

ROSTER_COLUMNS = ("rosterID", "username", "loginAccount", "userID")
NO_ACCOUNT = -1  # id of a caller that is not in the dictionary: matches nothing


def load_roster(view: DataFrame) -> DataFrame:
    """Roster load query: keep subscribed edges with a known friend id
    (``sub = 3 and userID is not null``) and the four roster columns."""
    return (view.where((F.col("sub") == 3) & F.col("userID").isNotNull())
            .select(*ROSTER_COLUMNS))


def account_dictionary(roster: DataFrame) -> DataFrame:
    """(account, aid): every owner and friend account with an id of its own. Ids
    are given out where the rows stand, so the table is to be written once and
    read from there."""
    names = (roster.select(F.col("username").alias("account"))
             .union(roster.select(F.col("loginAccount").alias("account")))
             .where(F.col("account").isNotNull()).distinct())
    return names.withColumn("aid", F.monotonically_increasing_id())


def encode_roster(roster: DataFrame, accounts: DataFrame) -> DataFrame:
    """Raw roster rows as (src, dst, userID) ids."""
    s = accounts.select(F.col("account").alias("username"), F.col("aid").alias("src"))
    d = accounts.select(F.col("account").alias("loginAccount"), F.col("aid").alias("dst"))
    return roster.join(s, "username").join(d, "loginAccount").select("src", "dst", "userID")


@dataclass(frozen=True)
class FriendGraph:
    roster: DataFrame      # rosterID, username, loginAccount, userID (raw)
    accounts: DataFrame    # account, aid
    edges: DataFrame       # src, dst: distinct, no self-loops
    edges_ids: DataFrame   # src, dst, userID: distinct, no self-loops
    raw_edges: DataFrame   # src, dst: distinct, self-loops kept
    degrees: DataFrame     # src, degree (out-degree over edges)
    hot: DataFrame         # account (an aid), indeg, outdeg: hot accounts only
    ids_in: DataFrame      # userID, src, dst of edges_ids (loaded graphs: bucketed by userID)
    in_degrees: DataFrame  # userID, indegree (edges that carry the id)
    packed: DataFrame      # src, ids: the friends of every owner but hubs as one array
    edges_in: DataFrame | None = None  # the edges again, bucketed by dst (loaded graphs)
    has_hot: bool | None = None        # known at load: whether any account is hot
    has_hubs: bool | None = None       # known when coded: whether any owner is a hub
    paths: int = 0                     # known when coded: edges and two-hop paths of all owners
    hops: DataFrame | None = None      # src, dst, userID, part: raw edges in folders by pmod(src, hop_parts)
    hop_parts: int = 0

    @classmethod
    def of(cls, roster: DataFrame) -> "FriendGraph":
        """Codes the roster once, in the shared folder; everything else derives
        from that. Edges and degrees, which every query reads several times, are
        written too."""
        accounts = staged(account_dictionary(roster), "accounts")
        g = cls.from_coded(roster, accounts, staged(encode_roster(roster, accounts), "coded"))
        raw = staged(g.raw_edges, "raw-edges")
        edges = raw.where(F.col("src") != F.col("dst"))
        degrees = staged(degrees_of(edges), "degrees")
        hubs = not degrees.where(F.col("degree") > PACKED_FRIENDS).isEmpty()
        return replace(g, raw_edges=raw, edges=edges, degrees=degrees, hot=hot_degrees(edges),
                       packed=packed_friends(edges, degrees), has_hubs=hubs, paths=path_rows(edges, degrees))

    @classmethod
    def from_coded(cls, roster: DataFrame, accounts: DataFrame, coded: DataFrame) -> "FriendGraph":
        """The graph from roster rows already coded as (src, dst, userID)."""
        raw = coded.select("src", "dst").distinct()
        edges = raw.where(F.col("src") != F.col("dst"))
        edges_ids = coded.where(F.col("src") != F.col("dst")).distinct()
        degrees = degrees_of(edges)
        ids_in = edges_ids.where(F.col("userID").isNotNull()).select("userID", "src", "dst")
        return cls(roster, accounts, edges, edges_ids, raw, degrees, hot_degrees(edges), ids_in,
                   ids_in.groupBy("userID").agg(F.count(F.lit(1)).alias("indegree")), packed_friends(edges, degrees))


def degrees_of(edges: DataFrame) -> DataFrame:
    """(src, degree): out-degree; partial aggregation on the owner."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def path_rows(edges: DataFrame, degrees: DataFrame) -> int:
    """Edges and two-hop paths of all owners: each friend's in-degree times its
    out-degree and one."""
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("_in"))
    rows = F.sum(F.col("_in") * (F.coalesce("degree", F.lit(0)) + 1))
    return int(into.join(degrees, "src", "left").agg(rows).first()[0] or 0)


#: friends one array holds; an owner with more is a hub and has no array
PACKED_FRIENDS = 4_096


def packed_friends(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, ids): the sorted friends of every owner with at most
    ``PACKED_FRIENDS`` of them."""
    few = degrees.where(F.col("degree") <= PACKED_FRIENDS).select("src")
    return edges.join(few, "src", "left_semi").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("ids"))


def hot_degrees(edges: DataFrame) -> DataFrame:
    """(account, indeg, outdeg) of the accounts whose two-hop paths exceed the
    hot-row setting."""
    return degree_hot_keys(edges, "src", "dst")


def as_graph(g) -> FriendGraph:
    return g if isinstance(g, FriendGraph) else FriendGraph.of(g)


# ------------------------------------------------------------ callers and names

def caller_ids(g: FriendGraph, callers):
    """Callers as ids: None (all), an int literal, or a DataFrame
    (caller, cid).  One named caller is looked up once (a single id)."""
    if callers is None:
        return None
    if isinstance(callers, str):
        row = g.accounts.where(F.col("account") == F.lit(callers)).select("aid").first()
        return int(row[0]) if row else NO_ACCOUNT
    return (callers.select(F.col("caller").alias("account")).distinct()
            .join(g.accounts, "account")
            .select(F.col("account").alias("caller"), F.col("aid").alias("cid")))


def scope_ids(edges: DataFrame, cids) -> DataFrame:
    """Edges owned by the callers, ``src`` renamed ``cid``."""
    if cids is None:
        out = edges
    elif isinstance(cids, int):
        out = edges.where(F.col("src") == F.lit(cids))
    else:
        out = edges.join(cids.select(F.col("cid").alias("src")), "src", "left_semi")
    return out.withColumnRenamed("src", "cid")


def name_of(g: FriendGraph, df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Replace the id column ``id_col`` with the account name ``name_col``."""
    names = g.accounts.select(F.col("aid").alias(id_col), F.col("account").alias(name_col))
    return df.join(names, id_col).drop(id_col)


def with_caller(g: FriendGraph, df: DataFrame, callers, cids) -> DataFrame:
    """Replace ``cid`` with the caller's name."""
    if isinstance(callers, str):
        return df.drop("cid").withColumn("caller", F.lit(callers))
    if callers is None:
        return name_of(g, df, "cid", "caller")
    return df.join(cids, "cid").drop("cid")


# ------------------------------------------------------------ rows kept by caller

def by_caller(g: FriendGraph, cids) -> bool:
    """Whether the two-hop rows of any caller fit one task: many callers, and no
    owner is a hub, so a caller has at most ``PACKED_FRIENDS`` squared of them.
    Then they are shuffled once, by caller, and every later step is done there."""
    return not isinstance(cids, int) and g.has_hubs is False


#: two-hop rows that a task of the shuffle by caller gets on average
PATHS_PER_TASK = 1_000_000


def shuffled_by_caller(g: FriendGraph, rows: DataFrame) -> DataFrame:
    """``rows`` (cid, ...) by caller, over as many tasks as the graph has two-hop
    paths for: pairs of ids compress so well that a count by bytes would give each
    task many millions of rows to make distinct."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-g.paths // PATHS_PER_TASK))
    return rows.repartition(tasks, "cid")


def callers_friends(g: FriendGraph, cids) -> DataFrame:
    """(cid, _via, _mine): every friend of the callers beside all their friends.
    Edges and arrays lie by owner, so the loaded ones are not shuffled for it. An
    owner's array is copied once for each friend, not for each two-hop row."""
    return scope_ids(g.edges.join(g.packed, "src"), cids).select(
        "cid", F.col("dst").alias("_via"), F.col("ids").alias("_mine"))


def meet(g: FriendGraph, left: DataFrame, right: DataFrame) -> DataFrame:
    """left (_via, ...) x right (_via, ...); the rows of a hot account are dealt
    over a grid of tasks."""
    if g.has_hot is False:
        return left.join(right, "_via").drop("_via")
    hot = split_table(g.hot.withColumnRenamed("account", "_via"), ["_via"], F.col("indeg"), F.col("outdeg"),
                      hot_rows_setting(left))
    return skew_join(left, right, ["_via"], hot=hot).drop("_via")


def named_by_caller(g: FriendGraph, rows: DataFrame, callers, cids) -> DataFrame:
    """``with_caller`` of rows that lie by ``cid``: they stay where they are and
    unsorted, the names (one row a caller) come to them."""
    if callers is None:
        cids = g.accounts.select(F.col("account").alias("caller"), F.col("aid").alias("cid"))
    return rows.join(cids.hint("shuffle_hash"), "cid").drop("cid")


# ------------------------------------------------------------ id-level plans

def one_hop_ids(g: FriendGraph, cids) -> DataFrame:
    """(cid, dst).  For every owner the copy bucketed by ``dst`` is used, so
    the next hop (a join on dst = src) finds both sides already bucketed."""
    if cids is None and g.edges_in is not None:
        return scope_ids(g.edges_in, None)
    return scope_ids(g.edges, cids)


def expand(first: DataFrame, edges: DataFrame, hot: DataFrame, has_hot: bool | None = None) -> DataFrame:
    """(cid, dst=f) x edges(src=f -> dst, ...) on f.  The in- and out-edges of a
    hot f are dealt over a grid of tasks.  Returns (cid, dst, ...) of the second
    hop."""
    left = first.select("cid", F.col("dst").alias("_via"))
    right = edges.withColumnRenamed("src", "_via")
    if has_hot is False:
        return left.join(right, "_via").drop("_via")
    table = split_table(hot.withColumnRenamed("account", "_via"), ["_via"], F.col("indeg"), F.col("outdeg"),
                        hot_rows_setting(first))
    return split_hot_join(left, right, ["_via"], table).drop("_via")


def two_hop_candidate_ids(g: FriendGraph, cids) -> DataFrame:
    """Friends of one-hop friends other than the caller (not distinct, may
    include direct friends): (cid, dst)."""
    return second_hop(g, cids, g.edges).where(F.col("dst") != F.col("cid"))


def reachable_ids(g: FriendGraph, cids) -> DataFrame:
    """One-hop accounts united with strict two-hop accounts; equal to the
    distinct union of one-hop accounts and all two-hop candidates, which
    needs no anti join.  (cid, dst)."""
    one = one_hop_ids(g, cids)
    return one.unionByName(two_hop_candidate_ids(g, cids)).distinct()


#: callers' friends that a broadcast may hold (two longs a row: about 16 MB)
BROADCAST_FRIENDS = 1_000_000


def second_hop_of_one(g: FriendGraph, cid: int) -> DataFrame | None:
    """(cid, src, dst, userID): the roster rows owned by one caller's friends, or
    None where the graph has no hop table or the caller has more friends than a
    broadcast may hold (its degree is looked up). Rows lie in folders by owner, and
    the friends' folders are the only ones read (dynamic partition pruning)."""
    if g.hops is None:
        return None
    row = g.degrees.where(F.col("src") == F.lit(cid)).select("degree").first()
    if row is not None and row[0] > BROADCAST_FRIENDS:
        return None
    part = lambda c: F.pmod(F.col(c), F.lit(g.hop_parts))
    own = g.hops.where((F.col("part") == F.lit(cid % g.hop_parts)) & (F.col("src") == F.lit(cid)))
    friends = (own.where(F.col("dst") != F.lit(cid)).select(F.col("dst").alias("src")).distinct()
               .withColumn("part", part("src").cast("int")))
    return (g.hops.join(F.broadcast(friends), ["part", "src"])
            .select(F.lit(cid).cast("bigint").alias("cid"), "src", "dst", "userID"))


def second_hop(g: FriendGraph, cids, edges: DataFrame) -> DataFrame:
    """Rows of ``edges`` (src, dst, ...: raw edges or edges of the graph) owned by
    the callers' friends: (cid, dst, ...)."""
    if isinstance(cids, int):
        near = second_hop_of_one(g, cids)
        if near is not None:
            if edges is not g.raw_edges:
                near = near.where(F.col("src") != F.col("dst"))
            return near.select("cid", *[c for c in edges.columns if c != "src"])
    return expand(one_hop_ids(g, cids), edges, g.hot, g.has_hot)


# ------------------------------------------------------------ named operators

def _named(g: FriendGraph, ids: DataFrame, callers, cids) -> DataFrame:
    out = name_of(g, ids, "dst", "loginAccount")
    return with_caller(g, out, callers, cids).select("caller", "loginAccount")


def one_hop(graph, callers) -> DataFrame:
    """C1 for many callers: (caller, loginAccount), distinct, no self-loop."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    return _named(g, one_hop_ids(g, cids), callers, cids)


def two_hop_raw(graph, callers) -> DataFrame:
    """C2: accounts listed by any one-hop friend, from the raw roster.

    Kept exactly: may contain the caller, direct friends, and a friend listed
    by its own self-loop."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    if by_caller(g, cids):   # names are one to one with ids: they come along with the second hop
        named = name_of(g, g.raw_edges, "dst", "loginAccount")
        found = shuffled_by_caller(g, expand(one_hop_ids(g, cids), named, g.hot, g.has_hot)).distinct()
        return named_by_caller(g, found, callers, cids).select("caller", "loginAccount")
    ids = second_hop(g, cids, g.raw_edges).select("cid", "dst").distinct()
    return _named(g, ids, callers, cids)


def two_hop_strict(graph, callers) -> DataFrame:
    """C3 second part: friends of friends that are neither the caller nor a
    direct friend."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    ids = two_hop_candidate_ids(g, cids).distinct().join(one_hop_ids(g, cids), ["cid", "dst"], "left_anti")
    return _named(g, ids, callers, cids)


def reachable_within_two(graph, callers) -> DataFrame:
    """C3: one-hop accounts united with strict two-hop accounts."""
    g = as_graph(graph)
    cids = caller_ids(g, callers)
    return _named(g, reachable_ids(g, cids), callers, cids)


def friends_one_hop(graph, caller: str) -> DataFrame:
    """``searchFriendFrame``: loginAccount."""
    return one_hop(graph, caller).select("loginAccount")


def friends_two_hop_raw(graph, caller: str) -> DataFrame:
    """``searchTwoFriendFrame``: loginAccount."""
    return two_hop_raw(graph, caller).select("loginAccount")


def friends_two_hop_strict(graph, caller: str) -> DataFrame:
    return two_hop_strict(graph, caller).select("loginAccount")


def friends_reachable(graph, caller: str) -> DataFrame:
    return reachable_within_two(graph, caller).select("loginAccount")
