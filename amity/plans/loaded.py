"""The loaded tables of a data directory: roster, contacts and the friend graph.

Loading is the refresh step: the fixture views are computed once from the
given tables and written as parquet snapshots under the shared checkpoint
folder, together with what every graph query shares - the account
dictionary, the id-coded edge tables (bucketed by owner, by friend and by
numeric id, packed as arrays, and in folders for one caller's second hop),
degrees and the hot-account table; the contacts lie in parts of the order by
prestige.  Every query then
reads those snapshots: scans have real sizes for the optimizer, equality
lookups prune buckets and row groups, and the two-hop join needs no
exchange.  A session loads a directory once; a new session loads it again.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.operators.contacts import check_required, contacts_denorm, prestige_order
from amity.operators.paging import write_rank_parts
from amity.operators.roster import (PACKED_FRIENDS, FriendGraph, account_dictionary, encode_roster, load_roster,
                                    packed_friends, path_rows)
from amity.plans import fixtures as fx
from amity.session import scratch_path, staged
from amity.sources.snapshots import latest_snapshot, mark_complete, snapshot_write

_LOCK = threading.Lock()
_LOADED: dict[tuple[str, str], dict] = {}

# fixed snapshot key of a fixture load (any epoch-ms value would do)
FIXTURE_SNAPSHOT_MS = 1469664000000


GRAPH_PARTS = ("accounts", "degrees", "in_degrees", "hot")
# tables written bucketed and sorted: (name, bucket column); edges without
# self-loops are the raw edges with src <> dst: a filter keeps the bucketing, so
# they are not written twice
BUCKETED = (("edges_ids", "src"), ("raw_edges", "src"), ("edges_in", "dst"), ("ids_in", "userID"), ("packed", "src"),
            ("inbound", "userID"))


ROWS_PER_BUCKET = 4_000_000  # two longs a row: about 64 MB of ids per bucket


def graph_buckets(spark: SparkSession, rows: int) -> int:
    """Buckets of the edge tables: ``amity.graph.buckets`` if set, else
    enough for about ``ROWS_PER_BUCKET`` rows each and never fewer than the
    cluster's default parallelism.  Buckets follow the data size: a bucketed
    scan is never coalesced, so a fixed high count would turn small tables
    into many tiny tasks."""
    fixed = spark.conf.get("amity.graph.buckets", None)
    if fixed:
        return int(fixed)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-int(rows) // ROWS_PER_BUCKET)))


def hub_rows(spark: SparkSession) -> int:
    """Rows of one account that one writer task takes (``amity.graph.hubRows``)."""
    return int(spark.conf.get("amity.graph.hubRows", str(ROWS_PER_BUCKET)))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """``df`` as an external table bucketed and sorted by ``key``: scans know the
    bucketing (joins on the key need no shuffle; an equality filter skips other
    row groups).

    Rows go to their writer by (bucket, chunk): an ordinary account has one
    chunk, so its bucket is one file; the rows of a hub are dealt into chunks of
    about ``hub_rows`` by their hash, so that many tasks write them, as files of
    the same bucket, and many tasks read them where no join needs the bucket."""
    spark = df.sparkSession
    limit = hub_rows(spark)
    hubs = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
            .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_chunks")))
    dealt = (df.join(hubs, key, "left")
             .withColumn("_chunk", F.pmod(F.xxhash64(*df.columns), F.coalesce("_chunks", F.lit(1))).cast("int")))
    name = f"amity_{key}_{uuid.uuid4().hex[:12]}"
    # Spark's bucket of a key is its Murmur3 hash, modulo the buckets
    (dealt.repartition(buckets, F.pmod(F.hash(key), F.lit(buckets)), "_chunk").select(*df.columns)
     .write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    return name


HOP_PART_ROWS = 1_000_000


def write_hops(coded: DataFrame, path: str, parts: int) -> None:
    """The raw edges in folders ``part = pmod(src, parts)``, for one caller's
    second hop: only the folders of its friends are read."""
    (coded.distinct().withColumn("part", F.pmod("src", F.lit(parts)).cast("int"))
     .repartition(parts, "part").sortWithinPartitions("part", "src")
     .write.mode("overwrite").partitionBy("part").parquet(path))


def _build(spark: SparkSession, sf_dir: str) -> dict:
    """Load step: the roster snapshot, the account dictionary and the id-coded
    edge, degree and hot-account tables derived from it (clustered by owner
    id), and the contact table."""
    roots: dict = {k: scratch_path(spark, k) for k in ("roster", "contacts", "coded", "hops") + GRAPH_PARTS}
    at = lambda k: f"{roots[k]}/snapshot_ms={FIXTURE_SNAPSHOT_MS}"
    snapshot_write(load_roster(fx.view_ofroster(spark, sf_dir)), roots["roster"],
                   FIXTURE_SNAPSHOT_MS, sort_by=("username",))
    roster_df = latest_snapshot(spark, roots["roster"]).drop("snapshot_ms")
    snapshot_write(account_dictionary(roster_df), roots["accounts"], FIXTURE_SNAPSHOT_MS)
    accounts = latest_snapshot(spark, roots["accounts"]).drop("snapshot_ms")
    # the roster in ids, written once; every graph table derives from it
    snapshot_write(encode_roster(roster_df, accounts), roots["coded"], FIXTURE_SNAPSHOT_MS)
    coded = latest_snapshot(spark, roots["coded"]).drop("snapshot_ms")
    g = FriendGraph.from_coded(roster_df, accounts, coded)
    rows = coded.count()  # a parquet count: footers only
    buckets = graph_buckets(spark, rows)
    snapshot_write(g.degrees, roots["degrees"], FIXTURE_SNAPSHOT_MS, sort_by=("src",))
    degrees = latest_snapshot(spark, roots["degrees"]).drop("snapshot_ms")
    roots["has_hubs"] = not degrees.where(F.col("degree") > PACKED_FRIENDS).isEmpty()
    roots["paths"] = path_rows(g.edges, degrees)
    snapshot_write(g.in_degrees, roots["in_degrees"], FIXTURE_SNAPSHOT_MS, sort_by=("userID",))
    inbound_df = roster_df.select("userID", "username").where(F.col("userID").isNotNull()).distinct()
    parts = {"edges_in": g.edges, "packed": packed_friends(g.edges, degrees), "inbound": inbound_df}
    for name, key in BUCKETED:
        part = parts.get(name) or getattr(g, name)
        roots["table:" + name] = write_bucketed(part, f"{scratch_path(spark, name)}/snapshot_ms={FIXTURE_SNAPSHOT_MS}",
                                                key, buckets)
    roots["hop_parts"] = max(buckets, -(-rows // HOP_PART_ROWS))
    write_hops(coded, at("hops"), roots["hop_parts"])
    mark_complete(spark, roots["hops"], FIXTURE_SNAPSHOT_MS)
    # usually empty: written into its partition folder directly, so the
    # schema-only file still marks the snapshot. Every partition of its join is a
    # task of its own: one task would hold the degrees of all accounts
    g.hot.write.mode("overwrite").parquet(at("hot"))
    mark_complete(spark, roots["hot"], FIXTURE_SNAPSHOT_MS)
    people = staged(contacts_denorm(fx.business_cards(spark, sf_dir), fx.users(spark, sf_dir), fx.prestige(spark, sf_dir)),
                    "people")
    check_required(people)
    write_rank_parts(people, prestige_order(), at("contacts"))
    mark_complete(spark, roots["contacts"], FIXTURE_SNAPSHOT_MS)
    return roots


def loaded_roots(spark: SparkSession, sf_dir: str) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _LOADED:
            _LOADED[key] = _build(spark, sf_dir)
        return _LOADED[key]


def _latest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return latest_snapshot(spark, loaded_roots(spark, sf_dir)[name]).drop("snapshot_ms")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest roster snapshot: rosterID, username, loginAccount, userID."""
    return _latest(spark, sf_dir, "roster")


def graph(spark: SparkSession, sf_dir: str) -> FriendGraph:
    """The friend graph of the newest roster snapshot, every part loaded;
    the edge tables come back as bucketed table scans."""
    roots = loaded_roots(spark, sf_dir)
    table = {name: spark.table(roots["table:" + name]) for name, _ in BUCKETED}
    edges = table["raw_edges"].where(F.col("src") != F.col("dst"))
    hot_df = _latest(spark, sf_dir, "hot")
    if "has_hot" not in roots:  # a per-snapshot fact, checked once (tiny table)
        roots["has_hot"] = not hot_df.isEmpty()
    return FriendGraph(roster(spark, sf_dir), _latest(spark, sf_dir, "accounts"), edges,
                       table["edges_ids"], table["raw_edges"], _latest(spark, sf_dir, "degrees"),
                       hot_df, table["ids_in"], _latest(spark, sf_dir, "in_degrees"), table["packed"],
                       edges_in=table["edges_in"], has_hot=roots["has_hot"], has_hubs=roots["has_hubs"],
                       hops=_latest(spark, sf_dir, "hops"), hop_parts=roots["hop_parts"],
                       paths=roots["paths"])


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest contacts snapshot: the 14 columns of the person record."""
    return contacts_in_parts(spark, sf_dir).drop("part")


def contacts_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``part``, the folder of a row in the order by prestige."""
    return _latest(spark, sf_dir, "contacts")


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot accounts of the newest roster snapshot: (account, indeg, outdeg)."""
    return _latest(spark, sf_dir, "hot")


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(userID, username): the owners listing each user id, bucketed by id -
    the exclusion lookup of the contact searches."""
    return spark.table(loaded_roots(spark, sf_dir)["table:inbound"])
