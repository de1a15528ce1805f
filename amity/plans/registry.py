"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the given tables (or tables Spark derives from them).

Request parameters mirror the reference's manual drivers where they can:
caller ``Customer#000000005`` / user id 5, the threshold search with
prestige > 10 and empty lists on page 1 x 70, the affinity search over the
13 industry codes.  Candidate lists are derived from the tables (every order's
customer, every customer id), so request volume grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.functions import dates as dt
from amity.functions import numbers as nb
from amity.functions import text as tx
from amity.operators import cogroup as cg
from amity.operators import common_friends as cf
from amity.operators import contacts as ct
from amity.operators import relations as rel
from amity.operators import roster as ro
from amity.plans import fixtures as fx
from amity.plans import loaded
from amity.session import scratch_path, staged
from amity.sources import files as fl
from amity.sources import fills
from amity.sources import generations as gens
from amity.sources import snapshots as sn

# fixed request parameters of the registered queries
CALLER = "Customer#000000005"
CALLER_ID = 5
PRESTIGE_THRESHOLD = 10
PRESTIGE_PAGE = (1, 70)
AFFINITY_MY_INDUSTRY = 100001000
AFFINITY_AREA = 330002
AFFINITY_PAGE = (2, 50)
MANY_PAGE = (1, 20)
NO_INDUSTRY_EVERY = 17
LISTS_THRESHOLD = 5
LISTS_INDUSTRIES = (100001000, 100002000, 100003000)
LISTS_AREAS = (330001, 330002, 330003, 330004, 330005, 330006, 330007, 330008)
LISTS_PAGE = (2, 25)
SNAPSHOT_KEYS = (1469664000000, 1469707200000, 1469750400000)  # 720 minutes apart
KEEP_SNAPSHOTS = 2
EDIT_ONE_IN = 23
SPLIT_ROWS = 200
COGROUP_DEFAULT = -1.0

Query = Callable[[SparkSession, str], DataFrame]


def _roster(spark, sf):
    return loaded.roster(spark, sf)


def _contacts(spark, sf):
    return loaded.contacts(spark, sf)


def _inbound(spark, sf):
    """Exclusion lookups of the contact searches read the inbound index
    (userID, username) rather than the whole roster."""
    return loaded.inbound(spark, sf)


def _graph(spark, sf):
    return loaded.graph(spark, sf)


# ------------------------------------------------------------ sources / loads

def roster_scan(spark, sf):
    return ro.load_roster(fx.view_ofroster(spark, sf))


def contacts_denorm(spark, sf):
    return ct.contacts_denorm(fx.business_cards(spark, sf), fx.users(spark, sf), fx.prestige(spark, sf))


# ------------------------------------------------------------ roster family

def friends_one_hop(spark, sf):
    return ro.friends_one_hop(_graph(spark, sf), CALLER)


def friends_two_hop_raw(spark, sf):
    return ro.friends_two_hop_raw(_graph(spark, sf), CALLER)


def friends_two_hop_strict(spark, sf):
    return ro.friends_two_hop_strict(_graph(spark, sf), CALLER)


def reachable_within_two(spark, sf):
    return ro.friends_reachable(_graph(spark, sf), CALLER)


def order_candidates(spark, sf) -> DataFrame:
    """Every order's customer account as a candidate, pos = order key:
    duplicates and order are part of the request."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias("pos"), F.col("c_name").alias("username")))


def common_friend_count(spark, sf):
    return cf.common_friend_count(_graph(spark, sf), CALLER, order_candidates(spark, sf))


def common_friend_table(spark, sf):
    return cf.common_friend_table(_graph(spark, sf), CALLER).select("userName", "comFriendsNum")


def relation_table(spark, sf):
    return rel.relation_table(_graph(spark, sf), CALLER)


def person_relation(spark, sf):
    ids = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return rel.person_relation(_graph(spark, sf), CALLER, ids)


def common_friend_all_callers(spark, sf):
    return cf.common_friend_table(_graph(spark, sf), None)


def two_hop_raw_all_callers(spark, sf):
    return ro.two_hop_raw(_graph(spark, sf), None)


def relation_all_callers(spark, sf):
    return rel.relation_table_many(_graph(spark, sf), None)


def _split_small(spark, sf, build) -> DataFrame:
    """``build`` on a graph in which accounts of ``SPLIT_ROWS`` two-hop paths are
    already hot, so that joins through them are dealt over a grid of tasks."""
    before = spark.conf.get("amity.skew.hotRows", None)
    spark.conf.set("amity.skew.hotRows", str(SPLIT_ROWS))
    try:
        return build(ro.FriendGraph.of(_roster(spark, sf)), None)
    finally:
        spark.conf.set("amity.skew.hotRows", before) if before else spark.conf.unset("amity.skew.hotRows")


def relation_all_callers_split(spark, sf):
    return _split_small(spark, sf, rel.relation_table_many)


def common_friend_all_callers_split(spark, sf):
    return _split_small(spark, sf, cf.common_friend_table)


def edge_requests(roster: DataFrame) -> DataFrame:
    """Every roster edge as a request: the owner asks for its common friends
    with each listed account (self-loop rows ask about the owner itself)."""
    return roster.select(F.col("username").alias("caller"), F.col("rosterID").alias("pos"),
                         F.col("loginAccount").alias("candidate"))


def common_friend_count_many(spark, sf):
    g = _graph(spark, sf)
    return cf.common_friend_count_many(g, edge_requests(g.roster))


def inbound_relation_requests(spark, sf) -> DataFrame:
    """Every listed account asks for its relation to each owner listing it."""
    r = _roster(spark, sf)
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    return (r.join(c, r.username == c.c_name)
            .select(F.col("loginAccount").alias("caller"), F.col("c_custkey").cast("string").alias("user_id")))


def person_relation_many(spark, sf):
    return rel.person_relation_many(_graph(spark, sf), inbound_relation_requests(spark, sf),
                                    include_strangers=True)


def _derived_lookup(spark, sf, name: str, build) -> DataFrame:
    """Materialise a per-caller table for the caller asked for, as far as it is
    missing, and read that caller's rows back."""
    root = scratch_path(spark, name)
    fills.fill_missing(spark, root, loaded.FIXTURE_SNAPSHOT_MS, spark.createDataFrame([(CALLER,)], "caller string"), build)
    return sn.derived_for(spark, root, loaded.FIXTURE_SNAPSHOT_MS, CALLER)


def common_friend_table_cached(spark, sf):
    g = _graph(spark, sf)
    return _derived_lookup(spark, sf, "derived-common-friends", lambda callers: cf.common_friend_table(g, callers)
                           ).select("userName", "comFriendsNum")


def relation_table_cached(spark, sf):
    g = _graph(spark, sf)
    return _derived_lookup(spark, sf, "derived-relations", lambda callers: rel.relation_table_many(g, callers)
                           ).select("userID", "friendType")


def _owners(spark, sf) -> DataFrame:
    return _roster(spark, sf).select(F.col("username").alias("caller")).distinct()


def derived_missing_callers(spark, sf):
    """A relation table filled in two steps: one caller first, then every roster
    owner that is still missing; the rows of all of them."""
    g, root = _graph(spark, sf), scratch_path(spark, "derived-two-steps")
    build = lambda callers: rel.relation_table_many(g, callers)
    for asked in (spark.createDataFrame([(CALLER,)], "caller string"), _owners(spark, sf)):
        fills.fill_missing(spark, root, loaded.FIXTURE_SNAPSHOT_MS, asked, build, together=ro.by_caller(g, None))
    return sn.derived_for(spark, root, loaded.FIXTURE_SNAPSHOT_MS, _owners(spark, sf)).drop(sn.SNAPSHOT_COL)


def _edited(roster: DataFrame) -> DataFrame:
    """An older roster: without the rows of one friend id in ``EDIT_ONE_IN``, and
    with some rows that the newer one has no more."""
    kept = roster.where(F.col("userID") % EDIT_ONE_IN != 0)
    gone = roster.where(F.col("userID") % EDIT_ONE_IN == 1).select(
        "rosterID", F.col("loginAccount").alias("username"), F.col("username").alias("loginAccount"), "userID")
    return kept.unionByName(gone)


def _carried(spark, sf, name: str, hops: int, build) -> DataFrame:
    """A derived table of all owners at an older roster, brought to the newer one
    by rebuilding the affected callers only."""
    new, root = _roster(spark, sf), scratch_path(spark, name)
    old = staged(_edited(new), "older-roster")
    then, now = SNAPSHOT_KEYS[:2]
    owners = new.select(F.col("username").alias("caller")).distinct()
    g, newer = ro.FriendGraph.of(old), _graph(spark, sf)
    fills.fill_missing(spark, root, then, owners, lambda callers: build(g, callers), together=ro.by_caller(g, None))
    fills.carry_over(spark, root, then, now, fills.affected_callers(old, new, hops),
                     lambda callers: build(newer, callers), together=ro.by_caller(newer, None))
    return sn.derived_for(spark, root, now, owners).drop(sn.SNAPSHOT_COL)


def relation_table_after_edits(spark, sf):
    return _carried(spark, sf, "derived-edited-relations", 1, rel.relation_table_many)


def common_friend_table_after_edits(spark, sf):
    return _carried(spark, sf, "derived-edited-friends", 2, cf.common_friend_table)


def derived_after_refresh(spark, sf):
    """A derived table of three snapshots after a refresh that keeps two: rows by
    snapshot that it still answers with."""
    g, root, table = _graph(spark, sf), scratch_path(spark, "roster-refreshed"), scratch_path(spark, "derived-refreshed")
    owners = _owners(spark, sf)
    for k in SNAPSHOT_KEYS:
        fills.fill_missing(spark, table, k, owners, lambda callers: rel.relation_table_many(g, callers),
                           together=ro.by_caller(g, None))
        sn.refresh(spark, _roster(spark, sf), root, k, keep=KEEP_SNAPSHOTS, derived=(table,))
    rows = [sn.derived_for(spark, table, k, owners) for k in SNAPSHOT_KEYS if sn.done_callers(spark, table, k) is not None]
    return reduce(DataFrame.unionByName, rows).groupBy("snapshot_ms", "friendType").agg(F.count(F.lit(1)).alias("n_rows"))


def generation_tables(spark, sf):
    """Three refreshes of roster, contacts and a table built from both, two kept:
    the rows of every table of the published generations."""
    root = scratch_path(spark, "generations")
    listed = lambda now: (now.table("contacts").join(
        now.table("roster").select(F.col("username").alias("loginAccount")).distinct(), "loginAccount", "left_semi"))
    for k in SNAPSHOT_KEYS:
        gens.refresh_generation(spark, root, k, {"roster": _roster(spark, sf), "contacts": _contacts(spark, sf)},
                                {"contacts_with_friends": listed}, keep=KEEP_SNAPSHOTS)
    return gens.generation_sizes(spark, root)


# ------------------------------------------------------------ contact search

def _prestige_matches(spark, sf):
    return ct.contacts_by_prestige(loaded.contacts_in_parts(spark, sf), _inbound(spark, sf), CALLER_ID,
                                   PRESTIGE_THRESHOLD, (), ())


def _affinity_matches(spark, sf):
    return ct.contacts_by_affinity(loaded.contacts_in_parts(spark, sf), _inbound(spark, sf), CALLER_ID,
                                   AFFINITY_MY_INDUSTRY, AFFINITY_AREA, fx.all_industry_codes())


def _prestige_lists_matches(spark, sf):
    return ct.contacts_by_prestige(loaded.contacts_in_parts(spark, sf), _inbound(spark, sf), CALLER_ID,
                                   LISTS_THRESHOLD, LISTS_AREAS, LISTS_INDUSTRIES)


def contacts_by_prestige_lists_page(spark, sf):
    return ct.seek_page(_prestige_lists_matches(spark, sf), *LISTS_PAGE)


def contacts_by_prestige_lists_count(spark, sf):
    return ct.count_matches(_prestige_lists_matches(spark, sf))


def contacts_by_prestige_page(spark, sf):
    return ct.seek_page(_prestige_matches(spark, sf), *PRESTIGE_PAGE)


def contacts_by_prestige_count(spark, sf):
    return ct.count_matches(_prestige_matches(spark, sf))


def contacts_by_affinity_page(spark, sf):
    return ct.seek_page(_affinity_matches(spark, sf), *AFFINITY_PAGE, flags=ct.AFFINITY_FLAGS)


def contacts_by_affinity_count(spark, sf):
    return ct.count_matches(_affinity_matches(spark, sf))


def contacts_result(spark, sf):
    """Page and total of one result, its items as rows."""
    one = ct.seek_result(_prestige_matches(spark, sf), *PRESTIGE_PAGE)
    return one.select("count", F.posexplode("items").alias("pos", "item")).select("count", "pos", "item.*")


def _contact_callers(spark, sf):
    return _contacts(spark, sf).select(F.col("userID").alias("caller")).distinct()


def contacts_page_all_callers(spark, sf):
    pages, _ = ct.contacts_page_many(_contacts(spark, sf), _inbound(spark, sf), _contact_callers(spark, sf),
                                     *MANY_PAGE, prestige_amount=PRESTIGE_THRESHOLD)
    return pages


def contacts_count_all_callers(spark, sf):
    matches = ct.prestige_filter(_contacts(spark, sf), PRESTIGE_THRESHOLD)
    return ct.count_many(matches, _inbound(spark, sf), _contact_callers(spark, sf))


def affinity_page_all_callers(spark, sf):
    aff = dict(my_industry_code=AFFINITY_MY_INDUSTRY, area_code=AFFINITY_AREA,
               industry_codes=fx.all_industry_codes())
    pages, _ = ct.contacts_page_many(_contacts(spark, sf), _inbound(spark, sf), _contact_callers(spark, sf),
                                     *AFFINITY_PAGE, affinity=aff)
    return pages


def affinity_page_own_codes(spark, sf):
    """Every contact searches with its own industry and area; one in
    ``NO_INDUSTRY_EVERY`` leaves its industry out."""
    c = _contacts(spark, sf)
    callers = c.select(F.col("userID").alias("caller"),
                       F.when(F.col("userID") % NO_INDUSTRY_EVERY != 0, F.col("industryCode")).alias("my_industry_code"),
                       F.col("areaCode").alias("area_code"))
    pages, _ = ct.affinity_page_own_codes(c, _inbound(spark, sf), callers, *AFFINITY_PAGE,
                                          industry_codes=fx.all_industry_codes())
    return pages


# ------------------------------------------------------------ column functions

def _t(spark, sf, name):
    return fx.table(spark, sf, name)


def round_half_up(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     nb.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("value"))


def truncate_decimal(spark, sf):
    li = _t(spark, sf, "lineitem")
    x = F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))
    return li.select("l_orderkey", "l_linenumber", nb.truncate_decimal(x, 2).alias("value"))


def trim_array(spark, sf):
    d = _t(spark, sf, "documents")
    lines = tx.trim_array(F.split(F.col("text"), "\n"))
    return d.select("doc_id", F.posexplode(lines).alias("line_no", "value"))


def trim_all_columns(spark, sf):
    return tx.trim_all_columns(_t(spark, sf, "customer"))


def array_to_struct(spark, sf):
    o = _t(spark, sf, "orders")
    s = tx.array_to_struct(F.split(F.col("o_orderpriority"), "-", 2), 2)
    return o.select("o_orderkey", s.alias("p")).select("o_orderkey", "p._1", "p._2")


def _orders_dates(spark, sf, *cols):
    return _t(spark, sf, "orders").select("o_orderkey", *cols)


def _events_dates(spark, sf, *cols):
    return _t(spark, sf, "events").select("event_id", *cols)


DT = "yyyy-MM-dd HH:mm:ss"


def date_format_col(spark, sf):
    return _orders_dates(spark, sf, dt.date_format_col("o_orderdate", "yyyy/MM/dd").alias("value"))


def days_ago(spark, sf):
    return _events_dates(spark, sf, dt.days_ago("ts", 30, DT).alias("value"))


def months_ago(spark, sf):
    return _orders_dates(spark, sf, dt.months_ago("o_orderdate", 1).alias("value"))


def month_end_ago(spark, sf):
    return _orders_dates(spark, sf, dt.month_end_ago("o_orderdate", 2).alias("value"))


def week_bounds_ago(spark, sf):
    return (_events_dates(spark, sf, dt.week_bounds_ago("ts", 1).alias("w"))
            .select("event_id", "w.week_begin", "w.week_end"))


def years_ago(spark, sf):
    return _orders_dates(spark, sf, dt.years_ago("o_orderdate", 1).alias("value"))


def time_ago(spark, sf):
    return _events_dates(spark, sf, dt.time_ago("ts", 36, "HOUR", DT).alias("value"))


def epoch_ms_format(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _events_dates(spark, sf, dt.epoch_ms_format(ms, "yyyy-MM-dd HH:mm:ss.SSS").alias("value"))


def extract_ymd(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", dt.extract_ymd("text").alias("value"))


def extract_ym(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", dt.extract_ym("text").alias("value"))


def date_parts(spark, sf):
    return _orders_dates(spark, sf, *dt.date_parts("o_orderdate"))


def parse_date(spark, sf):
    s = F.date_format("o_orderdate", "yyyy-M-d")
    return _orders_dates(spark, sf, dt.parse_date(s).alias("value"))


def reformat_date(spark, sf):
    s = F.date_format("o_orderdate", "yyyy/MM/dd")
    return _orders_dates(spark, sf, dt.reformat_date(s, "yyyy/MM/dd", "dd.MM.yyyy").alias("value"))


def days_in_month(spark, sf):
    return _orders_dates(spark, sf, dt.days_in_month("o_orderdate").alias("value"))


def quarter_start(spark, sf):
    return _events_dates(spark, sf, dt.quarter_start("ts", DT).alias("value"))


# ------------------------------------------------------------ cogroup

def _cogroup_sides(spark, sf) -> list[DataFrame]:
    r = _roster(spark, sf)
    pres = fx.prestige(spark, sf)
    return [
        _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"),
                                         F.col("c_custkey").alias("ord")),
        _t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"),
                                       F.col("o_orderkey").alias("ord")),
        _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("value"),
                                       F.col("event_id").alias("ord")),
        pres.select(F.col("user_id").alias("key"), F.col("amount").cast("double").alias("value"),
                    F.col("user_id").alias("ord")),
        r.select(F.col("userID").alias("key"), (F.col("rosterID") / F.lit(1000.0)).alias("value"),
                 F.col("rosterID").alias("ord")),
        _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"),
                                         F.col("s_suppkey").alias("ord")),
    ]


def _more_sides(spark, sf) -> list[DataFrame]:
    li = _t(spark, sf, "lineitem")
    return [
        _t(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"),
                                     F.col("p_partkey").alias("ord")),
        _t(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"),
                                       F.col("n_regionkey").cast("double").alias("value"),
                                       F.col("n_nationkey").cast("bigint").alias("ord")),
        _t(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("key"),
                                       F.col("r_regionkey").cast("double").alias("value"),
                                       F.col("r_regionkey").cast("bigint").alias("ord")),
        li.select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("value"),
                  (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")),
    ]


def cogroup_ten(spark, sf):
    sides = _cogroup_sides(spark, sf) + _more_sides(spark, sf)
    return cg.cogroup_sizes(cg.cogroup_n(sides, order="ord"), len(sides))


def cogroup_sizes(spark, sf):
    sides = _cogroup_sides(spark, sf)
    return cg.cogroup_sizes(cg.cogroup_n(sides, order="ord"), len(sides))


def cogroup_values(spark, sf):
    """The values of six sides, each with its own type."""
    sides = _cogroup_sides(spark, sf)
    sides[3] = fx.prestige(spark, sf).select(F.col("user_id").alias("key"), F.col("amount").alias("value"),
                                             F.col("user_id").alias("ord"))
    sides[4] = _roster(spark, sf).select(F.col("userID").alias("key"), F.col("rosterID").alias("value"),
                                         F.col("rosterID").alias("ord"))
    return cg.cogroup_values(cg.cogroup_n(sides, order="ord"), len(sides), order="ord")


def first_or_default(spark, sf):
    sides = _cogroup_sides(spark, sf)
    return cg.first_or_default(cg.cogroup_n(sides, order="ord"), len(sides), order="ord",
                               default=COGROUP_DEFAULT, round_bits=2)


# ------------------------------------------------------------ files and snapshots

def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    fl.write_csv(_t(spark, sf, "customer"), path)
    return fl.csv_scan(spark, path)


def text_scan(spark, sf):
    path = scratch_path(spark, "text")
    fl.write_text(_t(spark, sf, "documents"), path, column="text")
    return fl.text_scan(spark, path)


def whole_text_scan(spark, sf):
    """Files of all documents, read back as chunks of whole lines: their lines."""
    path = scratch_path(spark, "whole-text")
    fl.write_text(_t(spark, sf, "documents"), path, column="text")
    return fl.whole_text_chunks(spark, path).select(F.explode(F.split("value", "\n")).alias("value"))


def delimited_roundtrip(spark, sf):
    path = scratch_path(spark, "delimited")
    fl.write_delimited(fx.view_ofroster(spark, sf), path, sep="\t")
    return fl.text_scan(spark, path)


def _snapshot_cycle(spark, sf) -> str:
    """Three refreshes of the roster, 720 minutes apart, keeping two."""
    root = scratch_path(spark, "roster-snapshots")
    src = ro.load_roster(fx.view_ofroster(spark, sf))
    for k in SNAPSHOT_KEYS:
        sn.refresh(spark, src, root, k, keep=KEEP_SNAPSHOTS, sort_by=("username",))
    return root


def latest_snapshot(spark, sf):
    return sn.latest_snapshot(spark, _snapshot_cycle(spark, sf))


def retained_snapshots(spark, sf):
    root = _snapshot_cycle(spark, sf)
    sizes = spark.read.parquet(root).groupBy("snapshot_ms").agg(F.count(F.lit(1)).alias("n_rows"))
    return sn.snapshot_list(spark, root).join(sizes, "snapshot_ms")


QUERIES: dict[str, Query] = {
    "roster_scan": roster_scan,
    "contacts_denorm": contacts_denorm,
    "friends_one_hop": friends_one_hop,
    "friends_two_hop_raw": friends_two_hop_raw,
    "friends_two_hop_strict": friends_two_hop_strict,
    "reachable_within_two": reachable_within_two,
    "common_friend_count": common_friend_count,
    "common_friend_table": common_friend_table,
    "relation_table": relation_table,
    "person_relation": person_relation,
    "common_friend_all_callers": common_friend_all_callers,
    "relation_all_callers": relation_all_callers,
    "relation_all_callers_split": relation_all_callers_split,
    "common_friend_all_callers_split": common_friend_all_callers_split,
    "two_hop_raw_all_callers": two_hop_raw_all_callers,
    "common_friend_count_many": common_friend_count_many,
    "common_friend_table_cached": common_friend_table_cached,
    "relation_table_cached": relation_table_cached,
    "derived_missing_callers": derived_missing_callers,
    "relation_table_after_edits": relation_table_after_edits,
    "common_friend_table_after_edits": common_friend_table_after_edits,
    "derived_after_refresh": derived_after_refresh,
    "generation_tables": generation_tables,
    "person_relation_many": person_relation_many,
    "contacts_by_prestige_page": contacts_by_prestige_page,
    "contacts_by_prestige_count": contacts_by_prestige_count,
    "contacts_by_prestige_lists_page": contacts_by_prestige_lists_page,
    "contacts_by_prestige_lists_count": contacts_by_prestige_lists_count,
    "contacts_by_affinity_page": contacts_by_affinity_page,
    "contacts_by_affinity_count": contacts_by_affinity_count,
    "contacts_result": contacts_result,
    "contacts_page_all_callers": contacts_page_all_callers,
    "contacts_count_all_callers": contacts_count_all_callers,
    "affinity_page_all_callers": affinity_page_all_callers,
    "affinity_page_own_codes": affinity_page_own_codes,
    "round_half_up": round_half_up,
    "truncate_decimal": truncate_decimal,
    "trim_array": trim_array,
    "trim_all_columns": trim_all_columns,
    "array_to_struct": array_to_struct,
    "date_format_col": date_format_col,
    "days_ago": days_ago,
    "months_ago": months_ago,
    "month_end_ago": month_end_ago,
    "week_bounds_ago": week_bounds_ago,
    "years_ago": years_ago,
    "time_ago": time_ago,
    "epoch_ms_format": epoch_ms_format,
    "extract_ymd": extract_ymd,
    "extract_ym": extract_ym,
    "date_parts": date_parts,
    "parse_date": parse_date,
    "reformat_date": reformat_date,
    "days_in_month": days_in_month,
    "quarter_start": quarter_start,
    "cogroup_n": cogroup_sizes,
    "cogroup_ten": cogroup_ten,
    "cogroup_values": cogroup_values,
    "first_or_default": first_or_default,
    "csv_scan": csv_scan,
    "text_scan": text_scan,
    "whole_text_scan": whole_text_scan,
    "delimited_roundtrip": delimited_roundtrip,
    "latest_snapshot": latest_snapshot,
    "retained_snapshots": retained_snapshots,
}
