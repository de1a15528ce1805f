"""Oracle SQL (DuckDB dialect) for the registered queries.

Each text states the set algebra of an operator over the fixture views:
distinct edges without self-loops, their composition, differences by EXCEPT and
exclusions by anti joins.
"""

from __future__ import annotations

from amity.plans.fixtures import all_industry_codes, with_fixtures
from amity.plans.registry import (AFFINITY_AREA, AFFINITY_MY_INDUSTRY, AFFINITY_PAGE, CALLER,
                                  CALLER_ID, COGROUP_DEFAULT, KEEP_SNAPSHOTS, LISTS_AREAS,
                                  LISTS_INDUSTRIES, LISTS_PAGE, LISTS_THRESHOLD, MANY_PAGE, NO_INDUSTRY_EVERY,
                                  PRESTIGE_PAGE, PRESTIGE_THRESHOLD, SNAPSHOT_KEYS)

ME = f"'{CALLER}'"
KEPT_KEYS = sorted(SNAPSHOT_KEYS)[-KEEP_SNAPSHOTS:]
CODES = ", ".join(str(c) for c in all_industry_codes())

ITEMS = ("userID, loginAccount, coalesce(headImgUrl, '') as headImgUrl, certify, "
         "coalesce(nickname, '') as contacts, prestigeAmount, coalesce(position, '') as position, "
         "coalesce(companyName, '') as companyName, coalesce(areaName, '') as vAreaName, "
         "coalesce(industryProvide, '') as industryProvide, "
         "coalesce(industryRequirement, '') as industryRequirement")
PRESTIGE_ORDER = "prestigeAmount desc, createTime asc nulls first, userID, loginAccount"
AFFINITY_ORDER = "sameIndustry desc, sameArea desc, " + PRESTIGE_ORDER


def _r(q: str, *extra: tuple[str, str]) -> str:
    return with_fixtures(q, "ofroster", extra=extra)


def _c(q: str, *extra: tuple[str, str]) -> str:
    return with_fixtures(q, "ofroster", "industry_contacts", extra=extra)


def _page(lo: int, hi: int) -> str:
    return f"rank between {lo} and {hi}"


def _bounds(page: tuple[int, int]) -> tuple[int, int]:
    p, n = page
    return (p - 1) * n + 1, p * n


# distinct edges without self-loops, and the sets around the one caller
EDGES = ("edge", "select distinct username as a, loginAccount as b from ofroster where username <> loginAccount")
FIRST = ("first_hop", f"select b from edge where a = {ME}")
BEYOND = ("beyond", f"select y.b from first_hop x join edge y on y.a = x.b where y.b <> {ME} "
                    "except select b from first_hop")
NEAR = ("near", "select b from first_hop union select b from beyond")
SHARED = ("shared", "select y.a, count(*) as n from first_hop x join edge y using (b) group by y.a")
AROUND = (EDGES, FIRST, BEYOND, NEAR, SHARED)
# numeric ids met on the first hop and on edges from it to accounts beyond
DEGREES = ("degrees", f"select cast(userID as varchar) as userID, min(hop) as friendType from ("
                      f"select userID, 1 as hop from ofroster join first_hop on b = loginAccount "
                      f"where username = {ME} union all "
                      "select r.userID, 2 from first_hop x join ofroster r on r.username = x.b "
                      "semi join beyond z on z.b = r.loginAccount) where userID is not null group by 1")

# who may appear for the caller: not itself, nobody who lists it
VISIBLE = (f"industry_contacts c anti join (select username as loginAccount from ofroster "
           f"where userID = {CALLER_ID}) i using (loginAccount) "
           f"where c.userID <> {CALLER_ID} and c.loginAccount is not null")


def _codes(codes) -> str:
    return f"({', '.join(map(str, codes))})"


PRESTIGE_MATCHES = f"select c.* from {VISIBLE} and c.prestigeAmount > {PRESTIGE_THRESHOLD}"
LISTS_MATCHES = (f"select c.* from {VISIBLE} and c.prestigeAmount > {LISTS_THRESHOLD} "
                 f"and c.industryCode in {_codes(LISTS_INDUSTRIES)} and c.areaCode in {_codes(LISTS_AREAS)}")
AFFINITY_MATCHES = (
    f"select c.*, coalesce(c.industryCode = {AFFINITY_MY_INDUSTRY}, false)::int as sameIndustry, "
    f"coalesce(c.areaCode = {AFFINITY_AREA}, false)::int as sameArea "
    f"from {VISIBLE} and c.industryCode in ({CODES})")

# per-caller forms for every roster owner: the same steps with a caller key
ALL_ONE = ("select distinct username as caller, loginAccount as u from ofroster "
           "where loginAccount <> username")
ALL_TWO = ("select distinct l.caller, r.loginAccount as u, r.userID as uid from one l "
           "join ofroster r on r.username = l.u "
           "where r.username <> r.loginAccount and r.loginAccount <> l.caller "
           "and not exists (select 1 from one z where z.caller = l.caller and z.u = r.loginAccount)")


# decimal text of a double, as Spark and the reference see it
def _dec(x: str) -> str:
    return f"cast(cast({x} as varchar) as decimal(38,18))"


def _half_up(x: str, bits: int = 2) -> str:
    return f"cast(round({_dec(x)}, {bits}) as double)"


def _jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


DT = "'%Y-%m-%d %H:%M:%S'"

COGROUP_SIDES = (
    "select c_custkey as key, 0 as side, c_acctbal as value, c_custkey as ord from customer "
    "union all select o_custkey, 1, o_totalprice, o_orderkey from orders "
    "union all select user_id, 2, value, event_id from events "
    "union all select user_id, 3, cast(amount as double), user_id from fx_prestige "
    "union all select userID, 4, rosterID / 1000.0, rosterID from ofroster "
    "union all select s_suppkey, 5, s_acctbal, s_suppkey from supplier")


COGROUP_MORE = (
    " union all select p_partkey, 6, p_retailprice, p_partkey from part"
    " union all select n_nationkey, 7, cast(n_regionkey as double), n_nationkey from nation"
    " union all select r_regionkey, 8, cast(r_regionkey as double), r_regionkey from region"
    " union all select l_suppkey, 9, l_extendedprice, l_orderkey * 10 + l_linenumber from lineitem")

ALL_RELATIONS = (
    ("t1", "select distinct username as caller, userID as uid from ofroster "
           "where loginAccount <> username and userID is not null"),
    ("t2", "select distinct caller, uid from two where uid is not null"),
    ("rel", "select caller, cast(uid as varchar) as userID, 1 as friendType from t1 union all "
            "select caller, cast(uid as varchar) as userID, 2 as friendType from "
            "(select caller, uid from t2 except select caller, uid from t1)"))


def _functions_sql() -> dict[str, str]:
    o = "from orders"
    return {
        "round_half_up": f"select l_orderkey, l_linenumber, {_half_up('l_extendedprice * l_discount')} as value "
                         f"from lineitem",
        "truncate_decimal": (
            "select l_orderkey, l_linenumber, cast(trunc("
            + _dec("l_extendedprice * (l_discount - 0.05::double)") + ", 2) as double) as value from lineitem"),
        "trim_array": (
            "select doc_id, cast(unnest(range(len(arr))) as int) as line_no, unnest(arr) as value from "
            f"(select doc_id, list_transform(string_split(text, chr(10)), lambda x: {_jtrim('x')}) as arr "
            "from documents)"),
        "trim_all_columns": (
            f"select {_jtrim('cast(c_custkey as varchar)')} as c_custkey, {_jtrim('c_name')} as c_name, "
            f"{_jtrim('cast(c_nationkey as varchar)')} as c_nationkey, "
            f"{_jtrim('cast(c_acctbal as varchar)')} as c_acctbal, {_jtrim('c_mktsegment')} as c_mktsegment "
            "from customer"),
        "array_to_struct": (
            "select o_orderkey, string_split(o_orderpriority, '-')[1] as _1, "
            "case when strpos(o_orderpriority, '-') > 0 then "
            "substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) end as _2 from orders"),
        "date_format_col": f"select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as value {o}",
        "days_ago": f"select event_id, strftime(ts - interval 30 day, {DT}) as value from events",
        "months_ago": f"select o_orderkey, strftime(o_orderdate - interval 1 month, '%Y-%m-%d') as value {o}",
        "month_end_ago": f"select o_orderkey, strftime(last_day(o_orderdate - interval 2 month), '%Y-%m-%d') "
                         f"as value {o}",
        "week_bounds_ago": ("select event_id, strftime(date_trunc('week', ts) - interval 7 day, '%Y-%m-%d') "
                            "as week_begin, strftime(date_trunc('week', ts) - interval 1 day, '%Y-%m-%d') "
                            "as week_end from events"),
        "years_ago": f"select o_orderkey, strftime(o_orderdate - interval 1 year, '%Y-%m-%d') as value {o}",
        "time_ago": f"select event_id, strftime(ts - interval 36 hour, {DT}) as value from events",
        "epoch_ms_format": ("select event_id, strftime(epoch_ms(epoch_us(ts) // 1000), '%Y-%m-%d %H:%M:%S.%g') "
                            "as value from events"),
        "extract_ymd": ("select doc_id, regexp_extract(text, '\\d{4}(/|-)\\d{1,2}(/|-)\\d{1,2}', 0) "
                        "as value from documents"),
        "extract_ym": "select doc_id, regexp_extract(text, '\\d{4}(/|-)\\d{1,2}', 0) as value from documents",
        "date_parts": (f"select o_orderkey, cast(year(o_orderdate) as int) as year, "
                       f"cast(month(o_orderdate) as int) as month, cast(day(o_orderdate) as int) as day {o}"),
        "parse_date": (f"select o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%-m-%-d'), '%Y-%m-%d') "
                       f"as value {o}"),
        "reformat_date": f"select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as value {o}",
        "days_in_month": f"select o_orderkey, cast(day(last_day(o_orderdate)) as int) as value {o}",
        "quarter_start": (f"select event_id, strftime(date_trunc('quarter', ts) + (ts - date_trunc('day', ts)), "
                          f"{DT}) as value from events"),
        "cogroup_ten": with_fixtures(
            "select key, " + ", ".join(f"count(*) filter (where side = {i}) as n{i}" for i in range(10))
            + " from g group by key", "ofroster", "fx_prestige", extra=(("g", COGROUP_SIDES + COGROUP_MORE),)),
        "common_friend_count_many": _r(
            "select q.caller, q.pos, q.candidate, cast(coalesce(n.num, 0) as int) as comm_friend_num "
            "from req q left join cnt n on n.caller = q.caller and n.candidate = q.candidate",
            ("req", "select username as caller, rosterID as pos, loginAccount as candidate from ofroster"),
            ("cnt", "select r.caller, r.candidate, count(distinct o.loginAccount) as num "
                    "from (select distinct caller, candidate from req) r "
                    "join ofroster o on o.username = r.candidate and o.loginAccount <> r.caller "
                    "and o.username <> o.loginAccount "
                    "join ofroster m on m.username = r.caller and m.loginAccount = o.loginAccount "
                    "group by r.caller, r.candidate")),
        "derived_after_refresh": _r(
            f"select cast(k as bigint) as snapshot_ms, friendType, count(*) as n_rows from rel, "
            f"(values {', '.join(f'({k})' for k in KEPT_KEYS)}) t(k) group by 1, 2",
            ("one", ALL_ONE), ("two", ALL_TWO), *ALL_RELATIONS),
        "generation_tables": _c(
            "select t.name as table, cast(k as bigint) as generation, t.n as n_rows from "
            "(select 'roster' as name, (select count(*) from ofroster) as n union all "
            "select 'contacts', (select count(*) from industry_contacts) union all "
            "select 'contacts_with_friends', (select count(*) from industry_contacts "
            "where loginAccount in (select username from ofroster))) t, "
            f"(values {', '.join(f'({k})' for k in KEPT_KEYS)}) g(k)"),
        "person_relation_many": _r(
            "select q.caller, q.user_id, cast(coalesce(x.friendType, 3) as int) as type from req q "
            "left join rel x on x.caller = q.caller and x.userID = q.user_id",
            ("req", "select distinct r.loginAccount as caller, cast(c.c_custkey as varchar) as user_id "
                    "from ofroster r join customer c on c.c_name = r.username"),
            ("one", ALL_ONE), ("two", ALL_TWO), *ALL_RELATIONS),
        "cogroup_n": with_fixtures(
            "select key, " + ", ".join(f"count(*) filter (where side = {i}) as n{i}" for i in range(6))
            + " from g group by key", "ofroster", "fx_prestige", extra=(("g", COGROUP_SIDES),)),
        "cogroup_values": with_fixtures(
            "select key, pos, max(value) filter (where side = 0) as v0, max(value) filter (where side = 1) as v1, "
            "max(value) filter (where side = 2) as v2, cast(max(id) filter (where side = 3) as int) as v3, "
            "max(id) filter (where side = 4) as v4, max(value) filter (where side = 5) as v5 "
            "from (select *, row_number() over (partition by key, side order by ord) as pos from typed) "
            "group by key, pos", "ofroster", "fx_prestige",
            extra=(("g", COGROUP_SIDES),
                   ("typed", "select key, side, value, ord, cast(null as bigint) as id from g where side not in (3, 4) "
                             "union all select user_id, 3, null, user_id, cast(amount as bigint) from fx_prestige "
                             "union all select userID, 4, null, rosterID, rosterID from ofroster"))),
        "first_or_default": with_fixtures(
            "select key, " + ", ".join(
                f"coalesce({_half_up(f'arg_min(value, ord) filter (where side = {i})')}, "
                f"{COGROUP_DEFAULT}::double) as v{i}" for i in range(6))
            + " from g group by key", "ofroster", "fx_prestige", extra=(("g", COGROUP_SIDES),)),
        "csv_scan": ("select cast(c_custkey as varchar) as c_custkey, c_name, "
                     "cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal, "
                     "c_mktsegment from customer"),
        "text_scan": "select unnest(string_split(text, chr(10))) as value from documents",
        "delimited_roundtrip": with_fixtures(
            "select concat_ws(chr(9), cast(rosterID as varchar), username, loginAccount, "
            "coalesce(cast(userID as varchar), 'null'), cast(sub as varchar)) as value from fx_view_ofroster",
            "fx_view_ofroster"),
        "latest_snapshot": _r(f"select rosterID, username, loginAccount, userID, "
                              f"cast({SNAPSHOT_KEYS[-1]} as bigint) as snapshot_ms from ofroster"),
        "retained_snapshots": _r(
            "select k as snapshot_ms, g as generation, (select count(*) from ofroster) as n_rows from (values "
            + ", ".join(f"(cast({k} as bigint), {i + 1})"
                        for i, k in enumerate(sorted(SNAPSHOT_KEYS, reverse=True)[:KEEP_SNAPSHOTS]))
            + ") t(k, g)"),
    }


def oracle_sql() -> dict[str, str]:
    out = _oracle_sql()
    # materialised per-caller tables read back for one caller: same rows
    out["common_friend_table_cached"] = out["common_friend_table"]
    out["relation_table_cached"] = out["relation_table"]
    out["derived_missing_callers"] = out["relation_all_callers"]
    out["whole_text_scan"] = out["text_scan"]
    out["relation_all_callers_split"] = out["relation_all_callers"]
    out["common_friend_all_callers_split"] = out["common_friend_all_callers"]
    # brought over from an older roster: what the newer one gives
    out["relation_table_after_edits"] = out["relation_all_callers"]
    out["common_friend_table_after_edits"] = out["common_friend_all_callers"]
    return out


def _oracle_sql() -> dict[str, str]:
    plo, phi = _bounds(PRESTIGE_PAGE)
    llo, lhi = _bounds(LISTS_PAGE)
    alo, ahi = _bounds(AFFINITY_PAGE)
    mlo, mhi = _bounds(MANY_PAGE)
    return {
        "roster_scan": _r("select rosterID, username, loginAccount, userID from ofroster"),
        "contacts_denorm": with_fixtures("select * from industry_contacts", "industry_contacts"),
        "friends_one_hop": _r("select b as loginAccount from first_hop", *AROUND),
        "friends_two_hop_raw": _r("select distinct r.loginAccount from first_hop x "
                                  "join ofroster r on r.username = x.b", *AROUND),
        "friends_two_hop_strict": _r("select b as loginAccount from beyond", *AROUND),
        "reachable_within_two": _r("select b as loginAccount from near", *AROUND),
        "common_friend_count": _r(
            "select o_orderkey as pos, c_name as username, cast(coalesce(n, 0) as int) as comm_friend_num "
            "from orders join customer on c_custkey = o_custkey left join shared on shared.a = c_name", *AROUND),
        "common_friend_table": _r("select a as userName, cast(n as int) as comFriendsNum "
                                  "from shared semi join near on near.b = shared.a", *AROUND),
        "relation_table": _r("select userID, friendType from degrees", *AROUND, DEGREES),
        "person_relation": _r("select userID as user_id, friendType as type from degrees "
                              "semi join customer on cast(c_custkey as varchar) = userID", *AROUND, DEGREES),
        "common_friend_all_callers": _r(
            "select re.caller, re.u as userName, cast(count(distinct o.loginAccount) as int) as comFriendsNum "
            "from reach re join ofroster o on o.username = re.u "
            "and o.loginAccount <> re.caller and o.username <> o.loginAccount "
            "join one m on m.caller = re.caller and m.u = o.loginAccount group by re.caller, re.u",
            ("one", ALL_ONE), ("two", ALL_TWO),
            ("reach", "select caller, u from one union select caller, u from two")),
        "two_hop_raw_all_callers": _r(
            "select distinct o.caller, r.loginAccount from one o join ofroster r on r.username = o.u",
            ("one", ALL_ONE)),
        "relation_all_callers": _r(
            "select caller, cast(uid as varchar) as userID, 1 as friendType from t1 union all "
            "select caller, cast(uid as varchar) as userID, 2 as friendType from "
            "(select caller, uid from t2 except select caller, uid from t1)",
            ("one", ALL_ONE), ("two", ALL_TWO),
            ("t1", "select distinct username as caller, userID as uid from ofroster "
                   "where loginAccount <> username and userID is not null"),
            ("t2", "select distinct caller, uid from two where uid is not null")),
        "contacts_by_prestige_page": _c(
            f"select rank, {ITEMS} from (select *, row_number() over (order by {PRESTIGE_ORDER}) as rank "
            f"from m) where {_page(plo, phi)}",
            ("m", PRESTIGE_MATCHES)),
        "contacts_result": _c(
            f"select (select count(*) from m) as count, cast(rank - {plo} as int) as pos, {ITEMS} from "
            f"(select *, row_number() over (order by {PRESTIGE_ORDER}) as rank from m) where {_page(plo, phi)}",
            ("m", PRESTIGE_MATCHES)),
        "contacts_by_prestige_count": _c("select count(*) as count from m", ("m", PRESTIGE_MATCHES)),
        "contacts_by_prestige_lists_page": _c(
            f"select rank, {ITEMS} from (select *, row_number() over (order by {PRESTIGE_ORDER}) as rank "
            f"from m) where {_page(llo, lhi)}",
            ("m", LISTS_MATCHES)),
        "contacts_by_prestige_lists_count": _c("select count(*) as count from m", ("m", LISTS_MATCHES)),
        "contacts_by_affinity_page": _c(
            f"select rank, {ITEMS} from (select *, row_number() over (order by {AFFINITY_ORDER}) as rank "
            f"from m) where {_page(alo, ahi)}",
            ("m", AFFINITY_MATCHES)),
        "contacts_by_affinity_count": _c("select count(*) as count from m", ("m", AFFINITY_MATCHES)),
        "contacts_page_all_callers": _c(
            f"select caller, rank, {ITEMS} from (select *, row_number() over "
            f"(partition by caller order by {PRESTIGE_ORDER}) as rank from cand) where {_page(mlo, mhi)}",
            ("callers", "select distinct userID as caller from industry_contacts"),
            ("m", f"select * from industry_contacts where prestigeAmount > {PRESTIGE_THRESHOLD} "
                  f"and loginAccount is not null"),
            ("cand", "select c.caller, m.* from callers c join m on m.userID <> c.caller "
                     "where not exists (select 1 from ofroster r where r.userID = c.caller "
                     "and r.username = m.loginAccount)")),
        "contacts_count_all_callers": _c(
            "select c.caller, count(m.userID) as count from callers c left join m "
            "on m.userID <> c.caller and not exists (select 1 from ofroster r where r.userID = c.caller "
            "and r.username = m.loginAccount) group by c.caller",
            ("callers", "select distinct userID as caller from industry_contacts"),
            ("m", f"select * from industry_contacts where prestigeAmount > {PRESTIGE_THRESHOLD} "
                  f"and loginAccount is not null")),
        "affinity_page_all_callers": _c(
            f"select caller, rank, {ITEMS} from (select *, row_number() over "
            f"(partition by caller order by {AFFINITY_ORDER}) as rank from cand) where {_page(alo, ahi)}",
            ("callers", "select distinct userID as caller from industry_contacts"),
            ("m", f"select *, case when industryCode = {AFFINITY_MY_INDUSTRY} then 1 else 0 end as sameIndustry, "
                  f"case when areaCode = {AFFINITY_AREA} then 1 else 0 end as sameArea "
                  f"from industry_contacts where industryCode in ({CODES}) and loginAccount is not null"),
            ("cand", "select c.caller, m.* from callers c join m on m.userID <> c.caller "
                     "where not exists (select 1 from ofroster r where r.userID = c.caller "
                     "and r.username = m.loginAccount)")),
        "affinity_page_own_codes": _c(
            f"select caller, rank, {ITEMS} from (select *, row_number() over "
            f"(partition by caller order by {AFFINITY_ORDER}) as rank from cand) where {_page(alo, ahi)}",
            ("callers", f"select userID as caller, areaCode as area, case when userID % {NO_INDUSTRY_EVERY} <> 0 "
                        "then industryCode end as industry from industry_contacts"),
            ("m", f"select * from industry_contacts where industryCode in ({CODES}) and loginAccount is not null"),
            ("cand", "select c.caller, m.*, coalesce(m.industryCode = c.industry, false)::int as sameIndustry, "
                     "coalesce(m.areaCode = c.area, false)::int as sameArea "
                     "from callers c join m on m.userID <> c.caller "
                     "where not exists (select 1 from ofroster r where r.userID = c.caller "
                     "and r.username = m.loginAccount)")),
        **_functions_sql(),
    }
