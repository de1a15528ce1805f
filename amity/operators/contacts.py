"""Contact search over the denormalised person table.

Two rankings, both filtered, ranked and paged, and both leaving out the caller
and every account that lists the caller as a friend (inbound roster edges,
matched on ``loginAccount``):

* prestige: ``prestigeAmount > x`` with optional industry and area lists;
  order prestige desc, createTime asc (nulls first);
* affinity: mandatory industry list; order same-industry flag desc,
  same-area flag desc, prestige desc, createTime asc (nulls first).

``userID`` then ``loginAccount`` break remaining ties, so pages are
deterministic.  Pages are 1-based; ``rank`` is the position in the full
result list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amity.operators.paging import page_slots, rank_directory, seek, segment_lists
from amity.plans.ranking import global_rank
from amity.session import staged

CONTACT_COLUMNS = ("userID", "loginAccount", "headImgUrl", "certify", "nickname",
                   "prestigeAmount", "position", "companyName", "areaName",
                   "industryProvide", "industryRequirement", "industryCode",
                   "areaCode", "createTime")

# the 11 fields of one result item, in order
ITEM_COLUMNS = ("userID", "loginAccount", "headImgUrl", "certify", "contacts",
                "prestigeAmount", "position", "companyName", "vAreaName",
                "industryProvide", "industryRequirement")

def contacts_denorm(cards: DataFrame, users: DataFrame, prestige: DataFrame) -> DataFrame:
    """card ⋈ user ⋈ prestige, both statuses 1: the 14 person columns."""
    b = cards.alias("b")
    u = users.alias("u")
    p = prestige.alias("p")
    return (b.join(u, F.col("b.user_id") == F.col("u.id"))
            .join(p, F.col("p.user_id") == F.col("b.user_id"))
            .where((F.col("b.status") == 1) & (F.col("u.status") == 1))
            .select(
                F.col("u.id").alias("userID"),
                F.col("u.login_account").alias("loginAccount"),
                F.col("u.headimgurl").alias("headImgUrl"),
                F.col("u.certify").alias("certify"),
                F.col("u.nickname").alias("nickname"),
                F.col("p.amount").alias("prestigeAmount"),
                F.col("b.position").alias("position"),
                F.col("b.company_name").alias("companyName"),
                F.col("b.v_area_name").alias("areaName"),
                F.col("b.industry_provide").alias("industryProvide"),
                F.col("b.industry_requirement").alias("industryRequirement"),
                F.col("b.industry_code").alias("industryCode"),
                F.col("b.v_area_code").alias("areaCode"),
                F.col("u.create_time").alias("createTime"),
            ))


#: columns of a person record that a search cannot do without
REQUIRED_COLUMNS = ("userID", "loginAccount", "certify", "prestigeAmount")


def check_required(contacts: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> None:
    """Raises ValueError if a required column holds a null, with the number of
    rows for each; one aggregate over the table, run when a snapshot is loaded."""
    bad = contacts.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in columns]).first()
    found = {c: bad[c] for c in columns if bad[c]}
    if found:
        raise ValueError(f"null values in required columns: {found}")


def _check_user(user_id) -> int:
    if user_id is None:
        raise ValueError("user_id is required")
    return int(user_id)


def _check_page(page_no: int, page_size: int) -> None:
    if page_no < 1 or page_size < 1:
        raise ValueError("page_no and page_size must be >= 1")


def _bounds(page_no: int, page_size: int) -> tuple[int, int]:
    """First and last position of a page."""
    return (page_no - 1) * page_size + 1, page_no * page_size


def inbound_owners(roster: DataFrame, user_id: int) -> DataFrame:
    """Accounts whose roster lists ``user_id`` as a friend (``loginAccount``)."""
    return (roster.where(F.col("userID") == F.lit(int(user_id)))
            .select(F.col("username").alias("loginAccount")).distinct())


def _in(col: str, values: Sequence[int]) -> Column:
    return F.col(col).isin([int(v) for v in values])


def prestige_filter(contacts: DataFrame, prestige_amount: int,
                    area_codes: Sequence[int] = (), industry_codes: Sequence[int] = ()) -> DataFrame:
    """Shared part of the prestige search: optional lists, strict threshold.
    Rows without a login account are never results (the exclusion is an
    anti join on it)."""
    f = contacts.where(F.col("loginAccount").isNotNull())
    if industry_codes:
        f = f.where(_in("industryCode", industry_codes))
    if area_codes:
        f = f.where(_in("areaCode", area_codes))
    return f.where(F.col("prestigeAmount") > F.lit(int(prestige_amount)))


def prestige_order() -> list[Column]:
    return [F.desc("prestigeAmount"), F.asc_nulls_first("createTime"),
            F.asc("userID"), F.asc("loginAccount")]


def affinity_filter(contacts: DataFrame, my_industry_code, area_code,
                    industry_codes: Sequence[int]) -> DataFrame:
    """Shared part of the affinity search: mandatory industry list (empty
    matches nothing) and the two match flags (null parameter -> 0; a null
    area never matches)."""
    f = (contacts.where(F.col("loginAccount").isNotNull())
         .where(_in("industryCode", industry_codes) if industry_codes else F.lit(False)))
    same_ind = (F.lit(0) if my_industry_code is None else
                F.when(F.col("industryCode") == F.lit(int(my_industry_code)), 1).otherwise(0))
    same_area = (F.lit(0) if area_code is None else
                 F.when(F.col("areaCode") == F.lit(int(area_code)), 1).otherwise(0))
    return f.withColumn("sameIndustry", same_ind.cast("int")).withColumn("sameArea", same_area.cast("int"))


def affinity_order() -> list[Column]:
    return [F.desc("sameIndustry"), F.desc("sameArea")] + prestige_order()


def _exclude(f: DataFrame, roster: DataFrame, user_id: int) -> DataFrame:
    return (f.where(F.col("userID") != F.lit(user_id))
            .join(inbound_owners(roster, user_id), "loginAccount", "left_anti"))


def contacts_by_prestige(contacts: DataFrame, roster: DataFrame, user_id, prestige_amount: int,
                         area_codes: Sequence[int] = (), industry_codes: Sequence[int] = ()) -> DataFrame:
    """All matches of the prestige search for one caller (unordered)."""
    uid = _check_user(user_id)
    return _exclude(prestige_filter(contacts, prestige_amount, area_codes, industry_codes), roster, uid)


def contacts_by_affinity(contacts: DataFrame, roster: DataFrame, user_id, my_industry_code,
                         area_code, industry_codes: Sequence[int]) -> DataFrame:
    """All matches of the affinity search for one caller (unordered)."""
    uid = _check_user(user_id)
    return _exclude(affinity_filter(contacts, my_industry_code, area_code, industry_codes), roster, uid)


def items(df: DataFrame) -> list[Column]:
    """The 11 item fields, nullable strings as ''."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("userID").cast("bigint").alias("userID"), F.col("loginAccount"),
            s("headImgUrl").alias("headImgUrl"), F.col("certify").cast("int").alias("certify"),
            s("nickname").alias("contacts"), F.col("prestigeAmount").cast("int").alias("prestigeAmount"),
            s("position").alias("position"), s("companyName").alias("companyName"),
            s("areaName").alias("vAreaName"), s("industryProvide").alias("industryProvide"),
            s("industryRequirement").alias("industryRequirement")]


def page(matches: DataFrame, order: Sequence[Column], page_no: int, page_size: int) -> DataFrame:
    """Rows ``(page_no-1)*page_size+1 .. page_no*page_size`` of ``matches`` in
    ``order``: (rank, 11 item fields).  Short last page; empty past the end."""
    _check_page(page_no, page_size)
    skipped = (page_no - 1) * page_size
    # only the rows of the page are numbered
    top = matches.orderBy(*order).offset(skipped).limit(page_size)
    at = F.row_number().over(Window.orderBy(*order)) + F.lit(skipped)
    return top.withColumn("rank", at.cast("bigint")).select("rank", *items(top))


def count_matches(matches: DataFrame) -> DataFrame:
    """Total before paging: one row (count)."""
    return matches.agg(F.count(F.lit(1)).alias("count"))


def _one_row(total: DataFrame, pg: DataFrame) -> DataFrame:
    """Page and total as one row: (count bigint, items array<struct>) with items
    in rank order; a union of two one-row aggregates, so no join is needed."""
    fields = [c for c in pg.columns if c != "rank"]
    packed = pg.agg(F.collect_list(F.struct("rank", *fields)).alias("_items"))
    items_col = F.transform(F.array_sort("_items"), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    both = (total.select(F.col("count"), F.lit(None).alias("items0"))
            .unionByName(packed.select(F.lit(None).cast("bigint").alias("count"),
                                       items_col.alias("items0"))))
    return both.agg(F.max("count").alias("count"), F.first("items0", ignorenulls=True).alias("items"))


def result(matches: DataFrame, order: Sequence[Column], page_no: int, page_size: int) -> DataFrame:
    """Page and total of any matches as one row (count, items)."""
    return _one_row(count_matches(matches), page(matches, order, page_no, page_size))


#: the flags that stand before the order by prestige in the affinity ranking
AFFINITY_FLAGS = ("sameIndustry", "sameArea")


def seek_page(matches: DataFrame, page_no: int, page_size: int, flags: Sequence[str] = ()) -> DataFrame:
    """``page`` of contacts that lie in parts by prestige (column ``part``), for
    either ranking: matches are counted by part, and only the parts of the page are
    read again and sorted, however deep it lies."""
    _check_page(page_no, page_size)
    rows = seek(matches, rank_directory(matches, flags), prestige_order(), *_bounds(page_no, page_size), flags)
    return rows.select("rank", *items(rows))


def seek_result(matches: DataFrame, page_no: int, page_size: int, flags: Sequence[str] = ()) -> DataFrame:
    """Page and total as one row (count, items). Both come from the counts by
    part, whose shuffle is shared: the matches are evaluated once, but for the
    parts of the page."""
    _check_page(page_no, page_size)
    directory = rank_directory(matches, flags)
    total = directory.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    rows = seek(matches, directory, prestige_order(), *_bounds(page_no, page_size), flags)
    return _one_row(total, rows.select("rank", *items(rows)))


# ---------------------------------------------------------------- many callers

def _caller_ids(callers: DataFrame, *more: str) -> DataFrame:
    return callers.select(F.col("caller").cast("bigint").alias("caller"), *more).dropDuplicates(["caller"])


def _left_out(ranked: DataFrame, roster: DataFrame, callers: DataFrame) -> DataFrame:
    """(caller, rank): the ranked rows a caller must not see - its own and those
    of accounts that list it. ``ranked``: rank, userID, loginAccount."""
    listing = (roster.select(F.col("userID").alias("caller"), F.col("username").alias("loginAccount"))
               .join(callers.select("caller"), "caller", "left_semi"))
    by_owner = listing.join(ranked.select("loginAccount", "rank"), "loginAccount").select("caller", "rank")
    own = (callers.select("caller").join(ranked.select(F.col("userID").alias("caller"), "rank"), "caller")
           .select("caller", "rank"))
    return by_owner.unionByName(own).distinct()


def _counts(callers: DataFrame, left_out: DataFrame, total: Column) -> DataFrame:
    """(caller, count): all ranked rows less those the caller must not see."""
    k = left_out.groupBy("caller").agg(F.count(F.lit(1)).alias("_k"))
    return (callers.select("caller").join(k, "caller", "left")
            .select("caller", (total - F.coalesce("_k", F.lit(0))).cast("bigint").alias("count")))


def paged_many(matches: DataFrame, order: Sequence[Column], roster: DataFrame, callers: DataFrame,
               page_no: int, page_size: int) -> tuple[DataFrame, DataFrame]:
    """One page and the total for every caller of a shared search.

    ``callers``: column ``caller`` (user id).  Returns (pages, counts):
    pages (caller, rank, 11 item fields), counts (caller, count).

    The shared matches get one distributed global rank; what each caller must not
    see is one table of (caller, rank). ``page_slots`` turns it into the ranks of
    the caller's page, and only those ranks are joined with the items. No caller
    is ever paired with the match list, and one caller with many exclusions
    widens nobody else's work."""
    _check_page(page_no, page_size)
    callers = _caller_ids(callers)
    ranked = global_rank(matches, order)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    left_out = staged(_left_out(ranked, roster, callers), "left-out")
    slots = page_slots(left_out.withColumnRenamed("rank", "x"), callers, total, *_bounds(page_no, page_size))
    # callers share the top ranks: the adaptive skew join splits those of the slots
    pages = (slots.withColumnRenamed("x", "_rank").join(ranked.withColumnRenamed("rank", "_rank"), "_rank")
             .select("caller", F.col("pos").alias("rank"), *items(ranked)))
    return pages, _counts(callers, left_out, total)


def count_many(matches: DataFrame, roster: DataFrame, callers: DataFrame) -> DataFrame:
    """Total of a shared search for every caller, (caller, count), without
    ranking anything: the shared total minus each caller's excluded rows, which
    are counted by account."""
    callers = _caller_ids(callers)
    per_account = matches.groupBy("loginAccount").agg(F.count(F.lit(1)).alias("_n"))
    listing = (roster.select(F.col("userID").alias("caller"), F.col("username").alias("loginAccount"))
               .join(callers, "caller", "left_semi").distinct())
    own = (matches.select(F.col("userID").alias("caller"), "loginAccount")
           .join(callers, "caller", "left_semi").join(listing, ["caller", "loginAccount"], "left_anti")
           .select("caller", F.lit(1).cast("bigint").alias("_n")))
    k = (listing.join(per_account, "loginAccount").select("caller", "_n").unionByName(own)
         .groupBy("caller").agg(F.sum("_n").alias("_k")))
    total = matches.agg(F.count(F.lit(1))).scalar()
    return (callers.join(k, "caller", "left")
            .select("caller", (total - F.coalesce("_k", F.lit(0))).cast("bigint").alias("count")))


def contacts_page_many(contacts: DataFrame, roster: DataFrame, callers: DataFrame, page_no: int,
                       page_size: int, prestige_amount: int | None = None,
                       area_codes: Sequence[int] = (), industry_codes: Sequence[int] = (),
                       affinity: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch form of either search for many callers sharing the filters.
    ``affinity`` = dict(my_industry_code=..., area_code=..., industry_codes=...)
    selects the affinity ranking; otherwise the prestige search is used."""
    if affinity is not None:
        m = affinity_filter(contacts, affinity.get("my_industry_code"), affinity.get("area_code"),
                            affinity.get("industry_codes", ()))
        order = affinity_order()
    else:
        m = prestige_filter(contacts, prestige_amount, area_codes, industry_codes)
        order = prestige_order()
    return paged_many(m, order, roster, callers, page_no, page_size)


def affinity_page_own_codes(contacts: DataFrame, roster: DataFrame, callers: DataFrame, page_no: int,
                            page_size: int, industry_codes: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The affinity search of many callers, each with its own industry and area.

    ``callers``: caller, my_industry_code, area_code (either code may be null: then
    nothing matches it); of rows with the same caller one counts. Returns (pages,
    counts) as ``paged_many``.

    The matches are ranked once, by prestige. A caller's list is four segments of
    that ranking one after another: rows of its industry and area, of its industry,
    of its area, the rest. ``segment_lists`` takes from it, for each pair of codes
    that occurs, as many rows as the deepest page of its callers needs; positions
    in that list are then treated like ranks of a shared search."""
    _check_page(page_no, page_size)
    lo, hi = _bounds(page_no, page_size)
    codes = [F.col("my_industry_code").cast("bigint").alias("my_industry_code"),
             F.col("area_code").cast("bigint").alias("area_code")]
    callers = _caller_ids(callers, *codes).withColumn("pair", F.concat_ws(
        "|", F.coalesce(F.col("my_industry_code").cast("string"), F.lit("-")),
        F.coalesce(F.col("area_code").cast("string"), F.lit("-"))))
    ranked = global_rank(affinity_filter(contacts, None, None, industry_codes), prestige_order())
    total = ranked.agg(F.count(F.lit(1))).scalar()
    left_out = staged(_left_out(ranked, roster, callers), "left-out")
    k = left_out.groupBy("caller").agg(F.count(F.lit(1)).alias("_k"))
    pairs = (callers.join(k, "caller", "left").groupBy("pair", "my_industry_code", "area_code")
             .agg((F.max(F.coalesce("_k", F.lit(0))) + F.lit(hi)).alias("depth")))
    lists = staged(segment_lists(ranked, staged(pairs, "code-pairs")), "code-lists")
    of = callers.select("caller", "pair")
    hidden = left_out.join(of, "caller").join(lists, ["pair", "rank"]).select("caller", "x")
    slots = page_slots(hidden, callers, total, lo, hi)
    pages = (slots.join(of, "caller").join(lists, ["pair", "x"]).withColumnRenamed("rank", "_rank")
             .select("caller", "pos", "_rank").join(ranked.withColumnRenamed("rank", "_rank"), "_rank")
             .select("caller", F.col("pos").alias("rank"), *items(ranked)))
    return pages, _counts(callers, left_out, total)
