"""Pages of many callers, pages by code pair and pages found through the rank
directory, against brute force on random tables."""

import random

import pytest
from pyspark.sql import functions as F

from amity.operators import contacts as ct
from amity.operators import paging

SCHEMA = ("userID bigint, loginAccount string, headImgUrl string, certify int, nickname string, prestigeAmount int, "
          "position string, companyName string, areaName string, industryProvide string, industryRequirement string, "
          "industryCode int, areaCode int, createTime string")


def people(n, seed):
    rng = random.Random(seed)
    return [(i, f"u{i}", None, i % 2, None, rng.randrange(6), None, None, None, None, None,
             rng.choice([100] * 5 + [200, 300]), rng.choice([1, 1, 1, 2, None]), rng.choice([None, "2015", "2016"]))
            for i in range(1, n + 1)]


def listings(n, seed, hub):
    """Random edges; ``hub`` is listed by nearly everyone."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(3 * n)} | {(i, hub) for i in range(1, n, 1) if i % 7}
    return sorted(pairs)


@pytest.fixture(scope="module")
def table(spark):
    rows = people(90, 3)
    pairs = listings(90, 4, 12)
    contacts = spark.createDataFrame(rows, SCHEMA)
    roster = spark.createDataFrame([(k, f"u{a}", f"u{b}", b) for k, (a, b) in enumerate(pairs)],
                                   "rosterID bigint, username string, loginAccount string, userID bigint")
    return rows, pairs, contacts, roster


def order(row, industry=None, area=None):
    return (-(industry is not None and row[11] == industry), -(area is not None and row[12] == area), -row[5],
            row[13] is not None, row[13] or "", row[0])


def own_list(rows, pairs, caller, industry, area, codes):
    hidden = {f"u{a}" for a, b in pairs if b == caller}
    found = [r for r in rows if r[11] in codes and r[0] != caller and r[1] not in hidden]
    return [r[0] for r in sorted(found, key=lambda r: order(r, industry, area))]


CODES = [(1, 100, 1), (2, 100, 2), (3, 200, 1), (4, None, 1), (5, 100, None), (6, None, None), (7, 900, 9), (12, 100, 1),
         (12, 100, 1), (500, 300, 2), (13, 200, 2)]


@pytest.mark.parametrize("page_no,size", [(1, 4), (2, 4), (3, 10), (9, 10), (1, 200), (50, 3)])
def test_own_codes_equal_brute_force(spark, table, page_no, size):
    rows, pairs, contacts, roster = table
    callers = spark.createDataFrame(CODES, "caller bigint, my_industry_code int, area_code int")
    pages, counts = ct.affinity_page_own_codes(contacts, roster, callers, page_no, size, [100, 200, 300])
    got: dict = {}
    for r in pages.orderBy("caller", "rank").collect():
        got.setdefault(r["caller"], []).append((r["rank"], r["userID"]))
    totals = {r["caller"]: r["count"] for r in counts.collect()}
    for caller, industry, area in set(CODES):
        whole = own_list(rows, pairs, caller, industry, area, {100, 200, 300})
        lo = (page_no - 1) * size
        assert got.get(caller, []) == [(lo + k + 1, u) for k, u in enumerate(whole[lo:lo + size])]
        assert totals[caller] == len(whole)


def test_own_codes_with_hot_levels_and_no_matches(spark, table):
    rows, pairs, contacts, roster = table
    callers = spark.createDataFrame(CODES, "caller bigint, my_industry_code int, area_code int")
    spark.conf.set("amity.skew.hotRows", "5")
    try:
        pages, _ = ct.affinity_page_own_codes(contacts, roster, callers, 2, 5, [100, 200])
        got = sorted((r["caller"], r["rank"], r["userID"]) for r in pages.collect())
    finally:
        spark.conf.unset("amity.skew.hotRows")
    assert got == sorted((c, 6 + k, u) for c, i, a in set(CODES)
                         for k, u in enumerate(own_list(rows, pairs, c, i, a, {100, 200})[5:10]))
    pages, counts = ct.affinity_page_own_codes(contacts, roster, callers, 1, 5, [])
    assert pages.collect() == [] and {r["count"] for r in counts.collect()} == {0}
    nobody, none = ct.affinity_page_own_codes(contacts, roster, callers.limit(0), 1, 5, [100])
    assert nobody.collect() == [] and none.collect() == []


def test_runs_across_buckets(spark, monkeypatch):
    """Left-out positions in many buckets: places and positions stay aligned."""
    monkeypatch.setattr(paging, "_BUCKET_BITS", 3)
    rng = random.Random(5)
    left = {c: sorted(rng.sample(range(1, 201), k)) for c, k in ((1, 0), (2, 1), (3, 60), (4, 200), (5, 199))}
    out = spark.createDataFrame([(c, x) for c, xs in left.items() for x in xs], "caller bigint, x bigint")
    callers = spark.createDataFrame([(c,) for c in left], "caller bigint")
    for lo, hi in ((1, 7), (50, 90), (139, 141), (190, 260)):
        got = sorted((r["caller"], r["pos"], r["x"]) for r in paging.page_slots(out, callers, F.lit(200), lo, hi).collect())
        want = []
        for c, xs in left.items():
            free = [x for x in range(1, 201) if x not in set(xs)]
            want += [(c, k, free[k - 1]) for k in range(lo, min(hi, len(free)) + 1)]
        assert got == sorted(want)


@pytest.fixture(scope="module")
def parts(spark, table, tmp_path_factory):
    _, _, contacts, _ = table
    path = str(tmp_path_factory.mktemp("parts") / "contacts")
    spark.conf.set("amity.contacts.rowsPerPart", "8")
    paging.write_rank_parts(contacts, ct.prestige_order(), path)
    spark.conf.unset("amity.contacts.rowsPerPart")
    return spark.read.parquet(path)


def test_parts_follow_the_order(spark, parts):
    assert parts.select("part").distinct().count() > 5
    whole = [r["userID"] for r in parts.orderBy(*ct.prestige_order()).collect()]
    by_part = [r["userID"] for r in parts.orderBy("part", *ct.prestige_order()).collect()]
    assert whole == by_part


@pytest.mark.parametrize("page_no,size", [(1, 5), (3, 7), (6, 10), (40, 10), (1, 500)])
def test_seek_equals_sorting(spark, table, parts, page_no, size):
    _, _, contacts, roster = table
    for uid, args in ((1, (0,)), (12, (2, (1,), (100, 200))), (99, (100,))):
        a = ct.contacts_by_prestige(parts, roster, uid, *args)
        b = ct.contacts_by_prestige(contacts, roster, uid, *args)
        want = sorted(map(tuple, ct.page(b, ct.prestige_order(), page_no, size).collect()))
        assert sorted(map(tuple, ct.seek_page(a, page_no, size).collect())) == want
        both = ct.seek_result(a, page_no, size).collect()
        assert len(both) == 1 and both[0]["count"] == b.count()
        assert [i["userID"] for i in both[0]["items"]] == [r[1] for r in want]
    a = ct.contacts_by_affinity(parts, roster, 2, 100, 1, [100, 200])
    b = ct.contacts_by_affinity(contacts, roster, 2, 100, 1, [100, 200])
    want = sorted(map(tuple, ct.page(b, ct.affinity_order(), page_no, size).collect()))
    assert sorted(map(tuple, ct.seek_page(a, page_no, size, ct.AFFINITY_FLAGS).collect())) == want


def _parts_read(df):
    """Folders that each file scan of an executed plan listed as read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(p.metrics().apply("numPartitions").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_deep_page_reads_its_parts_only(spark, table, parts):
    """Neither a sort of all rows before the page nor a read of all parts: the
    matches are counted once, and the page reads fewer folders."""
    _, _, _, roster = table
    matches = ct.contacts_by_prestige(parts, roster, 1, -1)
    pg = ct.seek_page(matches, 12, 5)
    assert "TakeOrdered" not in pg._jdf.queryExecution().toString()
    assert "dynamicpruning" in pg._jdf.queryExecution().toString().lower()
    whole = parts.select("part").distinct().count()
    assert min(_parts_read(pg)) <= 3 < whole


def test_required_columns(spark, table):
    rows, _, contacts, _ = table
    ct.check_required(contacts)
    bad = spark.createDataFrame([r if r[0] != 4 else r[:5] + (None,) + r[6:] for r in rows], SCHEMA)
    with pytest.raises(ValueError, match="prestigeAmount.*1"):
        ct.check_required(bad)
    with pytest.raises(ValueError, match="areaCode"):
        ct.check_required(contacts, ("areaCode",))
    ct.check_required(contacts.limit(0))
