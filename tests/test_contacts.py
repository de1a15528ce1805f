"""Contact search: filters, exclusion of inbound owners, ranking with ties
and nulls, paging bounds, and the many-caller form against brute force."""

import datetime as dt

import pytest
from conftest import rows

from amity.operators import contacts as ct

C_SCHEMA = ("userID bigint, loginAccount string, headImgUrl string, certify int, nickname string, "
            "prestigeAmount int, position string, companyName string, areaName string, "
            "industryProvide string, industryRequirement string, industryCode int, areaCode int, "
            "createTime timestamp_ntz")
R_SCHEMA = "rosterID bigint, username string, loginAccount string, userID bigint"


def contacts(spark):
    t = lambda d: dt.datetime(2016, 1, d)
    data = [
        (1, "u1", None, 1, None, 50, "p", "c", None, None, None, 100, 330001, t(5)),
        (2, "u2", "i2", 0, "n2", 50, "p", "c", "x", "o", "w", 200, 330002, t(3)),
        (3, "u3", "i3", 1, "n3", 50, "p", "c", "x", "o", "w", 100, None, None),
        (4, "u4", "i4", 0, "n4", 30, "p", "c", "x", "o", "w", 100, 330002, t(1)),
        (5, "u5", "i5", 1, "n5", 10, "p", "c", "x", "o", "w", 300, 330001, t(2)),
        (6, "u6", "i6", 0, "n6", 50, "p", "c", "x", "o", "w", 100, 330002, t(3)),
        (7, "u7", "i7", 1, "n7", 70, "p", "c", "x", "o", "w", 200, 330003, t(9)),
    ]
    return spark.createDataFrame(data, C_SCHEMA)


def roster(spark):
    # u4 and u7 list user 1 as a friend; u2 lists user 6
    return spark.createDataFrame([(1, "u4", "u1", 1), (2, "u7", "u1", 1), (3, "u2", "u6", 6)], R_SCHEMA)


def test_prestige_order_ties_nulls(spark):
    m = ct.contacts_by_prestige(contacts(spark), roster(spark), 1, 10)
    got = [r["userID"] for r in ct.page(m, ct.prestige_order(), 1, 10).orderBy("rank").collect()]
    # excluded: 1 (caller), 4 and 7 (inbound owners), 5 (prestige 10 not > 10)
    # prestige 50: null createTime first, then 01-03 (2 before 6 by id)
    assert got == [3, 2, 6]


def test_items_null_to_empty(spark):
    m = ct.contacts_by_prestige(contacts(spark), roster(spark), 2, 0)
    first = ct.page(m, ct.prestige_order(), 1, 10).where("userID = 1").collect()[0]
    assert first["headImgUrl"] == "" and first["contacts"] == "" and first["vAreaName"] == ""
    assert first["industryProvide"] == "" and first["industryRequirement"] == ""


def test_optional_lists(spark):
    m = ct.contacts_by_prestige(contacts(spark), roster(spark), 1, 0, area_codes=[330002], industry_codes=[100])
    ids = sorted(r["userID"] for r in m.collect())
    assert ids == [6]  # 4 is an inbound owner of user 1, 3 has a null area


def test_affinity_flags(spark):
    m = ct.contacts_by_affinity(contacts(spark), roster(spark), 5, 200, 330003, [100, 200])
    got = [r["userID"] for r in ct.page(m, ct.affinity_order(), 1, 10).orderBy("rank").collect()]
    assert got == [7, 2, 3, 6, 1, 4]
    m0 = ct.contacts_by_affinity(contacts(spark), roster(spark), 5, None, None, [100, 200])
    got0 = [r["userID"] for r in ct.page(m0, ct.prestige_order(), 1, 10).orderBy("rank").collect()]
    assert got0 == [7, 3, 2, 6, 1, 4]
    assert ct.contacts_by_affinity(contacts(spark), roster(spark), 5, None, None, []).count() == 0


def test_pages(spark):
    m = ct.contacts_by_prestige(contacts(spark), roster(spark), 99, 0)
    order = ct.prestige_order()
    assert ct.page(m, order, 1, 3).count() == 3
    assert [r["rank"] for r in ct.page(m, order, 3, 3).collect()] == [7]
    assert ct.page(m, order, 4, 3).count() == 0
    with pytest.raises(ValueError):
        ct.page(m, order, 0, 3)
    with pytest.raises(ValueError):
        ct.contacts_by_prestige(contacts(spark), roster(spark), None, 0)
    res = ct.result(m, order, 2, 3).collect()[0]
    expect = [r["userID"] for r in ct.page(m, order, 2, 3).orderBy("rank").collect()]
    assert res["count"] == 7
    assert [i["userID"] for i in res["items"]] == expect and len(expect) == 3


def test_pages_join_to_the_whole_list(spark):
    m = ct.contacts_by_prestige(contacts(spark), roster(spark), 99, 0)
    order = ct.prestige_order()
    whole = rows(ct.page(m, order, 1, 1000))
    parts = [r for p in range(1, 20) for r in rows(ct.page(m, order, p, 2))]
    assert sorted(parts) == sorted(whole)


def _brute(spark, callers, page_no, size):
    c = contacts(spark).collect()
    r = roster(spark).collect()
    out = {}
    for caller in callers:
        inbound = {x["username"] for x in r if x["userID"] == caller}
        cand = [x for x in c if x["prestigeAmount"] > 0 and x["userID"] != caller and x["loginAccount"] not in inbound]
        cand.sort(key=lambda x: (-x["prestigeAmount"], x["createTime"] is not None,
                                 x["createTime"] or dt.datetime.min, x["userID"]))
        out[caller] = (len(cand), [x["userID"] for x in cand[(page_no - 1) * size: page_no * size]])
    return out


@pytest.mark.parametrize("page_no,size", [(1, 2), (2, 2), (3, 2), (4, 2), (1, 10)])
def test_many_callers_match_brute_force(spark, page_no, size):
    callers = [1, 2, 6, 7, 42]
    cdf = spark.createDataFrame([(c,) for c in callers], "caller bigint")
    pages, counts = ct.contacts_page_many(contacts(spark), roster(spark), cdf, page_no, size, prestige_amount=0)
    got = {}
    for row in pages.orderBy("caller", "rank").collect():
        got.setdefault(row["caller"], []).append(row["userID"])
    cnt = {r["caller"]: r["count"] for r in counts.collect()}
    for c, (n, ids) in _brute(spark, callers, page_no, size).items():
        assert cnt[c] == n
        assert got.get(c, []) == ids


def test_null_login_account_and_null_area(spark):
    extra = spark.createDataFrame(
        [(8, None, "i8", 1, "n8", 90, "p", "c", "x", "o", "w", 100, 330002, None),
         (9, "u9", "i9", 1, "n9", None, "p", "c", "x", "o", "w", 100, None, None)], C_SCHEMA)
    c = contacts(spark).unionByName(extra)
    for uid in (1, 99):  # with and without inbound exclusions
        m = ct.contacts_by_prestige(c, roster(spark), uid, 0)
        ids = {r["userID"] for r in m.collect()}
        assert 8 not in ids and 9 not in ids  # no account; null prestige fails the threshold
    # an area parameter of -1 never matches a null area
    m = ct.contacts_by_affinity(c, roster(spark), 99, None, -1, [100])
    assert {r["userID"]: r["sameArea"] for r in m.collect()}[9] == 0
