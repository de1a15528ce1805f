"""The reference's manual drivers, replayed on the fixture tables (sf0.01).

Its requests use accounts of its own database; here the same shapes use
fixture accounts: a caller with six candidates (one repeated, two unknown),
one relation id, the threshold search (prestige > 10, empty lists, page
1 x 70) and the affinity search (null industry and area, the 13 industry
codes, page 1 x 100).  Expected values come from DuckDB over the same
tables."""

import pytest
from oracle_check import duck

from amity.operators import common_friends as cf
from amity.operators import contacts as ct
from amity.operators import relations as rel
from amity.plans import fixtures as fx
from amity.plans import loaded
from amity.plans.fixtures import with_fixtures

SF = "/root/testdata/sf0.01"
ME = "Customer#000000005"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_common_friend_driver(spark, con):
    names = [f"Customer#{i:09d}" for i in (0, 1, 3)] + ["nobody-1", "nobody-2", "Customer#000000000"]
    cands = spark.createDataFrame(list(enumerate(names)), "pos int, username string")
    got = [(r["pos"], r["username"], r["comm_friend_num"])
           for r in cf.common_friend_count(loaded.graph(spark, SF), ME, cands).orderBy("pos").collect()]
    sql = with_fixtures(
        "select count(distinct o.loginAccount) from ofroster o where o.username = ? "
        f"and o.loginAccount <> '{ME}' and o.username <> o.loginAccount and o.loginAccount in "
        f"(select loginAccount from ofroster where username = '{ME}')", "ofroster")
    expect = [(i, n, con.execute(sql, [n]).fetchone()[0]) for i, n in enumerate(names)]
    assert got == expect
    assert got[0][2] == got[5][2]  # the repeated candidate keeps its place and value


def test_relation_driver(spark, con):
    import __spark_entry__ as se
    ids = spark.createDataFrame([("1085",)], "user_id string")
    got = [(r["user_id"], r["type"]) for r in rel.person_relation(loaded.graph(spark, SF), ME, ids).collect()]
    sql = f"select userID, friendType from ({se.oracle_sql()['relation_table']}) t where userID = '1085'"
    assert got == [tuple(r) for r in con.execute(sql).fetchall()]


def test_threshold_search_driver(spark, con):
    m = ct.contacts_by_prestige(loaded.contacts(spark, SF), loaded.roster(spark, SF), 1216, 10)
    page = [r["userID"] for r in ct.page(m, ct.prestige_order(), 1, 70).orderBy("rank").collect()]
    total = ct.count_matches(m).collect()[0]["count"]
    sql = with_fixtures(
        "select userID from industry_contacts where userID <> 1216 and prestigeAmount > 10 "
        "and loginAccount not in (select username from ofroster where userID = 1216) "
        "order by prestigeAmount desc, createTime asc nulls first, userID", "ofroster", "industry_contacts")
    rows = [r[0] for r in con.execute(sql).fetchall()]
    assert total == len(rows) and page == rows[:70]


def test_affinity_search_driver(spark, con):
    codes = fx.all_industry_codes()
    m = ct.contacts_by_affinity(loaded.contacts(spark, SF), loaded.roster(spark, SF), 143521, None, None, codes)
    page = [r["userID"] for r in ct.page(m, ct.affinity_order(), 1, 100).orderBy("rank").collect()]
    sql = with_fixtures(
        f"select userID from industry_contacts where industryCode in ({', '.join(map(str, codes))}) "
        "and userID <> 143521 and loginAccount not in (select username from ofroster where userID = 143521) "
        "order by prestigeAmount desc, createTime asc nulls first, userID", "ofroster", "industry_contacts")
    assert page == [r[0] for r in con.execute(sql).fetchall()][:100]
