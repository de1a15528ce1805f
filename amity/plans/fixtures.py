"""The social-graph and person tables, derived from the driver's TPC-H-like tables.

Every line item is a friend edge: the order's customer lists another customer,
whose key follows from the part and the supplier; line items that name the same
pair are one edge.  Person records are built from customer, nation and orders.  Each builder is a plain DataFrame plan over
the given parquet tables, so its work grows with them; ``fixture_sql()`` holds
the same views as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# fixed values of the test fixture (FIXTURES.md): one line item in FAR_EVERY names
# the customer with its supplier's key, the others one of NEAR_KEYS customers from
# NEAR_BACK keys before the buyer on; id stride of rosterID, area and industry code base
FAR_EVERY = 8
NEAR_KEYS = 9
NEAR_BACK = 2
ROSTER_ID_STRIDE = 4_294_967_296  # 2^32
AREA_CODE_BASE = 330000
INDUSTRY_CODE_BASE = 100001000
INDUSTRY_CODE_STEP = 1000
INDUSTRY_CODE_COUNT = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_listing: the distinct pairs (customer ac, listed customer bc) of all
    line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    near = F.col("o_custkey") + F.col("l_partkey") % NEAR_KEYS - NEAR_BACK
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("o_custkey").alias("ac"),
                    F.when(F.col("l_partkey") % FAR_EVERY == 0, F.col("l_suppkey"))
                    .otherwise(near).cast("bigint").alias("bc"))
            .distinct())


def view_ofroster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_view_ofroster: rosterID, username, loginAccount, userID, sub.

    Keys that no customer has fall out in the second lookup.  A rosterID holds
    both keys; past 2^31 customers it overflows, which raises and never collides."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    ca = cust.select(F.col("c_custkey").alias("ac"), F.col("c_name").alias("username"))
    cb = cust.select(F.col("c_custkey").alias("bc"), F.col("c_name").alias("loginAccount"),
                     F.col("c_acctbal").alias("b_acctbal"))
    return (listings(spark, sf_dir).join(ca, "ac").join(cb, "bc")
            .select(
                (F.col("ac") * F.lit(ROSTER_ID_STRIDE) + F.col("bc")).alias("rosterID"),
                "username", "loginAccount",
                F.when(F.col("b_acctbal") < -500, F.lit(None)).otherwise(F.col("bc"))
                .cast("bigint").alias("userID"),
                F.when((F.col("ac") + F.col("bc")) % 10 == 0, F.lit(1)).otherwise(F.lit(3))
                .cast("int").alias("sub"),
            ))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_user."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = (table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    k = F.col("c_custkey")
    return (cust.join(first, cust.c_custkey == first.o_custkey, "left")
            .select(
                k.alias("id"),
                F.col("c_name").alias("login_account"),
                F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("img/"), "c_name"))
                .alias("headimgurl"),
                (k % 2).cast("int").alias("certify"),
                F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("nick "), "c_name"))
                .alias("nickname"),
                F.when(k % 10 == 9, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("status"),
                F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("first_order")).alias("create_time"),
            ))


def prestige(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_prestige: number of orders per customer."""
    return (table(spark, sf_dir, "orders").groupBy("o_custkey")
            .agg(F.count(F.lit(1)).cast("int").alias("amount"))
            .withColumnRenamed("o_custkey", "user_id"))


def business_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_business_card."""
    cust = table(spark, sf_dir, "customer")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return (cust.join(nat, cust.c_nationkey == nat.n_nationkey)
            .select(
                k.alias("user_id"),
                F.col("c_mktsegment").alias("position"),
                F.concat("c_mktsegment", F.lit(" co")).alias("company_name"),
                F.col("n_name").alias("v_area_name"),
                F.when(k % 13 == 0, F.lit(None))
                .otherwise(F.lit(AREA_CODE_BASE) + F.col("n_nationkey")).cast("int").alias("v_area_code"),
                F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("offer")).alias("industry_provide"),
                F.when(k % 3 == 1, F.lit(None)).otherwise(F.lit("want")).alias("industry_requirement"),
                (F.lit(INDUSTRY_CODE_BASE) + F.lit(INDUSTRY_CODE_STEP) * (k % INDUSTRY_CODE_COUNT))
                .cast("int").alias("industry_code"),
                F.when(F.col("c_acctbal") >= 0, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("status"),
            ))


def all_industry_codes() -> list[int]:
    return [INDUSTRY_CODE_BASE + INDUSTRY_CODE_STEP * i for i in range(INDUSTRY_CODE_COUNT)]


@lru_cache(maxsize=1)
def fixture_sql() -> dict[str, str]:
    """The fixture views as DuckDB/ANSI SQL, in dependency order."""
    return {
        "fx_listing": (
            "select distinct o_custkey as ac, cast(case when l_partkey % 8 = 0 then l_suppkey "
            "else o_custkey + l_partkey % 9 - 2 end as bigint) as bc "
            "from lineitem join orders on l_orderkey = o_orderkey"),
        "fx_view_ofroster": (
            "select x.ac * 4294967296 + x.bc as rosterID, ca.c_name as username, cb.c_name as loginAccount, "
            "case when cb.c_acctbal < -500 then null else cb.c_custkey end as userID, "
            "case when (x.ac + x.bc) % 10 = 0 then 1 else 3 end as sub "
            "from fx_listing x join customer ca on ca.c_custkey = x.ac "
            "join customer cb on cb.c_custkey = x.bc"),
        "fx_user": (
            "select c_custkey as id, c_name as login_account, "
            "case when c_custkey % 5 = 0 then null else concat('img/', c_name) end as headimgurl, "
            "cast(c_custkey % 2 as int) as certify, "
            "case when c_custkey % 7 = 0 then null else concat('nick ', c_name) end as nickname, "
            "case when c_custkey % 10 = 9 then 0 else 1 end as status, "
            "case when c_custkey % 11 = 0 then null else first_order end as create_time "
            "from customer left join "
            "(select o_custkey, min(o_orderdate) as first_order from orders group by o_custkey) x "
            "on o_custkey = c_custkey"),
        "fx_prestige": (
            "select o_custkey as user_id, cast(count(*) as int) as amount from orders group by o_custkey"),
        "fx_business_card": (
            "select c_custkey as user_id, c_mktsegment as position, "
            "concat(c_mktsegment, ' co') as company_name, n_name as v_area_name, "
            "case when c_custkey % 13 = 0 then null else 330000 + n_nationkey end as v_area_code, "
            "case when c_custkey % 3 = 0 then null else 'offer' end as industry_provide, "
            "case when c_custkey % 3 = 1 then null else 'want' end as industry_requirement, "
            "cast(100001000 + 1000 * (c_custkey % 13) as int) as industry_code, "
            "case when c_acctbal >= 0 then 1 else 0 end as status "
            "from customer join nation on n_nationkey = c_nationkey"),
        "ofroster": (
            "select rosterID, username, loginAccount, userID from fx_view_ofroster "
            "where sub = 3 and userID is not null"),
        "industry_contacts": (
            "select u.id as userID, u.login_account as loginAccount, u.headimgurl as headImgUrl, "
            "u.certify as certify, u.nickname as nickname, p.amount as prestigeAmount, "
            "b.position as position, b.company_name as companyName, b.v_area_name as areaName, "
            "b.industry_provide as industryProvide, b.industry_requirement as industryRequirement, "
            "b.industry_code as industryCode, b.v_area_code as areaCode, u.create_time as createTime "
            "from fx_business_card b join fx_user u on b.user_id = u.id "
            "join fx_prestige p on p.user_id = b.user_id where b.status = 1 and u.status = 1"),
    }


def with_fixtures(query: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``query`` with the fixture views it needs, then ``extra``
    (name, sql) pairs, as CTEs."""
    needs = {
        "fx_listing": (), "fx_view_ofroster": ("fx_listing",), "ofroster": ("fx_view_ofroster",),
        "fx_user": (), "fx_prestige": (), "fx_business_card": (),
        "industry_contacts": ("fx_user", "fx_prestige", "fx_business_card"),
    }
    wanted: set[str] = set()

    def add(n: str) -> None:
        for d in needs[n]:
            add(d)
        wanted.add(n)

    for n in names:
        add(n)
    sql = fixture_sql()
    ctes = [f"{n} as ({sql[n]})" for n in sql if n in wanted]
    ctes += [f"{n} as ({q})" for n, q in extra]
    return "with " + ",\n".join(ctes) + "\n" + query
