"""Skew join, distributed ranking, registry and driver contract."""

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from amity.plans.ranking import global_rank, index_in_group
from amity.plans.skew import skew_join


def test_skew_join_matches_plain(spark):
    left = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("l"))
    right = spark.range(0, 40).select((F.col("id") % 4).alias("k"), F.col("id").alias("r"))
    plain = rows(left.join(right, "k"), "k", "l", "r")
    for rows_limit in (10, 100000):
        assert rows(skew_join(left, right, ["k"], hot_rows=rows_limit), "k", "l", "r") == plain
    semi = rows(left.join(right, "k", "left_semi"), "k", "l")
    assert rows(skew_join(left, right, ["k"], how="left_semi", hot_rows=10), "k", "l") == semi


def test_global_rank_and_group_index(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("v"))
    ranked = global_rank(df.repartition(7), [F.col("v").asc()])
    got = sorted((r["v"], r["rank"]) for r in ranked.collect())
    assert got == [(v, v + 1) for v in range(500)]
    g = spark.range(0, 300).select((F.col("id") % 3).alias("g"), (F.col("id") * 2).alias("x"))
    idx = index_in_group(g, ["g"], "x", idx_col="i", bucket=16)
    expect = g.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("x")).cast("bigint"))
    assert rows(idx, "g", "x", "i") == rows(expect, "g", "x", "i")


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.columns == ["pos", "username", "comm_friend_num"]
    assert df.count() > 0
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q)
