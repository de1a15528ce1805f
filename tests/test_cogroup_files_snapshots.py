"""Cogroup, file round trips and the snapshot lifecycle."""

import pytest

from conftest import rows
from pyspark.sql import functions as F

from amity.operators import cogroup as cg
from amity.session import scratch_path
from amity.sources import files as fl
from amity.sources import snapshots as sn


def _side(spark, data):
    return spark.createDataFrame(data, "key bigint, value double, ord bigint")


def test_cogroup_three_and_ten(spark):
    a = _side(spark, [(1, 1.005, 2), (1, 9.0, 1), (2, 3.0, 1)])
    b = _side(spark, [(2, 4.0, 7)])
    c = _side(spark, [(3, 5.0, 1)])
    g = cg.cogroup_n([a, b, c], order="ord")
    assert rows(cg.cogroup_sizes(g, 3)) == [(1, 2, 0, 0), (2, 1, 1, 0), (3, 0, 0, 1)]
    f = rows(cg.first_or_default(g, 3, order="ord", default=-1.0, round_bits=2))
    assert f == [(1, 9.0, -1.0, -1.0), (2, 3.0, 4.0, -1.0), (3, -1.0, -1.0, 5.0)]
    ten = [_side(spark, [(k, float(i), i)]) for i, k in enumerate([1, 1, 2, 2, 3, 3, 4, 4, 5, 5])]
    s = rows(cg.cogroup_sizes(cg.cogroup_n(ten, order="ord"), 10))
    assert len(s) == 5 and all(sum(r[1:]) == 2 for r in s)


def test_csv_text_delimited(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, "c", 2.5)], "i int, s string, x double")
    p = scratch_path(spark, "t-csv")
    fl.write_csv(df, p)
    back = fl.csv_scan(spark, p)
    assert [f.dataType.simpleString() for f in back.schema] == ["string"] * 3
    assert rows(back) == [("1", "a,b", None), ("2", "c", "2.5")]
    p2 = scratch_path(spark, "t-delim")
    fl.write_delimited(df, p2, single_file=True)
    assert rows(fl.text_scan(spark, p2)) == [("1\ta,b\tnull",), ("2\tc\t2.5",)]
    p3 = scratch_path(spark, "t-text")
    fl.write_text(spark.createDataFrame([("x\ny",), ("z",)], "value string"), p3)
    assert rows(fl.text_scan(spark, p3)) == [("x",), ("y",), ("z",)]
    assert fl.whole_text_scan(spark, p3).count() >= 1


def test_snapshot_lifecycle(spark):
    root = scratch_path(spark, "t-snap")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for k in (100, 200, 300):
        sn.refresh(spark, df.withColumn("gen", F.lit(k)), root, k, keep=2)
    assert sn.snapshot_keys(spark, root) == [300, 200]
    latest = sn.latest_snapshot(spark, root)
    assert rows(latest, "id", "gen") == [(1, 300), (2, 300)]
    assert rows(sn.snapshot_list(spark, root)) == [(200, 2), (300, 1)]
    # rewriting a key replaces only that partition
    sn.snapshot_write(df.limit(1).withColumn("gen", F.lit(300)), root, 300)
    assert sn.latest_snapshot(spark, root).count() == 1
    assert sn.retain_snapshots(spark, root, 1) == [300]


def test_derived_tables(spark):
    root = scratch_path(spark, "t-derived")
    d = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "caller string, userName string, n int")
    sn.materialize_derived(d, root, 5)
    assert rows(sn.derived_for(spark, root, 5, "a"), "caller", "userName") == [("a", "x")]
    callers = spark.createDataFrame([("a",), ("c",)], "caller string")
    assert rows(sn.missing_callers(spark, root, 5, callers)) == [("c",)]
    # adding c keeps a and b; e has no rows and is answered for all the same
    more = spark.createDataFrame([("c", "z", 3)], "caller string, userName string, n int")
    answered = spark.createDataFrame([("c",), ("e",)], "caller string")
    sn.materialize_derived(more, root, 5, callers=answered)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "caller string")
    assert rows(sn.derived_for(spark, root, 5, asked), "caller", "userName") == [("a", "x"), ("b", "y"), ("c", "z")]
    assert rows(sn.missing_callers(spark, root, 5, asked)) == [("d",)]
    # a caller added twice is read once
    sn.materialize_derived(more, root, 5)
    assert rows(sn.derived_for(spark, root, 5, "c"), "userName") == [("z",)]
    sn.retain_derived(spark, root, [6])
    assert sn.missing_callers(spark, root, 5, asked).count() == 5


def test_failed_refresh_leaves_the_old_snapshot(spark):
    root = scratch_path(spark, "t-failing")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sn.refresh(spark, df, root, 100, keep=1)
    failing = df.withColumn("v", F.raise_error(F.lit("source failed")).cast("string"))
    with pytest.raises(Exception, match="source failed"):
        sn.refresh(spark, failing, root, 200, keep=1)
    assert sn.snapshot_keys(spark, root) == [100] and sn.latest_snapshot(spark, root).count() == 2
    # a source that reads the same root
    sn.refresh(spark, sn.latest_snapshot(spark, root).drop(sn.SNAPSHOT_COL), root, 300, keep=1)
    assert sn.snapshot_keys(spark, root) == [300] and sn.latest_snapshot(spark, root).count() == 2


def test_whole_text_in_chunks(spark, tmp_path):
    """Small byte ranges: lines of one and of many bytes, longer than a range, empty
    ones; every file is its chunks joined."""
    texts = {"a": "\n".join(f"é line {i} " + "x" * (i % 40) for i in range(300)), "b": "one", "c": "y" * 3000 + "\n\nend",
             "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = fl.whole_text_chunks(spark, str(tmp_path)).orderBy("path", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = {}
    for r in got:
        files.setdefault(r["path"][-5], []).append((r["chunk"], r["value"]))
    assert {k: "\n".join(v for _, v in c) for k, c in files.items()} == {k: t for k, t in texts.items() if t}
    assert len(files["a"]) > 5 and [n for n, _ in files["a"]] == list(range(len(files["a"])))
    assert fl.whole_text_scan(spark, str(tmp_path / "b.txt")).collect()[0]["value"] == "one"


# ------------------------------------------------------------ cogroup: types, values, streams

def test_cogroup_keeps_the_type_of_every_side(spark):
    a = spark.createDataFrame([(1, 2, 1)], "key bigint, value int, ord bigint")
    b = spark.createDataFrame([(1, 2.75, 1), (1, 1.005, 2), (2, None, 1)], "key bigint, value double, ord bigint")
    c = spark.createDataFrame([(1, "x", 1), (None, "y", 2)], "key bigint, value string, ord bigint")
    g = cg.cogroup_n([a, b, c], order="ord")
    assert [g.schema[f"v{i}"].dataType.simpleString() for i in range(3)] == ["int", "double", "string"]
    values = cg.cogroup_values(g, 3, order="ord")
    got = sorted(map(tuple, values.collect()), key=repr)
    assert got == sorted([(1, 1, 2, 2.75, "x"), (1, 2, None, 1.005, None), (2, 1, None, None, None),
                          (None, 1, None, None, "y")], key=repr)
    first = {r["key"]: tuple(r)[1:] for r in cg.first_or_default(g, 3, order="ord", round_bits=2).collect()}
    assert first[1] == (2, 2.75, "x")
    assert cg.cogroup_values(g.limit(0), 3, order="ord").collect() == []


def test_cogroup_values_of_a_hot_key(spark):
    """A key with a third of all rows: its values come in order, from several
    ranges of the order column."""
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"),
                                     (F.col("id") * 2).alias("value"), (-F.col("id")).alias("ord"))
    small = spark.createDataFrame([(7, 0.5, 1)], "key bigint, value double, ord bigint")
    got = cg.cogroup_values(cg.cogroup_n([big, small], order="ord"), 2, order="ord")
    hot = got.where("key = 7").orderBy("pos").collect()
    ids = sorted([i for i in range(30_000) if i % 3 == 0 or i == 7], reverse=True)
    assert [r["v0"] for r in hot] == [2 * i for i in ids] and [r["pos"] for r in hot] == list(range(1, len(ids) + 1))
    assert [r["v1"] for r in hot if r["v1"] is not None] == [0.5]
    assert got.where("key <> 7").count() == 20_000 - 1


def test_cogroup_apply_streams_groups(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    big = spark.range(9_000).select((F.col("id") % 3).alias("key"), F.col("id").alias("value"), F.col("id").alias("ord"))
    names = spark.createDataFrame([(0, "zero", 1), (5, "five", 1), (None, "none", 1), (0, "again", 2)],
                                  "key bigint, value string, ord bigint")
    schema = StructType([StructField("key", LongType()), StructField("what", StringType())])

    def describe(key, values):
        count, last = 0, None
        for side, v in values:
            if side == 0:
                assert last is None or v > last      # in order
                count, last = count + 1, v
            else:
                yield key, f"{v} of {count}"
        yield key, f"{count} in all"

    def peek(key, values):
        yield key, str(next(values))                 # the rest is not read

    got = sorted(map(tuple, cg.cogroup_apply([big, names], describe, schema, order="ord", batch=2).collect()), key=repr)
    assert got == sorted([(0, "zero of 3000"), (0, "again of 3000"), (0, "3000 in all"), (1, "3000 in all"), (2, "3000 in all"),
                          (5, "five of 0"), (5, "0 in all"), (None, "none of 0"), (None, "0 in all")], key=repr)
    first = {r["key"]: r["what"] for r in cg.cogroup_apply([big, names], peek, schema, order="ord").collect()}
    assert first == {0: "(0, 0)", 1: "(0, 1)", 2: "(0, 2)", 5: "(1, 'five')", None: "(1, 'none')"}
