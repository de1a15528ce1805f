"""Column functions: rounding, Java-style trim, tuple building, dates."""

import datetime as dt


from amity.functions import dates as d
from amity.functions import numbers as nb
from amity.functions import text as tx


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (1.009,), (-1.009,), (0.29,)], "x double")
    got = [(r[0], r[1]) for r in df.select(nb.round_half_up("x"), nb.truncate_decimal("x")).collect()]
    assert got == [(1.01, 1.0), (2.68, 2.67), (-1.01, -1.0), (1.01, 1.0), (-1.01, -1.0), (0.29, 0.29)]


def test_java_trim(spark):
    df = spark.createDataFrame([("\t a \n",), (" b",), (None,), ("\x00c\x1f",), (" d",)], "s string")
    got = [r[0] for r in df.select(tx.java_trim("s")).collect()]
    assert got == ["a", "b", None, "c", " d"]  # no-break space is above U+0020
    arr = spark.createDataFrame([([" x ", "\ty", ""],)], "a array<string>")
    assert arr.select(tx.trim_array("a")).collect()[0][0] == ["x", "y", ""]


def test_trim_all_columns_and_struct(spark):
    df = spark.createDataFrame([(1, " a ", 2.5)], "i int, s string, x double")
    assert tx.trim_all_columns(df).collect()[0].asDict() == {"i": "1", "s": "a", "x": "2.5"}
    s = spark.createDataFrame([(["p", "q"],)], "a array<string>").select(tx.array_to_struct("a", 3).alias("t"))
    assert s.collect()[0]["t"].asDict() == {"_1": "p", "_2": "q", "_3": None}


def test_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 10, 11, 12),), (dt.datetime(2024, 3, 3, 8, 0, 0),)],
                               "ts timestamp_ntz")
    r = df.select(
        d.months_ago("ts", 1).alias("m"), d.years_ago("ts", 1).alias("y"),
        d.month_end_ago("ts", 1).alias("me"), d.days_ago("ts", 2, "yyyy-MM-dd HH:mm").alias("dd"),
        d.week_bounds_ago("ts", 0).alias("w"), d.quarter_start("ts", "yyyy-MM-dd HH:mm:ss").alias("q"),
        d.days_in_month("ts").alias("n"), *d.date_parts("ts")).collect()
    a, b = r
    assert (a["m"], a["y"], a["me"], a["dd"]) == ("2024-02-29", "2023-03-31", "2024-02-29", "2024-03-29 10:11")
    # 2024-03-31 is a Sunday: it ends the week that began on Monday 03-25
    assert (a["w"]["week_begin"], a["w"]["week_end"]) == ("2024-03-25", "2024-03-31")
    assert (b["w"]["week_begin"], b["w"]["week_end"]) == ("2024-02-26", "2024-03-03")
    assert a["q"] == "2024-01-01 10:11:12" and a["n"] == 31 and (a["year"], a["month"], a["day"]) == (2024, 3, 31)


def test_messy_dates(spark):
    df = spark.createDataFrame([("2015-4-3",), ("x2015/04/03y",), ("2015-13-45",), ("x2015-4/3z",), (None,), ("none",)],
                               "s string")
    r = df.select(d.extract_ymd("s").alias("ymd"), d.extract_ym("s").alias("ym"), d.parse_date("s").alias("p")).collect()
    assert [x["ymd"] for x in r] == ["2015-4-3", "2015/04/03", "2015-13-45", "2015-4/3", None, ""]
    assert [x["ym"] for x in r] == ["2015-4", "2015/04", "2015-13", "2015-4", None, ""]
    assert [x["p"] for x in r] == [dt.datetime(2015, 4, 3), None, None, None, None, None]


def test_epoch_and_reformat(spark):
    df = spark.createDataFrame([(0,), (1469664000123,)], "ms bigint")
    got = [r[0] for r in df.select(d.epoch_ms_format("ms", "yyyy-MM-dd HH:mm:ss.SSS")).collect()]
    assert got == ["1970-01-01 00:00:00.000", "2016-07-28 00:00:00.123"]
    s = spark.createDataFrame([("2016/07/28",)], "s string")
    assert s.select(d.reformat_date("s", "yyyy/MM/dd", "dd.MM.yyyy")).collect()[0][0] == "28.07.2016"


def test_truncate_of_wide_doubles(spark):
    df = spark.createDataFrame([(1e25,), (-1e25,), (1e15 + 0.125,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(nb.truncate_decimal("x")).collect()]
    assert got[:3] == [1e25, -1e25, 1e15 + 0.12] and got[3] != got[3] and got[4] is None
