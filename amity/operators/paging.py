"""Pages of ranked lists that many callers share, each without some rows.

A list is its positions x = 1 .. N. A caller that must not see the positions
x_1 < .. < x_k has a list of its own: after x_i come the free positions
x_i+1 .. x_(i+1)-1, which are its places x_i+1-i .. x_(i+1)-1-i. A page touches at
most page_size + 1 of these runs, so it is found by arithmetic from the left-out
positions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amity.plans.ranking import index_in_group
from amity.plans.skew import skew_join

_BUCKET_BITS = 16      # positions of a caller that one task orders
_RANK_BITS = 44        # ranks below 2^44; the segment number stands above
_LEVELS = 4            # segments of a code pair's list


def free_runs(left_out: DataFrame, callers: DataFrame, total: Column) -> DataFrame:
    """(caller, first, last, shift): the runs of a caller's list, places first ..
    last of which stand at position place + shift. ``left_out``: (caller, x),
    distinct; ``total``: length of the shared list.

    Positions are ordered within (caller, bucket of 65,536 positions), buckets
    within the caller, so that no task orders all left-out positions of one
    caller. Position 0 stands for the beginning of the list."""
    x = left_out.select("caller", "x").unionByName(callers.select("caller", F.lit(0).cast("bigint").alias("x")))
    x = x.withColumn("_b", F.shiftright("x", _BUCKET_BITS))
    inside = Window.partitionBy("caller", "_b").orderBy("x")
    local = x.select("caller", "_b", "x", F.row_number().over(inside).alias("_at"), F.lead("x").over(inside).alias("_next"))
    across = Window.partitionBy("caller").orderBy("_b")
    buckets = x.groupBy("caller", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x")).select(
        "caller", "_b", F.lead("_x").over(across).alias("_then"),
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    shift = F.col("_before") + F.col("_at") - 1
    ends = F.coalesce(F.col("_next"), F.col("_then")) - 1
    return local.join(buckets, ["caller", "_b"]).select(
        "caller", (F.col("x") + 1 - shift).alias("first"), (F.coalesce(ends, total) - shift).alias("last"),
        shift.cast("bigint").alias("shift"))


def page_slots(left_out: DataFrame, callers: DataFrame, total: Column, lo: int, hi: int) -> DataFrame:
    """(caller, pos, x): the positions x of the shared list that stand at places
    ``lo`` .. ``hi`` of each caller's own."""
    runs = free_runs(left_out, callers, total).where(
        (F.col("first") <= F.col("last")) & (F.col("first") <= hi) & (F.col("last") >= lo))
    places = F.sequence(F.greatest("first", F.lit(lo).cast("bigint")), F.least("last", F.lit(hi).cast("bigint")))
    return runs.select("caller", "shift", F.explode(places).alias("pos")).select(
        "caller", "pos", (F.col("pos") + F.col("shift")).alias("x"))


# ---------------------------------------------------------------- one caller: seek

#: rows in a part of a ranked table
ROWS_PER_PART = 65_536


def write_rank_parts(df: DataFrame, order: Sequence[Column], path: str) -> None:
    """``df`` in folders ``part`` = 0, 1, ... that follow ``order``: every row of a
    part comes before every row of the next, and a part is sorted. About
    ``ROWS_PER_PART`` rows each (``amity.contacts.rowsPerPart``)."""
    per = int(df.sparkSession.conf.get("amity.contacts.rowsPerPart", str(ROWS_PER_PART)))
    parts = max(1, -(-df.count() // per))
    (df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
     .sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part").parquet(path))


def rank_directory(matches: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """(flags..., part, n, before): matches by part, with the number of matches in
    all parts before it. ``flags`` (1 before 0) stand before the part in the order."""
    keys = [F.desc(f) for f in flags] + [F.asc("part")]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)   # one row a part
    return (matches.groupBy(*flags, "part").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))


def seek(matches: DataFrame, directory: DataFrame, order: Sequence[Column], lo: int, hi: int,
         flags: Sequence[str] = ()) -> DataFrame:
    """Rows ``lo`` .. ``hi`` of ``matches`` with ``rank``. Only the parts that hold
    them are read (dynamic partition pruning) and sorted, however deep the page.
    A part that is needed holds one of the rows, so at most hi - lo + 1 directory
    rows are broadcast."""
    needed = directory.where((F.col("before") < hi) & (F.col("before") + F.col("n") >= lo)).drop("n")
    inside = Window.partitionBy(*flags, "part").orderBy(*order)
    return (matches.join(F.broadcast(needed), [*flags, "part"])
            .withColumn("rank", (F.col("before") + F.row_number().over(inside)).cast("bigint"))
            .where(F.col("rank").between(lo, hi)))


# ---------------------------------------------------------------- code pairs

def _kinds(industry: str, area: str) -> Column:
    """The four keys a row or a code pair stands under: both codes, the industry,
    the area, neither."""
    i, a, no = F.col(industry).cast("bigint"), F.col(area).cast("bigint"), F.lit(0).cast("bigint")
    return F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("_i"), y.alias("_a"))
                     for k, (x, y) in enumerate([(i, a), (i, no), (no, a), (no, no)], start=1)])


def _with_kinds(df: DataFrame, industry: str, area: str) -> DataFrame:
    cols = df.columns
    return (df.withColumn("_key", F.explode(_kinds(industry, area))).select(*cols, "_key.*")
            .where(F.col("_i").isNotNull() & F.col("_a").isNotNull()))


def _level(rank: str) -> Column:
    """Ranks 1, 2-3, 4-7, ...: exact number of binary digits, less one."""
    return F.length(F.bin(rank)) - 1


def _levels_needed(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, my_industry_code, area_code, depth, kind, _i, _a, _lvl): for every
    pair and segment, the rank levels that hold its first rows, as many as the
    pair's depth asks for once the segments before are used up. Counts by level
    and code are the only statistics; they come from one aggregate."""
    cells = ranked.groupBy("industryCode", "areaCode", _level("rank").alias("_lvl")).agg(F.count(F.lit(1)).alias("_n"))
    under = (_with_kinds(cells, "industryCode", "areaCode")
             .groupBy("kind", "_i", "_a", "_lvl").agg(F.sum("_n").alias("_n")))
    asked = _with_kinds(pairs, "my_industry_code", "area_code")
    wide = (asked.join(under, ["kind", "_i", "_a"]).groupBy("pair", "my_industry_code", "area_code", "depth", "_lvl")
            .agg(*[F.sum(F.when(F.col("kind") == k, F.col("_n")).otherwise(0)).alias(f"_k{k}") for k in range(1, 5)]))
    both, ind, area, every = (F.col(f"_k{k}") for k in range(1, 5))
    sizes = [both, ind - both, area - both, every - ind - area + both]
    wide = wide.select("pair", "my_industry_code", "area_code", "depth", "_lvl",
                       *[n.alias(f"_n{s}") for s, n in enumerate(sizes, start=1)])
    whole = Window.partitionBy("pair")
    upto = whole.orderBy("_lvl").rowsBetween(Window.unboundedPreceding, -1)
    left, wanted = F.col("depth"), []
    for s in range(1, _LEVELS + 1):
        n = F.col(f"_n{s}")
        wide = (wide.withColumn(f"_before{s}", F.coalesce(F.sum(n).over(upto), F.lit(0)))
                .withColumn(f"_total{s}", F.sum(n).over(whole)))
        wanted.append(F.when((n > 0) & (F.col(f"_before{s}") < left), F.lit(s)))
        left = left - F.col(f"_total{s}")
    out = wide.select("pair", "my_industry_code", "area_code", "depth", "_lvl",
                      F.explode(F.filter(F.array(*wanted), lambda s: s.isNotNull())).alias("kind"))
    i = F.when(F.col("kind") <= 2, F.col("my_industry_code")).otherwise(0)
    a = F.when(F.col("kind") % 2 == 1, F.col("area_code")).otherwise(0)
    return out.withColumn("_i", i.cast("bigint")).withColumn("_a", a.cast("bigint"))


def segment_lists(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, x, rank): the first ``depth`` rows of the list of every code pair, x
    from 1. ``ranked``: rank, industryCode, areaCode; ``pairs``: pair,
    my_industry_code, area_code, depth.

    The list is: rows with both codes, other rows of the industry, other rows of the
    area, the rest, each by rank. A segment's rows are read level by level of the
    rank (1, 2-3, 4-7, ...), only as many levels as needed, so a pair reads about
    twice its depth and never the whole ranking; levels that many pairs need are
    dealt over a grid of tasks."""
    rows = _with_kinds(ranked.select("rank", "industryCode", "areaCode").withColumn("_lvl", _level("rank")),
                       "industryCode", "areaCode")
    met = skew_join(_levels_needed(ranked, pairs), rows, ["kind", "_i", "_a", "_lvl"])
    same_i = F.coalesce(F.col("industryCode") == F.col("my_industry_code"), F.lit(False))
    same_a = F.coalesce(F.col("areaCode") == F.col("area_code"), F.lit(False))
    segment = F.when(same_i & same_a, 1).when(same_i, 2).when(same_a, 3).otherwise(4)
    place = F.shiftleft(F.col("kind").cast("bigint"), _RANK_BITS) + F.col("rank")
    met = met.where(F.col("kind") == segment).select("pair", "depth", "rank", place.alias("_place"))
    return (index_in_group(met, ["pair"], "_place", idx_col="x").where(F.col("x") <= F.col("depth"))
            .select("pair", "x", "rank"))
