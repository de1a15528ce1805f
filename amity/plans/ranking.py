"""Distributed positions: a global rank over a total order and a row index
inside groups, neither of which moves a whole table or a whole group into one
task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amity.session import staged

_PART_BITS = 33  # monotonically_increasing_id: partition index above bit 33


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with a 1-based ``rank_col`` following ``order`` (a total order).

    A range-partitioned sort numbers rows inside each partition and is written
    once, so every later use sees the same numbers, also after an executor loss;
    running sums of the per-partition counts (one small row per partition, never
    per data row) are joined back as offsets."""
    numbered = staged(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
                      .withColumn("_part", F.shiftright("_mid", _PART_BITS)), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    local = F.col("_mid") - F.shiftleft("_part", _PART_BITS)
    return (numbered.join(offsets, "_part")
            .withColumn(rank_col, (F.col("_off") + local + F.lit(1)).cast("bigint"))
            .drop("_mid", "_part", "_off"))


def _index_by_bucket(with_b: DataFrame, group: list[str], order: Sequence, idx_col: str) -> DataFrame:
    """1-based position inside the group by (``_b``, ``order``), where ``_b``
    follows ``order``: rows are counted per (group, _b), a running sum over those
    counts gives each bucket's offset, a row number inside (group, _b) adds the
    rest."""
    counts = with_b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    same = F.col("_b") == F.col("_ob")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (with_b.withColumn("_loc", local).join(offsets, same)
            .withColumn(idx_col, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_b", "_loc", "_off", "_ob", *[f"_g{i}" for i in range(len(group))]))


def index_in_group(df: DataFrame, group: Sequence[str], order_col: str,
                   idx_col: str = "_idx", bucket: int = 65_536) -> DataFrame:
    """1-based position of each row inside its group by ``order_col`` (a
    non-negative integer, unique inside the group). No task sorts a whole
    group: at most ``bucket`` rows of it at a time."""
    b = F.floor(F.col(order_col) / F.lit(bucket)).cast("bigint")
    return _index_by_bucket(df.withColumn("_b", b), list(group), [order_col], idx_col)


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], idx_col: str = "_idx") -> DataFrame:
    """The same for any sortable ``order`` columns: the rows are range partitioned by
    them (written once, so that the ranges stay what they are), which cuts a group
    of any size into as many ranges. Null keys are a group."""
    ranges = staged(df.repartitionByRange(*[F.asc(c) for c in order]).withColumn("_b", F.spark_partition_id()), "ranges")
    return _index_by_bucket(ranges, list(group), order, idx_col)
