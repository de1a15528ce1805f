"""Equi-joins that stay balanced when one key holds a large share of a side.

One key of an equi-join makes (its left rows) x (its right rows) rows, and
without help all of them in one task.  A key that makes more than
``amity.skew.hotRows`` rows is dealt over a grid: its left rows are split into
``_sl`` groups, its right rows into ``_sr`` groups, every left group meets every
right group in a task of its own, and _sl x _sr tasks of about the target size
share the work however large either side is.  Every other key keeps its one cell.

* Which keys are hot is counted over all rows (partial aggregates), without a
  cap.  A join of n output rows has at most n / hotRows hot keys; no broadcast is
  forced, Spark picks the join with that table by its real size.
* Salts come from ``xxhash64`` of the row, never from ``rand()``: a task that is
  re-run after an executor loss puts every row into the same cell again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of one key that one task may make
DEFAULT_HOT_ROWS = 4_000_000


def hot_rows_setting(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("amity.skew.hotRows", str(DEFAULT_HOT_ROWS)))


def split_table(counts: DataFrame, on: Sequence[str], left_rows: Column, right_rows: Column,
                hot_rows: int) -> DataFrame:
    """(on..., _sl, _sr) of the keys that make more than ``hot_rows`` rows, from
    their rows on both sides.  The grid is as wide as the sides are uneven, so
    the fewest rows are copied."""
    ln, rn = left_rows.cast("double"), right_rows.cast("double")
    cells = F.ceil(ln * rn / F.lit(float(hot_rows))).cast("double")
    wide = F.least(ln, F.greatest(F.lit(1.0), F.ceil(F.sqrt(cells * ln / rn)).cast("double")))
    return (counts.where(ln * rn > F.lit(float(hot_rows)))
            .select(*on, wide.cast("int").alias("_sl"), F.ceil(cells / wide).cast("int").alias("_sr")))


def hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int,
             semi: bool = False) -> DataFrame:
    """``split_table`` of two sides, counted.  A semi join makes at most its left
    rows, and only those are split."""
    lc = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_ln"))
    rc = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_rn"))
    right_rows = F.lit(1) if semi else F.col("_rn")
    return split_table(lc.join(rc, list(on)), on, F.col("_ln"), right_rows, hot_rows)


def degree_hot_keys(edges: DataFrame, src: str, dst: str, hot_rows: int | None = None) -> DataFrame:
    """Accounts of an edge table through which more than ``hot_rows`` two-hop
    paths lead (in-degree x out-degree): (account, indeg, outdeg).  Computed once
    per snapshot and reused by every join on an account."""
    hot_rows = hot_rows or hot_rows_setting(edges)
    indeg = edges.groupBy(F.col(dst).alias("account")).agg(F.count(F.lit(1)).alias("indeg"))
    outdeg = edges.groupBy(F.col(src).alias("account")).agg(F.count(F.lit(1)).alias("outdeg"))
    paths = F.col("indeg").cast("double") * F.col("outdeg").cast("double")
    return indeg.join(outdeg, "account").where(paths > F.lit(float(hot_rows)))


def _dealt(df: DataFrame, hot: DataFrame, on: list[str], own: str, other: str,
           own_splits: str, other_splits: str) -> DataFrame:
    """A row's own group on its side, and a copy for every group of the other."""
    rest = [c for c in df.columns if c not in on] or on
    mine = F.pmod(F.xxhash64(*rest), F.coalesce(own_splits, F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce(other_splits, F.lit(1)) - F.lit(1))
    return (df.join(hot, on, "left").withColumn(own, mine).withColumn(other, F.explode(every))
            .drop("_sl", "_sr"))


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
              hot_rows: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join on same-named columns ``on`` with hot keys split.

    ``hot`` (on..., _sl, _sr) may be given from statistics kept with the data;
    otherwise both sides are counted.  ``how`` is ``inner`` or ``left_semi``; a
    semi join only ever splits the left side, so no left row is emitted twice."""
    if how not in ("inner", "left_semi"):
        raise ValueError(f"skew_join supports inner and left_semi, not {how}")
    on, semi = list(on), how == "left_semi"
    if hot is None:
        hot = hot_keys(left, right, on, hot_rows or hot_rows_setting(left), semi)
    elif semi:
        hot = hot.withColumn("_sr", F.lit(1))
    ls = _dealt(left, hot, on, "_a", "_b", "_sl", "_sr")
    rs = _dealt(right, hot, on, "_b", "_a", "_sr", "_sl")
    return ls.join(rs, on + ["_a", "_b"], how).drop("_a", "_b")


def split_hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Inner equi-join that keeps the inputs' partitioning for ordinary keys:
    keys outside ``hot`` (on..., _sl, _sr) join on ``on`` alone, so inputs bucketed
    on it need no shuffle; hot keys take ``skew_join``."""
    on = list(on)
    keys = hot.select(*on)
    cold = left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on)
    hot_part = skew_join(left.join(keys, on, "left_semi"), right.join(keys, on, "left_semi"), on, hot=hot)
    return cold.unionByName(hot_part)
