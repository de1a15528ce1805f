"""Filling derived per-caller tables: by several jobs at once, and by difference.

``fill_missing`` adds the callers a table does not answer for yet. Callers are dealt
into ``CLAIMS`` groups by their hash; a job builds the callers of a group only while
it holds the group's claim, a file that can be created once. It looks again what
is missing after it got the claim, so no two jobs build the same caller; a group
that another job holds is waited for. A claim older than ``CLAIM_HOURS`` is
taken over (readers take one batch of each caller, so even a job that comes back
does no harm).

``carry_over`` brings a table from one snapshot of the edges to the next: only callers
whose rows can have changed are built again."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.session import hadoop_fs, staged
from amity.sources.snapshots import (SNAPSHOT_COL, derived_for, done_callers, materialize_derived, missing_callers)

CLAIMS = 16
CLAIM_HOURS = 6
WAIT_SECONDS = 1.0
Build = Callable[[DataFrame], DataFrame]


def create_once(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it is there. One of several callers gets
    True: file systems that Spark clusters share create exclusively, and a local
    one is asked to."""
    fs, p = hadoop_fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        try:
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(p, False).close()
        return True
    except Exception:
        if fs.exists(p):
            return False
        raise


def _claim(spark: SparkSession, path: str) -> bool:
    if create_once(spark, path):
        return True
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).getModificationTime() < (time.time() - CLAIM_HOURS * 3600) * 1000:
        gone = hadoop_fs(spark, f"{path}.{uuid.uuid4().hex}.old")[1]
        if fs.rename(p, gone):     # one of those who try
            fs.delete(gone, False)
            return create_once(spark, path)
    return False


def _group() -> Column:
    return F.pmod(F.xxhash64("caller"), F.lit(CLAIMS)).cast("int")


def fill_missing(spark: SparkSession, root: str, snapshot_ms: int, callers: DataFrame, build: Build,
                 wait: Callable[[float], None] = time.sleep, together: bool = False) -> int:
    """Adds to the derived table ``root`` the callers (column ``caller``) it does not
    answer for at ``snapshot_ms``; returns in how many batches. ``build`` makes the
    rows of the callers it is given; ``together``: each caller's in one partition."""
    folder, batches = f"{root.rstrip('/')}-claims/{SNAPSHOT_COL}={int(snapshot_ms)}", 0
    asked = staged(callers.select("caller").where(F.col("caller").isNotNull()).distinct(), "fill-callers")
    while True:
        missing = missing_callers(spark, root, snapshot_ms, asked).withColumn("_group", _group())
        groups = sorted(r[0] for r in missing.select("_group").distinct().collect())    # CLAIMS at most
        if not groups:
            return batches
        mine = [g for g in groups if _claim(spark, f"{folder}/{g}")]
        try:
            if mine:    # what is missing now that nobody else can add to these groups
                todo = staged(missing_callers(spark, root, snapshot_ms, asked).where(_group().isin(mine)), "fill-todo")
                if not todo.isEmpty():
                    materialize_derived(build(todo), root, snapshot_ms, callers=todo, together=together)
                    batches += 1
        finally:
            for g in mine:
                fs, p = hadoop_fs(spark, f"{folder}/{g}")
                fs.delete(p, False)
        if not mine:
            wait(WAIT_SECONDS)


def changed_owners(old: DataFrame, new: DataFrame) -> DataFrame:
    """(caller): owners of the roster rows (username, loginAccount, userID) that only
    one of two rosters has."""
    cols = ["username", "loginAccount", "userID"]
    both = (old.select(*cols).distinct().withColumn("_in", F.lit(1))
            .unionByName(new.select(*cols).distinct().withColumn("_in", F.lit(2))))
    return (both.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
            .select(F.col("username").alias("caller")).where(F.col("caller").isNotNull()).distinct())


def affected_callers(old: DataFrame, new: DataFrame, hops: int) -> DataFrame:
    """(caller): the owners of changed rows and everyone who reaches one of them over
    at most ``hops`` rows of the new roster. (Who reached one in the old roster
    only owns a changed row, or reaches an owner of one in fewer steps.)

    A caller's relation table depends on the rows of its friends: 1 hop. Its
    common-friend table also depends on the friends of everyone in its two hops: 2."""
    found = staged(changed_owners(old, new), "changed")
    edges = new.select(F.col("username").alias("caller"), F.col("loginAccount").alias("_to")).distinct()
    for _ in range(hops):
        to = found.select(F.col("caller").alias("_to"))
        found = staged(found.unionByName(edges.join(to, "_to", "left_semi").select("caller")).distinct(), "affected")
    return found


def carry_over(spark: SparkSession, root: str, old_ms: int, new_ms: int, affected: DataFrame, build: Build,
               together: bool = False) -> None:
    """The derived table ``root`` at ``new_ms`` for the callers it answers for at
    ``old_ms``: the rows of those not ``affected`` are copied as they lie in its files,
    the others built (``together`` as in ``fill_missing``)."""
    done = done_callers(spark, root, old_ms)
    if done is None:
        return
    again = staged(done.join(affected, "caller", "left_semi"), "carry-again")
    same = done.join(affected, "caller", "left_anti")
    rows = derived_for(spark, root, old_ms, same).drop(SNAPSHOT_COL)
    materialize_derived(rows, root, new_ms, callers=same, together=True)
    materialize_derived(build(again), root, new_ms, callers=again, together=together)
