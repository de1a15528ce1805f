"""Versioned snapshots of the loaded tables.

The loaded roster and contact tables are written as parquet partitions
``snapshot_ms=<epoch ms>`` under a root in shared storage.  A marker is put
into the folder once the write has succeeded; readers pick the newest marked
partition (partition pruning keeps the scan to that folder), so a failed or
running write is never read.  Refresh writes first and only then drops all but
the newest ``keep``.  Derived per-caller tables carry the snapshot key, so a
refresh can never mix generations; callers are added in batches, and a batch
counts once its callers are recorded as done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.session import delete_path, hadoop_fs

SNAPSHOT_COL = "snapshot_ms"
BATCH_COL = "batch"
COMPLETE = "_COMPLETE"  # readers of parquet skip names that start with _


def snapshot_write(df: DataFrame, root: str, snapshot_ms: int,
                   sort_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` as the partition ``snapshot_ms`` of ``root``; an existing
    partition with the same key is replaced, others are left alone.

    ``sort_by`` clusters rows inside each file so that equality lookups on
    those columns skip row groups."""
    out = df.withColumn(SNAPSHOT_COL, F.lit(int(snapshot_ms)).cast("bigint"))
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    (out.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(SNAPSHOT_COL)
     .parquet(root))
    mark_complete(df.sparkSession, root, snapshot_ms)
    return root


def mark_complete(spark: SparkSession, root: str, snapshot_ms: int) -> None:
    """Readers see the snapshot from here on."""
    fs, marker = hadoop_fs(spark, f"{root.rstrip('/')}/{SNAPSHOT_COL}={int(snapshot_ms)}/{COMPLETE}")
    fs.create(marker, True).close()


def snapshot_keys(spark: SparkSession, root: str) -> list[int]:
    """Keys of the complete snapshots under ``root``, newest first (folder
    listings only)."""
    fs, _ = hadoop_fs(spark, root)
    return [k for k in _folder_keys(spark, root)
            if fs.exists(hadoop_fs(spark, f"{root.rstrip('/')}/{SNAPSHOT_COL}={k}/{COMPLETE}")[1])]


def _folder_keys(spark: SparkSession, root: str) -> list[int]:
    fs, p = hadoop_fs(spark, root)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted((int(n.split("=", 1)[1]) for n in names if n.startswith(SNAPSHOT_COL + "=")), reverse=True)


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest snapshot; the key filter prunes every other folder."""
    keys = snapshot_keys(spark, root)
    if not keys:
        raise LookupError(f"no snapshot under {root}")
    return spark.read.parquet(root).where(F.col(SNAPSHOT_COL) == F.lit(keys[0]))


def snapshot_list(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_ms, generation) with generation 1 for the newest, ranked with
    ``dense_rank`` over the distinct keys (a handful of rows)."""
    from pyspark.sql import Window
    keys = [(k,) for k in snapshot_keys(spark, root)]
    df = spark.createDataFrame(keys, f"{SNAPSHOT_COL} bigint")
    return df.withColumn("generation", F.dense_rank().over(Window.orderBy(F.desc(SNAPSHOT_COL))))


def retain_snapshots(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all but the newest ``keep`` complete snapshots, and incomplete ones
    older than the newest of them (a write may still fill a newer one); returns
    the kept keys."""
    if keep < 0:
        raise ValueError("keep must be >= 0")
    done = snapshot_keys(spark, root)
    for k in _folder_keys(spark, root):
        if k in done[keep:] or (k not in done and done and k < done[0]):
            delete_path(spark, f"{root.rstrip('/')}/{SNAPSHOT_COL}={k}")
    return done[:keep]


def refresh(spark: SparkSession, source: DataFrame, root: str, snapshot_ms: int,
            keep: int = 2, sort_by: tuple[str, ...] = (), derived: tuple[str, ...] = ()) -> DataFrame:
    """Full refresh: write the new snapshot, then drop all but the newest
    ``keep`` (one at least) and the rows of ``derived`` tables that belong to
    dropped ones; returns the newest snapshot's rows. A write that fails leaves
    everything as it was."""
    snapshot_write(source, root, snapshot_ms, sort_by)
    kept = retain_snapshots(spark, root, max(keep, 1))
    for table in derived:
        retain_derived(spark, table, kept)
    return latest_snapshot(spark, root)


def _done_root(root: str) -> str:
    return f"{root.rstrip('/')}-callers"


def materialize_derived(df: DataFrame, root: str, snapshot_ms: int,
                        key: str = "caller", callers: DataFrame | None = None, together: bool = False) -> str:
    """Add a batch of callers to a derived per-caller table (common friends,
    relations) of one roster snapshot; what is there stays. Rows are clustered
    by caller inside files, so a caller's rows are a few row groups.

    ``callers`` (column ``key``) are those the batch answers for; they count as
    present even without a row. By default those that have rows. They are
    recorded after the rows, so a batch that failed in between is not read.

    ``together``: the rows of a caller already lie in one partition, or in a few;
    they are sorted there and not shuffled once more."""
    batch = "b" + uuid.uuid4().hex
    # each batch has folders of its own: jobs that write to one folder at a time
    # would clear away each other's unfinished files
    folder = f"{SNAPSHOT_COL}={int(snapshot_ms)}/{BATCH_COL}={batch}"
    (df if together else df.repartition(key)).sortWithinPartitions(key).write.parquet(f"{root.rstrip('/')}/{folder}")
    done = (df if callers is None else callers).select(key).distinct()
    done.write.parquet(f"{_done_root(root)}/{folder}")
    return root


def _done(spark: SparkSession, root: str, snapshot_ms: int) -> DataFrame | None:
    """(caller, batch) of the callers of a snapshot, the first batch of each."""
    if int(snapshot_ms) not in _folder_keys(spark, _done_root(root)):
        return None
    done = spark.read.parquet(_done_root(root)).where(F.col(SNAPSHOT_COL) == F.lit(int(snapshot_ms)))
    return done.groupBy("caller").agg(F.min(BATCH_COL).alias(BATCH_COL))


def done_callers(spark: SparkSession, root: str, snapshot_ms: int) -> DataFrame | None:
    """(caller): whom a derived table answers for at a snapshot; None for nobody."""
    done = _done(spark, root, snapshot_ms)
    return None if done is None else done.select("caller")


def derived_for(spark: SparkSession, root: str, snapshot_ms: int, callers) -> DataFrame:
    """Rows of a derived table for one snapshot and the given callers (a name or
    a frame with ``caller``). Of a caller added twice one batch is read."""
    df = spark.read.parquet(root).where(F.col(SNAPSHOT_COL) == F.lit(int(snapshot_ms)))
    done = _done(spark, root, snapshot_ms)
    if done is None:
        return df.where(F.lit(False)).drop(BATCH_COL)
    if isinstance(callers, str):
        df, done = df.where(F.col("caller") == F.lit(callers)), done.where(F.col("caller") == F.lit(callers))
    else:
        done = done.join(callers.select("caller").distinct(), "caller", "left_semi")
    return df.join(done, ["caller", BATCH_COL], "left_semi").drop(BATCH_COL)


def missing_callers(spark: SparkSession, root: str, snapshot_ms: int, callers: DataFrame) -> DataFrame:
    """Callers that a derived table of that snapshot does not answer for yet."""
    asked, done = callers.select("caller").distinct(), _done(spark, root, snapshot_ms)
    return asked if done is None else asked.join(done, "caller", "left_anti")


def retain_derived(spark: SparkSession, root: str, keys: list[int]) -> None:
    """Drop the rows of a derived table that belong to other snapshots."""
    for where in (_done_root(root), root):  # a batch without its record is not read
        for k in _folder_keys(spark, where):
            if k not in keys:
                delete_path(spark, f"{where.rstrip('/')}/{SNAPSHOT_COL}={k}")
