"""Snapshot refresh as a Structured Streaming query.

The roster and contact tables are reloaded in full on a fixed interval.
Here a full export of a table is dropped (atomically, e.g. by renaming its
folder) as a sub-folder of ``export_dir``; a file-source stream picks up the new
files, and ``foreachBatch`` turns the newest export of each micro-batch into a
snapshot and keeps the newest ``keep``.  Exports are told apart by their folder,
never mixed, and one that was overtaken by a newer one is passed over.  The
snapshot key belongs to the folder (its modification time), so a batch that is
run again writes the same snapshot again.

Use ``trigger(processingTime=...)`` for the periodic service and
``availableNow`` for a one-off catch-up (and in tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amity.session import hadoop_fs
from amity.sources.snapshots import refresh


def snapshot_stream(spark: SparkSession, export_dir: str, schema: str, snapshot_root: str,
                    checkpoint_location: str, keep: int = 2, sort_by: tuple[str, ...] = (),
                    interval_minutes: float | None = None, available_now: bool = False,
                    after_refresh: Callable[[int], None] | None = None,
                    key_of: Callable[[str], int] | None = None) -> StreamingQuery:
    """Start the refresh stream; returns the running query.

    ``key_of(folder)`` gives an export's snapshot key; the newest export is the
    one with the largest. ``after_refresh(snapshot_ms)`` runs after each new snapshot (e.g. to
    rebuild derived per-caller tables for it)."""
    def modified(folder: str) -> int:
        fs, path = hadoop_fs(spark, folder)
        return fs.getFileStatus(path).getModificationTime()

    key_of = key_of or modified
    stream = (spark.readStream.schema(schema)
              .option("recursiveFileLookup", "true")  # one sub-folder per export
              .parquet(export_dir)
              .select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_export")))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        folders = [r[0] for r in batch.select("_export").distinct().collect()]  # one row an export
        if not folders:
            return
        ms, newest = max((key_of(f), f) for f in folders)
        refresh(spark, batch.where(F.col("_export") == newest).drop("_export"), snapshot_root, ms, keep=keep, sort_by=sort_by)
        if after_refresh is not None:
            after_refresh(ms)

    writer = (stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval_minutes is not None:
        writer = writer.trigger(processingTime=f"{interval_minutes} minutes")
    return writer.start()
