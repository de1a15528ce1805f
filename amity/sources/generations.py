"""Several tables refreshed as one: a generation is a snapshot of every table.

A refresh writes the snapshots of all tables under the generation's key and only
then publishes a manifest that names them, as one new file. Readers open the
newest manifest, so they see all tables of one refresh or all of the one before:
a refresh that fails half-way changes nothing for them, and what it wrote is
removed by the next one.

Readers pin the generation they read (a file of their own). Retention retires a
manifest first, by a rename, and deletes a retired generation's folders only while
it has no pin. A reader pins, then looks again whether its manifest still stands,
and else starts over with the newest: so either the reader sees the retirement or
retention sees the pin. A pin older than ``PIN_HOURS`` belongs to a lost reader and
no longer counts."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.session import delete_path, hadoop_fs
from amity.sources.fills import create_once
from amity.sources.snapshots import SNAPSHOT_COL, retain_derived, snapshot_write

PIN_HOURS = 24
Build = Callable[["Generation"], DataFrame]


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = hadoop_fs(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _manifests(spark: SparkSession, root: str, suffix: str) -> list[int]:
    """Generations whose manifest is in state ``suffix``, newest first."""
    names = _names(spark, f"{root}/manifests")
    return sorted((int(n[:-len(suffix)]) for n in names if n.endswith(suffix) and n[:-len(suffix)].isdigit()), reverse=True)


def generations(spark: SparkSession, root: str) -> list[int]:
    """Published generations, newest first."""
    return _manifests(spark, root.rstrip("/"), ".json")


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()))


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with its whole text at once; False if another writer has claimed
    its name (a rename may replace a file on some file systems)."""
    if not create_once(spark, f"{path}.claim"):
        return False
    fs, draft = hadoop_fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(draft, hadoop_fs(spark, path)[1]))


class Generation:
    """The tables of one manifest."""

    def __init__(self, spark: SparkSession, root: str, key: int, tables: list[str]) -> None:
        self.spark, self.root, self.key, self.tables = spark, root, key, tables

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"generation {self.key} has no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{SNAPSHOT_COL}={self.key}")


def refresh_generation(spark: SparkSession, root: str, key: int, sources: Mapping[str, DataFrame],
                       built: Mapping[str, Build] | None = None, keep: int = 2,
                       derived: tuple[str, ...] = ()) -> int:
    """Write every table of ``sources``, then those ``built`` from the tables
    already written (in their order), publish them as generation ``key``, and
    retire all but the newest ``keep``. ``derived`` are per-caller tables
    (``materialize_derived``) whose rows of deleted generations go too."""
    root, done = root.rstrip("/"), generations(spark, root)
    if done and key <= done[0]:
        raise ValueError(f"generation {key} is not newer than {done[0]}")
    now = Generation(spark, root, key, [])
    for name, make in {**{n: (lambda _, df=df: df) for n, df in sources.items()}, **(built or {})}.items():
        snapshot_write(make(now), f"{root}/{name}", key)
        now.tables.append(name)
    text = json.dumps({"generation": key, "tables": now.tables})
    if not _write_new(spark, f"{root}/manifests/{key}.json", text):
        raise RuntimeError(f"generation {key} was published by another refresh")
    retire(spark, root, keep, derived)
    return key


def _pinned(spark: SparkSession, root: str, key: int) -> bool:
    fs, folder = hadoop_fs(spark, f"{root}/pins/{key}")
    oldest = (time.time() - PIN_HOURS * 3600) * 1000
    return fs.exists(folder) and any(st.getModificationTime() >= oldest for st in fs.listStatus(folder))


def retire(spark: SparkSession, root: str, keep: int = 2, derived: tuple[str, ...] = ()) -> list[int]:
    """Retire all but the newest ``keep`` (one at least) generations, delete the
    folders of retired ones that nobody reads and what failed refreshes left
    behind; returns the generations whose folders stay."""
    root = root.rstrip("/")
    published = generations(spark, root)
    fs = hadoop_fs(spark, root)[0]
    path = lambda k, suffix: hadoop_fs(spark, f"{root}/manifests/{k}{suffix}")[1]
    for k in published[max(keep, 1):]:
        fs.rename(path(k, ".json"), path(k, ".retired"))
    published = published[:max(keep, 1)]
    read = [k for k in _manifests(spark, root, ".retired") if _pinned(spark, root, k)]
    stay = published + read
    for name in _names(spark, root):
        if name in ("manifests", "pins"):
            continue
        for folder in _names(spark, f"{root}/{name}"):
            k = folder.removeprefix(f"{SNAPSHOT_COL}=")
            # a newer one may be a refresh at work
            if k.isdigit() and int(k) not in stay and published and int(k) < published[0]:
                delete_path(spark, f"{root}/{name}/{folder}")
    for k in _manifests(spark, root, ".retired"):
        if k not in stay:
            fs.delete(path(k, ".retired"), False)
            fs.delete(path(k, ".json.claim"), False)
            delete_path(spark, f"{root}/pins/{k}")
    for table in derived:
        retain_derived(spark, table, stay)
    return stay


@contextmanager
def open_generation(spark: SparkSession, root: str):
    """The newest generation, pinned as long as the block runs: read, or write
    out, what is needed of it inside."""
    root = root.rstrip("/")
    fs = hadoop_fs(spark, root)[0]
    while True:
        keys = generations(spark, root)
        if not keys:
            raise LookupError(f"no generation under {root}")
        pin = hadoop_fs(spark, f"{root}/pins/{keys[0]}/{uuid.uuid4().hex}")[1]
        fs.create(pin, True).close()
        manifest = f"{root}/manifests/{keys[0]}.json"
        if fs.exists(hadoop_fs(spark, manifest)[1]):
            break
        fs.delete(pin, False)     # retired in between
    try:
        yield Generation(spark, root, keys[0], _read(spark, manifest)["tables"])
    finally:
        fs.delete(pin, False)


def generation_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(table, generation, n_rows) of the published generations."""
    root = root.rstrip("/")
    out = None
    for k in generations(spark, root):
        for name in _read(spark, f"{root}/manifests/{k}.json")["tables"]:
            one = (Generation(spark, root, k, [name]).table(name).agg(F.count(F.lit(1)).alias("n_rows"))
                   .select(F.lit(name).alias("table"), F.lit(k).cast("bigint").alias("generation"), "n_rows"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise LookupError(f"no generation under {root}")
    return out
