"""The refresh stream turns each new export into a snapshot and keeps two."""

from amity.session import scratch_path
from amity.sources import snapshots as sn
from amity.streaming.refresh import snapshot_stream

SCHEMA = "rosterID bigint, username string, loginAccount string, userID bigint"


def test_refresh_stream(spark):
    export = scratch_path(spark, "t-export")
    root = scratch_path(spark, "t-stream-snap")
    ckpt = scratch_path(spark, "t-stream-ckpt")
    key_of = lambda folder: 1000 * (int(folder.rsplit("-", 1)[1]) + 1)
    seen = []
    for gen in range(3):
        rows = [(gen * 10 + i, f"u{i}", f"f{gen}", i) for i in range(3)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{export}/export-{gen}")
        q = snapshot_stream(spark, export, SCHEMA, root, ckpt, keep=2, available_now=True,
                            after_refresh=seen.append, key_of=key_of)
        q.awaitTermination(120)
    assert seen == [1000, 2000, 3000]
    assert sn.snapshot_keys(spark, root) == [3000, 2000]
    latest = sn.latest_snapshot(spark, root)
    assert sorted(r["loginAccount"] for r in latest.collect()) == ["f2"] * 3


def test_two_waiting_exports_stay_apart(spark):
    export, root, ckpt = (scratch_path(spark, n) for n in ("t-export2", "t-snap2", "t-ckpt2"))
    for gen, names in enumerate((["old", "kept"], ["kept"])):
        spark.createDataFrame([(i, "u", n, i) for i, n in enumerate(names)], SCHEMA).write.parquet(f"{export}/export-{gen}")
    snapshot_stream(spark, export, SCHEMA, root, ckpt, available_now=True,
                    key_of=lambda f: int(f.rsplit("-", 1)[1]) + 1).awaitTermination(120)
    assert sn.snapshot_keys(spark, root) == [2]
    assert [r["loginAccount"] for r in sn.latest_snapshot(spark, root).collect()] == ["kept"]
