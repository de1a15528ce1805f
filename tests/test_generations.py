"""Refreshes of several tables as one, readers that pin what they read, and
derived tables filled by several jobs or by difference."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from amity.operators import common_friends as cf
from amity.operators import relations as rel
from amity.operators import roster as ro
from amity.session import delete_path, hadoop_fs, scratch_path
from amity.sources import fills
from amity.sources import generations as gens
from amity.sources import snapshots as sn


def tables(spark, k):
    return {"roster": spark.createDataFrame([(k, "a")], "gen int, x string"),
            "contacts": spark.createDataFrame([(k, "b"), (k, "c")], "gen int, x string")}


def refresh(spark, root, k, **more):
    return gens.refresh_generation(spark, root, k, tables(spark, k), **more)


def test_all_tables_of_one_refresh(spark):
    root = scratch_path(spark, "t-gen")
    with pytest.raises(LookupError):
        with gens.open_generation(spark, root):
            pass
    both = {"both": lambda now: now.table("roster").crossJoin(now.table("contacts").select(F.col("gen").alias("g2")))}
    for k in (100, 200, 300):
        refresh(spark, root, k, built=both)
    assert gens.generations(spark, root) == [300, 200]
    with gens.open_generation(spark, root) as now:
        assert {r["gen"] for n in ("roster", "contacts", "both") for r in now.table(n).collect()} == {300}
        with pytest.raises(LookupError):
            now.table("other")
    assert {tuple(r) for r in gens.generation_sizes(spark, root).collect()} == {
        (n, k, m) for k in (200, 300) for n, m in (("roster", 1), ("contacts", 2), ("both", 2))}
    with pytest.raises(ValueError):
        refresh(spark, root, 300)


def test_a_refresh_that_fails_half_way_changes_nothing(spark):
    root = scratch_path(spark, "t-gen-fail")
    refresh(spark, root, 100)

    def broken(now):
        assert now.table("roster").count() == 1      # written, but not published
        raise RuntimeError("no more rows")

    with pytest.raises(RuntimeError):
        refresh(spark, root, 200, built={"last": broken})
    bad = tables(spark, 210)
    bad["contacts"] = bad["contacts"].withColumn("x", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        gens.refresh_generation(spark, root, 210, bad)
    assert gens.generations(spark, root) == [100]
    with gens.open_generation(spark, root) as now:
        assert {r["gen"] for n in ("roster", "contacts") for r in now.table(n).collect()} == {100}
    refresh(spark, root, 300)
    fs = hadoop_fs(spark, root)[0]
    assert not fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=200")[1])
    assert not fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=210")[1])
    assert gens.generations(spark, root) == [300, 100]


def test_a_reader_across_retentions(spark, monkeypatch):
    root = scratch_path(spark, "t-gen-read")
    refresh(spark, root, 100, keep=1)
    with gens.open_generation(spark, root) as now:
        for k in (200, 300, 400):
            refresh(spark, root, k, keep=1)
        assert gens.generations(spark, root) == [400]
        assert {r["gen"] for n in ("roster", "contacts") for r in now.table(n).collect()} == {100}   # still there
        fs = hadoop_fs(spark, root)[0]
        assert not fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=200")[1])                   # nobody read it
    gens.retire(spark, root, keep=1)
    assert not fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=100")[1])
    # the pin of a reader that is lost counts no more after its time
    lost = gens.open_generation(spark, root)
    lost.__enter__()
    refresh(spark, root, 500, keep=1)
    assert fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=400")[1])
    monkeypatch.setattr(gens, "PIN_HOURS", -1)
    gens.retire(spark, root, keep=1)
    assert not fs.exists(hadoop_fs(spark, f"{root}/roster/snapshot_ms=400")[1])


def test_a_generation_retired_between_listing_and_pin(spark, monkeypatch):
    root = scratch_path(spark, "t-gen-race")
    refresh(spark, root, 100, keep=1)
    listed, real = [], gens.generations

    def late(spark_, root_):
        found = real(spark_, root_)
        if not listed:
            listed.append(found)
            refresh(spark, root, 200, keep=1)        # retires what was just listed
        return found

    monkeypatch.setattr(gens, "generations", late)
    with gens.open_generation(spark, root) as now:
        assert now.key == 200 and now.table("roster").count() == 1


# ------------------------------------------------------------ fills

def some_roster(spark, pairs):
    return spark.createDataFrame([(k, f"u{a}", f"u{b}", b) for k, (a, b) in enumerate(sorted(pairs))],
                                 "rosterID bigint, username string, loginAccount string, userID bigint")


def test_two_fills_at_once_build_every_caller_once(spark):
    root = scratch_path(spark, "t-fill")
    callers = spark.createDataFrame([(f"c{i}",) for i in range(60)], "caller string")
    built, batches, start = [], [], threading.Barrier(2)

    def build(todo):
        built.append({r["caller"] for r in todo.collect()})
        return todo.withColumn("n", F.length("caller"))

    def job(frame):
        start.wait()
        batches.append(fills.fill_missing(spark, root, 5, frame, build, wait=lambda s: threading.Event().wait(0.05)))

    jobs = [threading.Thread(target=job, args=(f,)) for f in (callers, callers.where("caller < 'c4'"))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert len(batches) == 2 and sum(len(b) for b in built) == 60 and len(set().union(*built)) == 60
    assert spark.read.parquet(root).count() == 60
    assert fills.fill_missing(spark, root, 5, callers, build) == 0


def test_a_claim_left_behind_is_taken_over(spark, monkeypatch):
    root = scratch_path(spark, "t-fill-stale")
    callers = spark.createDataFrame([("a",), (None,), ("a",)], "caller string")
    for g in range(fills.CLAIMS):
        assert fills.create_once(spark, f"{root}-claims/snapshot_ms=5/{g}")
        assert not fills.create_once(spark, f"{root}-claims/snapshot_ms=5/{g}")
    waited = []

    def wait(_):
        waited.append(1)
        monkeypatch.setattr(fills, "CLAIM_HOURS", -1)

    assert fills.fill_missing(spark, root, 5, callers, lambda t: t.withColumn("n", F.lit(1)), wait=wait) == 1
    assert waited and sn.derived_for(spark, root, 5, "a").count() == 1


def test_a_failed_build_gives_its_claims_back(spark):
    root = scratch_path(spark, "t-fill-fail")
    callers = spark.createDataFrame([("a",), ("b",)], "caller string")

    def broken(todo):
        raise RuntimeError("no rows")

    with pytest.raises(RuntimeError):
        fills.fill_missing(spark, root, 5, callers, broken)
    assert fills.fill_missing(spark, root, 5, callers, lambda t: t.withColumn("n", F.lit(1))) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_carry_over_equals_a_full_rebuild(spark, seed):
    rng = random.Random(seed)
    pair = lambda: (rng.randrange(14), rng.randrange(14))
    old = {pair() for _ in range(26)}
    new = (old - set(rng.sample(sorted(old), 2))) | {pair()}
    before, after = some_roster(spark, old), some_roster(spark, new)
    g_old, g_new = ro.FriendGraph.of(before), ro.FriendGraph.of(after)
    owners = spark.createDataFrame([(f"u{i}",) for i in range(14)], "caller string")
    for hops, build in ((1, rel.relation_table_many), (2, cf.common_friend_table)):
        root, again = scratch_path(spark, f"t-carry-{hops}"), []
        fills.fill_missing(spark, root, 1, owners, lambda todo, b=build: b(g_old, todo))

        def rebuild(todo, b=build):
            again.extend(r["caller"] for r in todo.collect())
            return b(g_new, todo)

        fills.carry_over(spark, root, 1, 2, fills.affected_callers(before, after, hops), rebuild)
        got = sorted(map(tuple, sn.derived_for(spark, root, 2, owners).drop("snapshot_ms").collect()))
        assert got == sorted(map(tuple, build(g_new, owners).select(
            *[c for c in sn.derived_for(spark, root, 2, owners).drop("snapshot_ms").columns]).collect()))
        assert sn.done_callers(spark, root, 2).count() == 14 and len(again) < 14
        assert delete_path(spark, root)
