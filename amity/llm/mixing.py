"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by their
membership pattern (the set of their sources); a pattern can give its words up
to ``max_repeats`` times, each repetition dearer than the one before. The flow
routes pattern capacity to the sources' quotas at least cost, so no document
is repeated while another of use is still unread. Then each pattern selects
documents: all of them for every whole repetition the flow takes, and a seeded
selection for the remaining part.

The selection needs no order over all documents. A document has a seeded place
in [0, 1); places fall into buckets (about the square root of the number of
documents, at least one for 500), bucket totals are summed up, everything in
the buckets before the remainder runs out is taken, and the one bucket in which
it does is walked through in seeded order, taking what still fits.

What reaches the driver: one row for each source and each membership pattern,
both checked against ``MAX_PATTERNS``.

Defined cases: a null text has size 0 like an empty one, and nothing of it is
taken; a null source is a source of its own, last in order; equal rows are
documents each and share a place; an empty table gives an empty result; other
columns are carried through untouched."""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from amity.llm.common import documents, text_key, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 2024
#: Patterns the driver plans with, and of these such that share sources with each
#: other, directly or through others: those go through one flow, whose time grows
#: with about the 1.75th power of their number (600: 1.5 s). More is an error, not a cut.
MAX_PATTERNS, MAX_LINKED = 100_000, 5_000


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: int,
            max_repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of ``total`` by weight; no target above ``max_repeats`` times its
    source's size, the excess reshared by weight among the others until none
    is above."""
    out: dict[str | None, float] = {}
    open_, rest = dict(weights), float(total)
    while open_:
        unit = rest / sum(open_.values())
        above = [s for s, w in open_.items() if w * unit > max_repeats * sizes[s]]
        if not above:
            return out | {s: w * unit for s, w in open_.items()}
        for s in above:
            out[s] = float(max_repeats * sizes[s])
            rest -= out[s]
            del open_[s]
    return out


def cycle_weights(sources: Sequence[str | None], weights: Sequence[float] = WEIGHTS) -> dict[str | None, float]:
    """Weights by order: code points, null last; the weights repeat."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def min_cost_flow(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[float],
                  max_repeats: int = MAX_REPEATS) -> list[list[float]]:
    """Words each pattern gives each of its sources (in the order of ``member``).

    Successive shortest paths with potentials on pattern -> source. A pattern's
    k-th repetition costs k a word, which is convex, so the cheapest open unit
    of a pattern is its next one and path costs never need more than the level
    a pattern has reached."""
    n, m = len(capacity), len(quota)
    flow = [[0.0] * len(s) for s in member]
    given, got = [0.0] * n, [0.0] * m
    eps = 1e-6
    level = lambda p: int((given[p] + eps) // capacity[p]) if capacity[p] else max_repeats
    holders: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for p, sources in enumerate(member):
        for k, s in enumerate(sources):
            holders[s].append((p, k))
    while True:
        # cheapest way from any pattern with a unit left to a source with a quota left; a path
        # may take words back from one source of a pattern and give them to another of its sources
        dist = [math.inf] * m
        via: list[tuple[int, int, int] | None] = [None] * m  # (pattern, index given, source taken from or -1)
        heap = []
        for p in range(n):
            if level(p) < max_repeats:
                for k, s in enumerate(member[p]):
                    if level(p) < dist[s]:
                        dist[s], via[s] = level(p), (p, k, -1)
        heap = [(d, s) for s, d in enumerate(dist) if d < math.inf]
        heapq.heapify(heap)
        while heap:
            d, s = heapq.heappop(heap)
            if d > dist[s]:
                continue
            for p, k in holders[s]:
                if flow[p][k] > eps:
                    for j, t in enumerate(member[p]):
                        if d < dist[t]:
                            dist[t], via[t] = d, (p, j, s)
                            heapq.heappush(heap, (d, t))
        ends = [(dist[s], s) for s in range(m) if quota[s] - got[s] > eps and dist[s] < math.inf]
        if not ends:
            return flow
        _, end = min(ends)
        path, s, amount = [], end, quota[end] - got[end]
        while True:
            p, k, back = via[s]
            path.append((p, k, back))
            if back < 0:
                amount = min(amount, (level(p) + 1) * capacity[p] - given[p])
                given[p] += amount
                break
            amount = min(amount, flow[p][member[p].index(back)])
            s = back
        for p, k, back in path:
            flow[p][k] += amount
            if back >= 0:
                flow[p][member[p].index(back)] -= amount
        got[end] += amount


def linked(member: Sequence[Sequence[int]]) -> list[list[int]]:
    """Patterns in groups that share sources, directly or through others."""
    group: dict[int, int] = {}

    def top(s: int) -> int:
        while group.setdefault(s, s) != s:
            group[s] = s = group[group[s]]
        return s

    for sources in member:
        for s in sources:
            group[top(s)] = top(sources[0])
    out: dict[int, list[int]] = {}
    for p, sources in enumerate(member):
        out.setdefault(top(sources[0]), []).append(p)
    return list(out.values())


def routed(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[float],
           max_repeats: int = MAX_REPEATS) -> list[list[float]]:
    """``min_cost_flow``, for each group of linked patterns by itself."""
    flow: list[list[float]] = [[] for _ in capacity]
    for patterns in linked(member):
        if len(patterns) > MAX_LINKED:
            raise ValueError(f"more than {MAX_LINKED} membership patterns share sources")
        index = {s: i for i, s in enumerate(dict.fromkeys(s for p in patterns for s in member[p]))}
        found = min_cost_flow([capacity[p] for p in patterns], [[index[s] for s in member[p]] for p in patterns],
                              [quota[s] for s in index], max_repeats)
        for p, f in zip(patterns, found):
            flow[p] = f
    return flow


def sized(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, tkey, size, pattern, place) per row; the pattern is the JSON
    list of the row's different sources."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), b.column("pattern"),
                                              pa.array(size, pa.int64())], ["doc_id", "tkey", "pattern", "size"])

    of = F.col(source)
    if not isinstance(docs.schema[source].dataType, ArrayType):
        of = F.array(of.cast("string"))
    of = F.when(F.size(of) > 0, F.array_sort(F.array_distinct(of))).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.select("doc_id", text_key().alias("tkey"), F.to_json(F.struct(of.alias("s"))).alias("pattern"),
                       F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(count, f"doc_id {kind}, tkey long, pattern string, size long")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "tkey"), 11) / float(1 << 53)
    return rows.withColumn("place", place)


def _walk(left: float, sizes: Sequence[int]) -> list[bool]:
    """In the given order, take what still fits; one more if that comes nearer."""
    taken = []
    for s in sizes:
        taken.append(0 < s <= left)
        left -= s if taken[-1] else 0
    rest = [(s, i) for i, s in enumerate(sizes) if not taken[i] and s > 0]
    if rest and min(rest)[0] - left < left:
        taken[min(rest)[1]] = True
    return taken


def mix(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS,
        max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, dict, dict, dict]:
    """(rows, sources of each pattern, size and target of each source).
    ``rows``: doc_id, tkey, size, pattern, copies (how often the mix takes the
    whole document) per row of ``docs``."""
    spark = docs.sparkSession
    rows = written(sized(docs, source), "mixing-sizes")
    per = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = sorted(per.limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    member = [json.loads(r["pattern"])["s"] for r in found]
    sizes: dict[str | None, int] = {}
    for r, names in zip(found, member):
        for s in names:
            sizes[s] = sizes.get(s, 0) + r["size"]
    total = sum(r["size"] for r in found)
    quota = targets(sizes, cycle_weights(list(sizes), weights), total, max_repeats)
    index = {s: i for i, s in enumerate(sizes)}
    flow = routed([r["size"] for r in found], [[index[s] for s in names] for names in member],
                  [quota[s] for s in index], max_repeats)

    plan = []
    for r, f in zip(found, flow):
        words = min(sum(f), max_repeats * r["size"])
        whole = int((words + 1e-3) // r["size"]) if r["size"] else 0
        buckets = max(1, min(math.ceil(r["n"] / 500), math.ceil(math.sqrt(r["n"]))))
        plan.append((r["pattern"], whole, max(0.0, words - whole * r["size"]), buckets))
    plan_df = spark.createDataFrame(plan, "pattern string, whole long, part double, buckets long")  # a row a pattern
    dealt = rows.join(F.broadcast(plan_df), "pattern").withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (dealt.groupBy("pattern", "bucket", "part").agg(F.sum("size").alias("size"))
           .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
           .where("part > 0 and before <= part and before + size > part")
           .select("pattern", F.col("bucket").alias("cut"), F.col("before").cast("double").alias("before")))
    cuts = [tuple(r) for r in cut.collect()]  # at most one a pattern
    cut_df = spark.createDataFrame(cuts, "pattern string, cut long, before double")
    dealt = dealt.join(F.broadcast(cut_df), "pattern", "left")
    out = ["doc_id", "tkey", "size", "pattern"]
    taken = (F.col("size") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))
    clear = dealt.where("cut is null or bucket <> cut").select(*out, (F.col("whole") + taken.cast("long")).alias("copies"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id", "tkey"], kind="stable")
        more = _walk(group["part"].iloc[0] - group["before"].iloc[0], group["size"].tolist())
        return group.assign(copies=group["whole"] + pd.Series(more, index=group.index).astype("int64"))[[*out, "copies"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    edge = dealt.where("bucket = cut").groupBy("pattern").applyInPandas(
        walk, f"doc_id {kind}, tkey long, size long, pattern string, copies long")
    return clear.union(edge), {r["pattern"]: names for r, names in zip(found, member)}, sizes, quota


def mixed_documents(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS,
                    max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken."""
    rows, _, _, _ = mix(docs, source, weights, max_repeats)
    times = rows.groupBy(F.col("doc_id").alias("mid"), F.col("tkey").alias("mkey")).agg(F.sum("copies").alias("copies"))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", text_key().alias("tkey"))
    same = F.col("doc_id").eqNullSafe(F.col("mid")) & (F.col("tkey") == F.col("mkey"))
    one = packed.join(times.where("copies > 0"), same).dropDuplicates(["doc_id", "tkey"])
    return one.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, member, sizes, quota = mix(documents(spark, sf_dir))
    per = [(p, sizes[s], quota[s]) for p, (s,) in member.items()]  # a row a source
    table = spark.createDataFrame(per, "pattern string, source_size long, target double")
    return rows.join(F.broadcast(table), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
