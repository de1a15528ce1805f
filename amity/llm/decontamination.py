"""Benchmark decontamination with training suffix arrays.

The documents are cut into shards of about ``SHARD_WORDS`` words (whole texts;
one text may be a shard of its own). A task builds the suffix array of each of
its shards over word numbers and binary-searches every suffix of every test item
in it: the interval of the array that agrees with the suffix for as many words
as possible is the longest verbatim match, its entries are the locations. A
window is ``WINDOW`` consecutive words of an item (the whole item if shorter); a
document that holds one is affected and is removed by ``decontaminate``.

Word numbers are those of the test words; every other word of a document ends a
run, as no test suffix can match across it, so the array holds the suffixes that
start in a run and compares them within their runs only. Sorting starts from the
packed first words of a suffix and doubles the depth for those still equal.

The test items are the broadcast side. They are dealt into blocks of about
``BLOCK_CHARS`` characters by a hash of the item; each block is one pass over the
documents, and the passes are put together by document. Only a block is ever in a
task or on the driver. One pass needs no shuffle at all.

Defined cases: a null or word-less document has no words and is kept; an item
without a word has no window; an item whose id is null marks words and documents
but is not named; items that share an id are one item in lists and counts; equal
rows have the same result each; empty tables give empty (no documents) or clean
(no items) results; other columns are carried through."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, text_key, written
from amity.llm.terms import TERM_PATTERN, terms

#: Consecutive words of an item that count as a leak.
WINDOW = 10
#: Words of one suffix array, but for a longer text.
SHARD_WORDS = 1_000_000
#: Characters of test items in one pass.
BLOCK_CHARS = 4_000_000

Item = tuple[str | None, str | None]


class TestSuffixes:
    """The suffixes of a block of test items that can hold a window."""

    def __init__(self, items: list[Item], window: int) -> None:
        texts = [(name, [w for part in terms(text.encode() if text else None) for w in part]) for name, text in items]
        texts = [(name, words) for name, words in texts if words]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, words in texts for w in words}))}
        self.names = [name for name, _ in texts]
        seqs = [np.array([self.number[w] for w in words], np.int64) for _, words in texts]
        need = [min(window, len(s)) for s in seqs]
        self.item = np.array([i for i, s in enumerate(seqs) for _ in range(len(s) - need[i] + 1)], np.int64)
        self.at = np.array([a for i, s in enumerate(seqs) for a in range(len(s) - need[i] + 1)], np.int64)
        self.need = np.array(need, np.int64)[self.item] if seqs else np.zeros(0, np.int64)
        ends = np.cumsum([0] + [len(s) + 1 for s in seqs])[:-1]
        self.flat = np.concatenate([np.append(s, 0) for s in seqs] or [np.zeros(0, np.int64)])
        self.start = (ends[self.item] if seqs else self.item) + self.at
        self.length = (np.array([len(s) for s in seqs], np.int64)[self.item] if seqs else self.item) - self.at


class SuffixArray:
    """Suffix array over word numbers; 0 ends a run. ``order`` holds the places
    of all suffixes that start in a run, sorted by their words up to the end of
    the run, or by their first ``limit`` words. ``new`` marks where a suffix differs
    from the one before it, ``left`` are its words up to the end of its run."""

    def __init__(self, ids: np.ndarray, words: int, limit: int | None = None) -> None:
        bits = max(int(words).bit_length(), 1)
        self.bits, self.packed = bits, min(max(62 // bits, 1), limit or 62)
        self.ids = np.concatenate([ids, np.zeros(self.packed + 1, ids.dtype)])
        places = np.flatnonzero(ids)
        stops = np.flatnonzero(self.ids == 0)
        left = stops[np.searchsorted(stops, places)] - places   # words up to the end of the run
        key = np.zeros(len(places), np.int64)
        for j in range(self.packed):
            key = (key << bits) | np.where(j < left, self.ids[np.minimum(places + j, len(ids))], 0)
        by = np.argsort(key, kind="stable")
        self.order, self.key, self.left = places[by], key[by], left[by]
        self.new = np.ones(len(self.order), bool)
        self.new[1:] = self.key[1:] != self.key[:-1]
        self._refine(limit)

    def _refine(self, limit: int | None) -> None:
        n, depth, new, left = len(self.order), self.packed, self.new, self.left
        rank = np.zeros(len(self.ids), np.int64)                 # 0 outside of runs
        while n and (limit is None or depth < limit):
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[self.order] = first + 1
            alone = new & np.append(new[1:], True)
            open_ = np.flatnonzero(~alone & (left >= depth))     # still equal, and not yet at their end
            if not len(open_):
                return
            step = depth if limit is None else min(depth, limit - depth)
            places = self.order[open_]
            then = np.where(left[open_] > step, rank[np.minimum(places + step, len(rank) - 1)], 0)
            by = np.lexsort((then, first[open_]))
            self.order[open_], left[open_], then = places[by], left[open_][by], then[by]
            new[open_[1:]] |= (first[open_][1:] == first[open_][:-1]) & (then[1:] != then[:-1])
            depth += step

    def search(self, test: TestSuffixes) -> tuple[np.ndarray, ...]:
        """For every test suffix that occurs with at least its window: its number,
        the interval at the window's depth, the interval of its longest match
        and the words of that match."""
        short = np.minimum(test.need, self.packed)
        low = np.zeros(len(test.start), np.int64)
        for j in range(self.packed):
            at = np.minimum(test.start + j, max(len(test.flat) - 1, 0))
            low = (low << self.bits) | (np.where(j < short, test.flat[at], 0) if len(test.flat) else 0)
        high = low + (np.int64(1) << (self.bits * (self.packed - short))) - 1
        lo, hi = np.searchsorted(self.key, low, "left"), np.searchsorted(self.key, high, "right")
        found = np.flatnonzero(hi > lo)
        lo, hi, depth = lo[found], hi[found], short[found].copy()
        wlo, whi = lo.copy(), hi.copy()
        going = np.arange(len(found))
        while len(going):
            more = depth[going] < test.length[found[going]]
            going = going[more]
            want = test.flat[test.start[found[going]] + depth[going]]
            a = self._bound(lo[going], hi[going], depth[going], want)
            b = self._bound(lo[going], hi[going], depth[going], want + 1)
            some = b > a
            going = going[some]
            lo[going], hi[going] = a[some], b[some]
            depth[going] += 1
            at_window = going[depth[going] <= test.need[found[going]]]
            wlo[at_window], whi[at_window] = lo[at_window], hi[at_window]
        whole = depth >= test.need[found]
        return found[whole], wlo[whole], whi[whole], lo[whole], hi[whole], depth[whole]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First entry of [lo, hi) whose word at ``depth`` is not below ``want``."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            below = open_ & (self.ids[np.minimum(self.order[np.minimum(mid, len(self.order) - 1)] + depth,
                                                 len(self.ids) - 1)] < want)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo


class Shard:
    """Texts as one sequence of word numbers, a 0 after each."""

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, key: tuple, text: bytes | None, number: dict[bytes, int]) -> None:
        ids = [np.fromiter(map(number.get, part, repeat(0)), np.int64, len(part)) for part in terms(text)]
        self.keys.append(key)
        self.parts.append(np.concatenate(ids) if ids else np.zeros(0, np.int64))
        self.words += len(self.parts[-1])

    def lay(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of every text, its words)."""
        sizes = np.array([len(p) for p in self.parts], np.int64)
        ids = np.concatenate([np.append(p, 0) for p in self.parts])
        return ids, np.cumsum(sizes + 1) - sizes - 1, sizes


def shards(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], size: int) -> Iterator[Shard]:
    now = Shard()
    for b in batches:
        for d, t, x in zip(b.column("doc_id").to_pylist(), b.column("tkey").to_pylist(), b.column("text")):
            now.add((d, t), x.as_buffer().to_pybytes() if x.is_valid else None, number)
            if now.words >= size or len(now.keys) >= size:
                yield now
                now = Shard()
    if now.keys:
        yield now


def _spans(hit: np.ndarray) -> list[dict]:
    """Runs of hit words as first and last word."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def hits_of(shard: Shard, test: TestSuffixes) -> tuple[list[list[dict]], list[list[str]], np.ndarray]:
    """Per text of the shard: runs of hit words, names of the items with a window
    there, number of words."""
    ids, start, sizes = shard.lay()
    array = SuffixArray(ids, len(test.number))
    found, wlo, whi, *_ = array.search(test)
    mark = np.zeros(len(ids) + 1, np.int64)
    held: dict[int, set[str]] = defaultdict(set)
    same: dict[tuple[int, int, int], set[str]] = defaultdict(set)   # equal windows: one interval
    for i, a, b in zip(found.tolist(), wlo.tolist(), whi.tolist()):
        name = test.names[test.item[i]]
        same[a, b, int(test.need[i])].update([name] if name is not None else [])
    for (a, b, need), names in same.items():
        at = array.order[a:b]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + need, -1)
        if names:
            for doc in np.unique(np.searchsorted(start, at, "right") - 1).tolist():
                held[doc] |= names
    hit = np.cumsum(mark)[:-1] > 0
    texts = np.unique(np.searchsorted(start, np.flatnonzero(hit), "right") - 1).tolist()
    spans: list[list[dict]] = [[] for _ in shard.keys]
    for doc in texts:
        spans[doc] = _spans(hit[start[doc]:start[doc] + sizes[doc]])
    return spans, [sorted(held.get(i, ())) for i in range(len(shard.keys))], sizes


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items, block by block; only one block is on the driver at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("name"), "text").where(F.col("text").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r["name"], r["text"]) for r in rows.where(F.col("block") == b).collect()]


def _read(docs: DataFrame) -> tuple[DataFrame, str]:
    rows = docs.select("doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    return rows, docs.schema["doc_id"].dataType.simpleString()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, tkey, n_words, spans (array of first and last
    hit word, from 0) and items (sorted ids of the items with a window there)."""
    rows, kind = _read(docs)
    schema = f"doc_id {kind}, tkey long, n_words long, spans array<struct<first: long, last: long>>, items array<string>"
    passes = []
    for block in item_blocks(items, block_chars):
        def scan(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(block, window)
            for shard in shards(batches, test.number, shard_words):
                spans, names, sizes = hits_of(shard, test)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in shard.keys], ids_type(kind)), pa.array([t for _, t in shard.keys], pa.int64()),
                     pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     pa.array(names, pa.list_(pa.string()))], ["doc_id", "tkey", "n_words", "spans", "items"])

        passes.append(rows.mapInArrow(scan, schema))
    return passes[0] if len(passes) == 1 else _together(passes)


def ids_type(kind: str) -> pa.DataType:
    """Arrow type of an id column by its Spark name."""
    fixed = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in fixed:
        raise ValueError(f"ids of type {kind} are not supported: integer or string")
    return fixed[kind]


def _together(passes: list[DataFrame]) -> DataFrame:
    """The passes of several blocks as one result per row."""
    passes = [written(p, "leak-pass") for p in passes]
    every = reduce(DataFrame.union, [p.where(F.size("spans") > 0) for p in passes])
    words = (every.select("doc_id", "tkey", F.explode("spans").alias("s"))
             .select("doc_id", "tkey", F.explode(F.sequence("s.first", "s.last")).alias("w")).distinct()
             .groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list("w")).alias("hit")))
    runs = F.filter("hit", lambda w: ~F.array_contains(F.col("hit"), w - 1))
    ends = F.filter("hit", lambda w: ~F.array_contains(F.col("hit"), w + 1))
    spans = F.transform(F.arrays_zip(runs.alias("a"), ends.alias("b")),
                        lambda z: F.struct(z["a"].alias("first"), z["b"].alias("last")))
    names = (every.select("doc_id", "tkey", F.explode("items").alias("i")).distinct()
             .groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list("i")).alias("items")))
    found = words.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), spans.alias("spans"))
    named = names.select(F.col("doc_id").alias("e"), F.col("tkey").alias("u"), "items")
    base = passes[0].select("doc_id", "tkey", "n_words")
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    return (base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
            .join(named, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("tkey") == F.col("u")), "left")
            .select("doc_id", "tkey", "n_words", F.coalesce("spans", none).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The longest verbatim match of every test suffix that occurs with its
    window: item_id (text), item_at (first word of the suffix), n_words, n_places,
    and the place with the smallest doc_id (nulls last): doc_id, doc_at. Shards
    report one row a suffix; the longest of them is kept."""
    rows, kind = _read(docs)
    schema = f"item_id string, item_at long, n_words long, n_places long, doc_id {kind}, doc_at long"
    passes = []
    for block in item_blocks(items, block_chars):
        def scan(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(block, window)
            for shard in shards(batches, test.number, shard_words):
                ids, start, _ = shard.lay()
                array = SuffixArray(ids, len(test.number))
                found, _, _, lo, hi, depth = array.search(test)
                out = []
                for i, a, b, n in zip(found.tolist(), lo.tolist(), hi.tolist(), depth.tolist()):
                    at = np.sort(array.order[a:b])
                    doc = np.searchsorted(start, at, "right") - 1
                    ids_of = [shard.keys[k][0] for k in doc.tolist()]
                    best = min(range(len(at)), key=lambda k: (ids_of[k] is None, 0 if ids_of[k] is None else ids_of[k], k))
                    out.append((test.names[test.item[i]], int(test.at[i]), n, len(at), ids_of[best],
                                int(at[best] - start[doc[best]])))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:4]],
                         pa.array(cols[4], ids_type(kind)), pa.array(cols[5], pa.int64())],
                        ["item_id", "item_at", "n_words", "n_places", "doc_id", "doc_at"])

        passes.append(rows.mapInArrow(scan, schema))
    every = written(reduce(DataFrame.union, passes), "longest-matches")
    most = every.groupBy("item_id", "item_at").agg(F.max("n_words").alias("most"))
    most = most.select(F.col("item_id").alias("i"), F.col("item_at").alias("a"), "most")
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_at") == F.col("a")) & (F.col("n_words") == F.col("most"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_at"))
    return (every.join(most, same).groupBy("item_id", "item_at", "n_words")
            .agg(F.sum("n_places").alias("n_places"), first.alias("p"))
            .select("item_id", "item_at", "n_words", "n_places", "p.doc_id", "p.doc_at"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    bad = (contamination(docs, items, window).where(F.size("spans") > 0)
           .select(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).distinct())
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key().alias("tkey"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))
    return rows.join(bad, same, "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), items.select("item_id", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


#: The sha256 of an empty list is that of an empty text.
NO_ITEMS_SHA256 = hashlib.sha256(b"").hexdigest()

OP12_SQL = rf"""
with upper as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small),
dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '{TERM_PATTERN}') as ws
  from documents, upper),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '{TERM_PATTERN}') as ws
  from benchmark, upper),
win as (
  select item_id, least({WINDOW}, len(ws)) as k,
         unnest([array_to_string(ws[a:a + least({WINDOW}, len(ws)) - 1], ' ') for a in range(1, len(ws) - least({WINDOW}, len(ws)) + 2)]) as g
  from iw where len(ws) > 0),
sizes as (select distinct k from win),
dg as (
  select doc_id, k, unnest(range(1, len(ws) - k + 2)) as a,
         unnest([array_to_string(ws[a:a + k - 1], ' ') for a in range(1, len(ws) - k + 2)]) as g
  from dw, sizes where len(ws) >= k),
met as (select distinct dg.doc_id, dg.a, dg.k, win.item_id from dg join win on win.k = dg.k and win.g = dg.g),
hit as (select doc_id, count(distinct a + j) as n_hit from met, range({WINDOW}) r(j) where j < k group by doc_id),
named as (
  select doc_id, count(item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from met) group by doc_id)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join named using (doc_id)
"""
