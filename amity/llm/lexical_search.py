"""Ranked lexical search by Block-Max MaxScore over sharded inverted indexes.

Index (``build_index``): the documents of a task are cut into shards of about
``SHARD_BYTES`` of text (whole texts), numbered within the shard by doc_id. A
shard has a list for each of its terms: postings (document number, tf) in
compressed blocks of ``BLOCK`` entries, each block with its last document, its
largest tf and its shortest document. The index holds every document and every
term and is written once; a query reads the lists of its terms only.

A posting's impact is (1000000000 * tf) div (1000 * tf + 12 * m), where m grows
with the document's length relative to the mean: it rises with tf and falls with
the length, so (largest tf, shortest document) bounds a block at any corpus
statistics, and the largest of these bounds a list.

Search (``search``): a task takes shard after shard and keeps a heap of the best
``k`` documents for each item, so the threshold of one shard serves the next. In a
shard the lists of an item are ordered by their global bounds; the longest run of
the smallest ones whose bounds together stay below the threshold is
non-essential. Candidates come from the essential lists only. For each
non-essential list, largest bound first, a candidate whose score so far and the
bounds of the blocks it falls into cannot reach the threshold is rejected before
any of these blocks is decompressed. The heaps of the tasks are merged by item.

Items are the broadcast side; they go through in blocks of ``ITEM_BLOCK`` items, and
only the terms of a block are joined with the index. A candidate that ties with the
threshold is kept, so that equal scores end in doc_id order.

Defined cases: a null or term-less document is in no statistic and no result; an
item without a term, or whose terms occur nowhere, has no rows; each row of the
documents is a document of its own, equal rows rank one after another; null
doc_ids rank last among equals; items that share an id are one item with all
their terms; empty tables give empty results; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amity.llm.common import documents, written
from amity.llm.decontamination import ids_type
from amity.llm.terms import TERM_PATTERN, terms

#: Bytes of text in a shard, but for a longer text.
SHARD_BYTES = 16_000_000
#: Postings in a block.
BLOCK = 64
#: Items in one pass over the lists.
ITEM_BLOCK = 2_000
#: Documents returned for an item.
TOP = 20
SCALE = 1_000_000_000

INDEX_FIELDS = ("df int, last array<int>, tf array<int>, shortest array<int>, size array<int>, "
                "width array<int>, postings binary, lengths array<int>")


# ------------------------------------------------------------------ index

def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``key`` and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def _bytes_for(most: np.ndarray) -> np.ndarray:
    """Bytes that hold values up to ``most``."""
    return 1 + (most > 0xFF).astype(np.int64) + (most > 0xFFFF) + (most > 0xFFFFFF)


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        has = width > k
        if not has.any():
            return
        out[at[has] + k] = (values[has] >> (8 * k)) & 0xFF


def _get(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(4):
        has = width > k
        if not has.any():
            return out
        out[has] |= data[at[has] + k].astype(np.int64) << (8 * k)
    return out


class Lists:
    """The posting lists of a shard: sorted (term, document) pairs as blocks."""

    def __init__(self, n_terms: int, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> None:
        n = len(term)
        self.df = np.bincount(term, minlength=n_terms)
        begin = np.cumsum(self.df) - self.df
        within = np.arange(n) - begin[term]
        head = np.flatnonzero(within % BLOCK == 0)                 # first posting of every block
        size = np.diff(np.append(head, n))
        block = np.repeat(np.arange(len(head)), size)
        base = np.where(np.arange(n) == head[block], doc, np.roll(doc, 1)) if n else doc
        delta = doc - base
        delta[head] = doc[head]                                    # the first one stands as it is
        self.last, self.tf = doc[head + size - 1], np.maximum.reduceat(tf, head) if n else tf
        self.shortest = np.minimum.reduceat(lengths[doc], head) if n else doc
        wd = _bytes_for(np.maximum.reduceat(delta, head)) if n else doc
        wt = _bytes_for(self.tf)
        self.size, self.width = size, wd * 8 + wt
        room = size * (wd + wt)
        at = np.cumsum(room) - room
        i = np.arange(n) - head[block]
        self.postings = np.zeros(int(room.sum()), np.uint8)
        _put(self.postings, at[block] + i * wd[block], delta, wd[block])
        _put(self.postings, at[block] + size[block] * wd[block] + i * wt[block], tf, wt[block])
        per_term = -(-self.df // BLOCK)
        self.blocks = np.concatenate(([0], np.cumsum(per_term)))   # first block of every term
        self.bytes = np.concatenate((at, [len(self.postings)]))[self.blocks]


def _list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


class IndexShard:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.texts: list[np.ndarray] = []
        self.ids: list = []
        self.bytes = 0

    def add(self, doc_id, text: bytes | None) -> None:
        number, seen = self.number, []
        for part in terms(text):
            for w in set(part):
                if w not in number:
                    number[w] = len(number)
            seen.append(np.fromiter(map(number.__getitem__, part), np.int32, len(part)))
        if any(len(s) for s in seen):
            self.ids.append(doc_id)
            self.texts.append(np.concatenate(seen))
            self.bytes += len(text)

    def rows(self, shard: int, kind: str) -> Iterator[pa.RecordBatch]:
        """The header (documents and their lengths) and a row for each term."""
        by = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        texts = [self.texts[i] for i in by]
        lengths = np.array([len(t) for t in texts], np.int64)
        key, tf = _grouped(np.concatenate(texts).astype(np.int64) * len(texts)
                           + np.repeat(np.arange(len(texts)), lengths))
        term, doc = key // len(texts), key % len(texts)
        lists, n = Lists(len(self.number), term, doc, tf, lengths), len(self.number)
        words = [w.decode() for w in self.number]
        names = ["shard", "term", "df", "last", "tf", "shortest", "size", "width", "postings", "lengths", "doc_ids"]
        id_type = ids_type(kind)
        empty = pa.array([None], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int32()), *[empty] * 5,
             pa.array([None], pa.binary()), _list_array(np.array([0, len(by)]), lengths),
             pa.array([[self.ids[i] for i in by]], pa.list_(id_type))], names)
        for a in range(0, n, 1 << 16):
            b = min(n, a + (1 << 16))
            first, end = lists.blocks[a], lists.blocks[b]
            cut = lists.blocks[a:b + 1] - first
            at = lists.bytes[a:b + 1] - lists.bytes[a]
            data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32).tobytes()),
                                                              pa.py_buffer(lists.postings[lists.bytes[a]:lists.bytes[b]].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b - a, shard)), pa.array(words[a:b], pa.string()), pa.array(lists.df[a:b], pa.int32()),
                 *[_list_array(cut, v[first:end]) for v in (lists.last, lists.tf, lists.shortest, lists.size, lists.width)],
                 data, pa.nulls(b - a, pa.list_(pa.int32())), pa.nulls(b - a, pa.list_(id_type))], names)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id: integer or string, text), written to the
    shared folder: a row for each (shard, term) and one with a null term for each
    shard, with its doc_ids and lengths."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids_type(kind)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = TaskContext.get().partitionId() << 32, IndexShard()
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                now.add(d, x.as_buffer().to_pybytes() if x.is_valid else None)
                if now.bytes >= shard_bytes:
                    yield from now.rows(at, kind)
                    at, now = at + 1, IndexShard()
        if now.ids:
            yield from now.rows(at, kind)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(shards, f"shard long, term string, {INDEX_FIELDS}, doc_ids array<{kind}>"),
                   "lexical-index")


# ------------------------------------------------------------------ search

def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 12 * m)


class PostingList:
    """One term's list in a shard, decompressed block by block on demand."""

    def __init__(self, last, tf, shortest, size, width, postings: bytes, mean: tuple[int, int], m: np.ndarray) -> None:
        self.last, self.size = last, size
        self.wd, self.wt = width // 8, width % 8
        self.data, self.m = np.frombuffer(postings, np.uint8), m
        room = size * (self.wd + self.wt)
        self.at = np.cumsum(room) - room
        self.bound = impact(tf, length_norm(shortest, *mean))      # of every block
        self.most = int(self.bound.max())
        self._all: tuple[np.ndarray, np.ndarray] | None = None

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks ``which``, in order."""
        size = self.size[which]
        block = np.repeat(which, size)
        i = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
        delta = _get(self.data, self.at[block] + i * self.wd[block], self.wd[block])
        tf = _get(self.data, self.at[block] + self.size[block] * self.wd[block] + i * self.wt[block], self.wt[block])
        total = np.cumsum(delta)
        begin = np.cumsum(size) - size
        doc = total - np.repeat(total[begin] - delta[begin], size)
        return doc, impact(tf, self.m[doc])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self._all is None:
            self._all = self.blocks(np.arange(len(self.last)))
        return self._all

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """Block that ``docs`` would stand in; the number of blocks if past the end."""
        return np.searchsorted(self.last, docs)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 100 - 25 + (25 * n * docs) // total


def best_of(lists: list[tuple[int, PostingList]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may score ``least`` or more, all that do among them, with
    their scores: ``lists`` are the item's (weight, list) of this shard."""
    lists = sorted(lists, key=lambda wl: wl[0] * wl[1].most)
    reach = np.cumsum([w * p.most for w, p in lists])
    split = int(np.searchsorted(reach, least, "left"))             # lists[:split] cannot reach it together
    if split == len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.zeros(n_docs, np.int64)
    for w, p in lists[split:]:
        doc, worth = p.all()
        score[doc] += w * worth
    cand = np.flatnonzero(score)
    score = score[cand]
    rest = lists[:split][::-1]                                     # largest bound first
    if rest and len(cand):
        able = score + int(reach[split - 1]) >= least              # by the global bounds
        cand, score = cand[able], score[able]
    if rest and len(cand):
        place = [p.block_of(cand) for _, p in rest]
        bound = [w * np.append(p.bound, 0)[b] for (w, p), b in zip(rest, place)]
        left = np.sum(bound, axis=0)
        for (w, p), b, most in zip(rest, place, bound):
            able = score + left >= least                           # by the block bounds
            left = left - most
            look = np.flatnonzero(able & (b < len(p.last)))
            if len(look):
                doc, worth = p.blocks(np.unique(b[look]))
                at = np.minimum(np.searchsorted(doc, cand[look]), len(doc) - 1)
                score[look] += np.where(doc[at] == cand[look], w * worth[at], 0)
            score[~able] = -1
            left[~able] = -SCALE
    keep = score >= max(least, 1)
    return cand[keep], score[keep]


class Heap:
    """The best ``k`` documents of an item so far: score, then doc_id."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 0

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows += zip(scores, ids)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.least = self.rows[-1][0]


def search_shard(rows: dict[str, list[np.ndarray]], lengths: np.ndarray, ids: list, queries: list[tuple[str, dict[str, int]]],
                 mean: tuple[int, int], heaps: dict[str, Heap]) -> None:
    """Brings the heaps up to date with one shard."""
    m = length_norm(lengths, *mean)
    lists = {term: PostingList(*fields, mean, m) for term, fields in rows.items()}
    for item, weights in queries:
        mine = [(w, lists[t]) for t, w in weights.items() if w > 0 and t in lists]
        if not mine:
            continue
        heap = heaps[item]
        docs, scores = best_of(mine, len(lengths), heap.least)
        if len(docs) > heap.k:                                     # ties with the k-th are kept
            nth = np.partition(scores, len(scores) - heap.k)[len(scores) - heap.k]
            docs, scores = docs[scores >= nth], scores[scores >= nth]
            by = np.lexsort((docs, -scores))[:heap.k]
            docs, scores = docs[by], scores[by]
        heap.add([ids[d] for d in docs.tolist()], scores.tolist())


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf) of the items."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(TERM_PATTERN), F.lit(0))
    return (items.select("item_id", F.explode(found).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("qtf")))


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``index`` for
    each of ``items`` (item_id, text), scores above 0 only."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    n_docs, total = index.where("term is null").select(
        F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    mean = (int(n_docs or 0), int(total or 1))
    asked = written(item_terms(items), "lexical-items")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // item_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    weight = F.floor(1000 * F.log((F.lit(2.0) * mean[0] + 2) / (2 * F.col("df") + 1)))
    schema = f"item_id {item_kind}, doc_id {kind}, score long"
    tops = []
    for block in range(blocks):
        part = asked.where(F.col("block") == block)
        lists = written(index.join(part.select("term").distinct(), "term", "left_semi").select(*index.columns), "lexical-lists")
        df = lists.groupBy("term").agg(F.sum("df").alias("df"))
        queries: dict = {}
        for r in part.join(df.select("term", weight.alias("w")), "term").select("item_id", "term", F.col("qtf") * F.col("w")).collect():
            queries.setdefault(r[0], {})[r[1]] = r[2]
        both = lists.unionByName(index.where("term is null"))

        def run(batches: Iterator[pa.RecordBatch], queries: dict = queries) -> Iterator[pa.RecordBatch]:
            heaps = {item: Heap(k) for item in queries}
            for lengths, ids, rows in _by_shard(batches):
                search_shard(rows, lengths, ids, list(queries.items()), mean, heaps)
            out = [(item, d, s) for item, heap in heaps.items() for s, d in heap.rows]
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, ids_type(item_kind)), pa.array(b, ids_type(kind)),
                                                  pa.array(c, pa.int64())], ["item_id", "doc_id", "score"])

        dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("term").isNotNull())
        tops.append(dealt.mapInArrow(run, schema))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (reduce(DataFrame.union, tops).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, dict]]:
    """(lengths, doc_ids, lists by term) of one shard after another; the header
    comes first."""
    now, head, rows = None, None, {}
    for b in batches:
        shard, term = b.column("shard").to_pylist(), b.column("term").to_pylist()
        fields = [b.column(c) for c in ("last", "tf", "shortest", "size", "width")]
        flat = [(f.offsets.to_numpy(), f.values.to_numpy(zero_copy_only=False)) for f in fields]
        for i, (s, t) in enumerate(zip(shard, term)):
            if s != now:
                if rows:
                    yield (*head, rows)
                now, rows = s, {}
            if t is None:
                head = (b.column("lengths")[i].values.to_numpy().astype(np.int64), b.column("doc_ids")[i].as_py())
            else:
                rows[t] = [v[o[i]:o[i + 1]].astype(np.int64) for o, v in flat] + [b.column("postings")[i].as_buffer().to_pybytes()]
    if rows:
        yield (*head, rows)


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    index = build_index(documents(spark, sf_dir).select("doc_id", "text"))
    return search(index, items.select("item_id", "text"))


OP13_SQL = rf"""
with upper as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small),
dw as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '{TERM_PATTERN}') as ws
  from documents, upper),
st as (select count(*)::bigint as big_n, sum(len(ws))::bigint as big_l from dw where len(ws) > 0),
it as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), big, small), '{TERM_PATTERN}')) as term
  from benchmark, upper),
q as (select item_id, term, count(*)::bigint as qtf from it group by all),
p as (
  select d, doc_id, term, count(*)::bigint as tf, any_value(n) as n
  from (select d, doc_id, len(ws)::bigint as n, unnest(ws) as term from dw)
  where term in (select term from q) group by d, doc_id, term),
df as (select term, count(*)::bigint as df from p group by term),
w as (select term, floor(1000 * ln((2.0::double * big_n + 2) / (2 * df + 1)))::bigint as w from df, st),
s as (
  select item_id, d, doc_id,
         sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::bigint as score
  from p join q using (term) join w using (term), st group by item_id, d, doc_id)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= {TOP}
"""
