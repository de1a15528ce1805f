"""Substring dedup: prefix-partitioned suffix trees over word sequences.

A window is ``WINDOW`` consecutive words of one document. Every word covered by
a window whose word sequence also starts earlier (smaller doc_id, or earlier in
the document) is removed; windows are judged on the input.

Only suffixes that can share ``WINDOW`` words with another need a tree. Each
window has an anchor: the ``GRAM``-word gram in it with the least hash, leftmost
first; equal windows have equal anchors at equal places, and neighbouring
windows mostly share theirs, so anchors are few. Anchors are the prefixes that
partition the suffixes: a window belongs to the group of its anchor's gram, and
a gram that occurs once holds no repeat and is dropped, text and all.

1. Each task's block of documents is a subtree of its own: its suffixes are sorted by
   their words, the nodes a window deep give the repeats within the block, and all
   but their first places are marked there (of a group of copies one is passed on).
2. Anchors are sorted by gram; grams that occur twice or more stay.
3. The words around those anchors are cut from the texts and grouped by gram.
   Prefix lengths vary: a gram of more than ``GROUP`` occurrences is too large
   for one tree, and its windows are grouped by their whole ``WINDOW`` words
   instead, where a group needs no tree, only its first occurrence. Grams that
   are frequent in a sample of documents are sent that way at once, spread over
   all tasks; the sample decides the way, never the result.
4. Within a group the suffixes are sorted, and runs of neighbours whose longest
   common prefix is at least ``WINDOW`` words are the deep internal nodes of
   the group's suffix tree, the maximal repeats; all but a node's first
   occurrence are marked.
5. The marks of a document meet its text again.

Blocks and groups compare the words themselves; whole-window groups a 128-bit
digest.

Defined cases: doc_ids are integers; a null text has no words; a text of fewer words than a window
keeps all; equal rows (doc_id and text) are one document; rows that share a
doc_id and differ in text come in the order of their text keys; null doc_ids
come last; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, text_key, written
from amity.llm.decontamination import SuffixArray
from amity.llm.fingerprints import SEED, _mixed

WINDOW = 20
GRAM = 8
#: Most occurrences of a gram that one tree takes.
GROUP = 2000
#: Words of a block in which step 1 looks for repeats.
BLOCK_WORDS = 2_000_000
#: The sample for step 3: one document in so many, by hash; grams with at least
#: this many and this share of the sampled anchors are frequent.
SAMPLE_ONE_IN, FREQUENT_COUNT, FREQUENT_SHARE = 64, 12, 1e-5
#: doc_id of rows that have none, in the order of occurrences.
LAST = (1 << 63) - 1


def _rolling(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(factor) + h[k:k + n]
    return _mixed(out)


class WordNumbers(dict):
    """Word -> number from 1 in the order of first lookup, and their hashes."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.hashes.append(xxhash.xxh64_intdigest(word, SEED))
        return n


class Block:
    """The documents of a block, in order, as one array of word hashes and one of
    word numbers (``words`` of them, a 0 after each document)."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], window: int, gram: int, hashes: list[int]):
        rows.sort(key=lambda r: r[:2])
        self.numbers, self.words, self.size = np.concatenate([np.append(r[2], 0) for r in rows]), len(hashes), window
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.tks = np.array([r[1] for r in rows], np.int32)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        h = np.array(hashes, np.uint64)[self.numbers[self.numbers > 0] - 1]
        self.gram = _rolling(h, gram, 0x9E3779B97F4A7C15)
        n = max(0, len(h) - window + 1)
        self.doc = np.repeat(np.arange(len(rows)), sizes)[:n]
        self.valid = np.arange(n) + window <= (self.first + sizes)[self.doc] if n else np.zeros(0, bool)

    def repeated(self) -> np.ndarray:
        """Valid windows that occur earlier in the block: of each node of the
        block's suffix tree that lies a window deep, all places but the first.
        The suffixes are sorted by their words; equal ones stay in the order of
        their places."""
        tree = SuffixArray(self.numbers, self.words, limit=self.size)
        again = tree.order[~tree.new & (tree.left >= self.size)]
        out = np.zeros(len(self.valid), bool)
        # a place counts the ends of the documents before it, a window does not
        out[again - np.searchsorted(self.first + np.arange(len(self.first)), again, "right") + 1] = True
        return out

    def anchors(self, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first start, last start) of the anchors of the windows at
        ``starts``; ``span`` grams lie in a window."""
        best, at = self.gram[starts].copy(), np.zeros(len(starts), np.int64)
        for d in range(1, span):
            x = self.gram[starts + d]
            less = x < best
            best[less], at[less] = x[less], d
        place = starts + at
        # the same place may come again after a gap only; each run is a row
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        end = np.concatenate((cut[1:], [len(place)])) - 1 if len(place) else cut
        return place[cut], starts[cut], starts[end]


def _blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int, block: int) -> Iterator[Block]:
    rows, held, seen, number = [], 0, set(), WordNumbers()
    for b in batches:
        for doc_id, tk, text in zip(b.column("doc_id").to_pylist(), b.column("tk").to_pylist(), b.column("text")):
            doc_id = LAST if doc_id is None else doc_id
            if not text.is_valid or (doc_id, tk) in seen:
                continue
            words = text.as_buffer().to_pybytes().split()
            if len(words) < window:
                continue
            seen.add((doc_id, tk))
            rows.append((doc_id, tk, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
            held += len(words)
            if held > block:
                yield Block(rows, window, gram, number.hashes)
                rows, held, seen, number = [], 0, set(), WordNumbers()
    if rows:
        yield Block(rows, window, gram, number.hashes)


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place in the document, and how far before it its first and last window start."""
    return (place << 16) | ((place - first) << 8) | (place - last)


MARKS = "kind int, doc_id long, tk int, gram long, at long"
#: kinds: an anchor to count, an anchor of a frequent gram, a run of repeated windows
ANCHOR, FREQUENT, RUN = 0, 1, 2


def _batch(kind, ids, tks, gram, at) -> pa.RecordBatch:
    kinds = np.full(len(ids), kind, np.int32) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), pa.array(tks, pa.int32()),
         pa.array(gram, pa.int64()), pa.array(at, pa.int64())], ["kind", "doc_id", "tk", "gram", "at"])


def anchors(rows: DataFrame, frequent: np.ndarray, window: int, gram: int, block: int) -> DataFrame:
    """Steps 1 and 2a: the anchors of windows that are new in their block, and
    runs of windows that are not (at: first start << 32 | last start)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, window, gram, block):
            again = b.repeated()
            starts = np.flatnonzero(again)
            if len(starts):
                for_doc = b.doc[starts]  # a run ends with its document
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(for_doc) != 0))))
                end = np.concatenate((cut[1:], [len(starts)])) - 1
                doc = for_doc[cut]
                at = ((starts[cut] - b.first[doc]) << 32) | (starts[end] - b.first[doc])
                yield _batch(RUN, b.ids[doc], b.tks[doc], np.zeros(len(doc), np.int64), at)
            place, first, last = b.anchors(np.flatnonzero(b.valid & ~again), window - gram + 1)
            if len(place):
                doc = b.doc[first]
                g = b.gram[place].view(np.int64)
                kind = np.where(np.isin(g, frequent), FREQUENT, ANCHOR).astype(np.int32)
                yield _batch(kind, b.ids[doc], b.tks[doc], g, _packed(place - b.first[doc], first - b.first[doc], last - b.first[doc]))

    return rows.mapInArrow(find, MARKS)


def frequent_grams(rows: DataFrame, window: int, gram: int, block: int) -> np.ndarray:
    """Grams that are frequent in the sample; at most 1 / FREQUENT_SHARE."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "tk"), F.lit(SAMPLE_ONE_IN)) == 0)
    found = written(anchors(sample, np.zeros(0, np.int64), window, gram, 0).where(f"kind = {ANCHOR}").select("gram"),
                    "substring-sample")
    least = max(FREQUENT_COUNT, found.count() * FREQUENT_SHARE)
    top = found.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("gram").collect()
    return np.sort(np.array([r[0] for r in top], np.int64))


def repeated_anchors(marks: DataFrame, group: int) -> DataFrame:
    """Step 2b: of the anchors those whose gram occurs twice or more, as
    FREQUENT if more than ``group`` times; other marks as they are. Rows are
    dealt by gram (frequent ones and runs anyhow) and streamed in its order; a
    group is held until it ends or grows past ``group``."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # rows of the last gram so far; a gram known to be large
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            counted, g = cols["kind"] == ANCHOR, cols["gram"]
            n = len(g)
            cut = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | ~counted[1:] | ~counted[:-1])))
            size = np.diff(np.concatenate((cut, [n])))
            of = np.repeat(np.arange(len(cut)), size)
            big = size > group
            if large is not None:
                big |= counted[cut] & (g[cut] == large)
            tail = cut[-1] if counted[-1] and not big[-1] else n
            large = g[-1] if counted[-1] and big[-1] else None
            out = ~counted | ((size > 1) | big)[of]
            out[tail:] = False
            kind = np.where(counted & big[of], FREQUENT, cols["kind"]).astype(np.int32)
            held = t.slice(tail) if tail < n else None
            if out.any():
                yield _batch(kind[out], cols["doc_id"][out], cols["tk"][out], g[out], cols["at"][out])
        if held is not None and held.num_rows > 1:
            yield from held.combine_chunks().to_batches()

    deal = F.when(F.col("kind") == ANCHOR, F.col("gram")).otherwise(F.xxhash64("doc_id", "tk", "at"))
    return (marks.withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", "kind")
            .drop("deal").mapInArrow(keep, MARKS))


SUFFIXES = "key binary, doc_id long, tk int, at long, words binary"


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """Step 3: rows for the groups. For an anchor: its gram and the words from
    its first window to the end of its last. For a frequent gram: a digest of
    each of its windows. ``texts``: doc_id, tk, text, found (kind, gram, at)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, tk, text, found in zip(b.column("doc_id").to_pylist(), b.column("tk").to_pylist(), b.column("text"),
                                               b.column("found").to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                for f in found:
                    place, before, after = f["at"] >> 16, (f["at"] >> 8) & 255, f["at"] & 255
                    first, last = place - before, place - after
                    if f["kind"] == ANCHOR:
                        out.append((f["gram"].to_bytes(8, "big", signed=True), doc_id, tk, f["at"],
                                    b" ".join(words[first:last + window])))
                    else:
                        for s in range(first, last + 1):
                            key = hashlib.blake2b(b" ".join(words[s:s + window]), digest_size=16).digest()
                            out.append((key, doc_id, tk, s, None))
                if len(out) > 50_000:
                    yield _suffix_batch(out)
                    out = []
            if out:
                yield _suffix_batch(out)

    return texts.mapInArrow(cut, SUFFIXES)


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["key", "doc_id", "tk", "at", "words"])


def deep_nodes(items: list[tuple[list[bytes], tuple]], depth: int) -> Iterator[list[tuple]]:
    """Nodes of the suffix tree of ``items`` (suffix, what it stands for) that
    lie ``depth`` words deep: runs of the sorted suffixes whose longest common
    prefix with their neighbour reaches it."""
    items = sorted(items, key=lambda i: i[0])
    node = [items[0][1]]
    for (a, _), (b, who) in zip(items, items[1:]):
        if a[:depth] == b[:depth]:
            node.append(who)
        else:
            if len(node) > 1:
                yield node
            node = [who]
    if len(node) > 1:
        yield node


def later_windows(group: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """Step 4: (doc_id, tk, start) of the windows of a gram's group that are not
    the first occurrence of their words. ``group``: (doc_id, tk, at, words)."""
    if all(g[3] == group[0][3] and (g[2] & 0xFFFF) == (group[0][2] & 0xFFFF) for g in group):
        first = min((g[0], g[1], g[2]) for g in group)  # equal throughout: one node for each window
        for doc_id, tk, at, _ in group:
            if (doc_id, tk, at) != first:
                place, before, after = at >> 16, (at >> 8) & 255, at & 255
                for s in range(place - before, place - after + 1):
                    yield doc_id, tk, s
        return
    by: dict[int, list[tuple[list[bytes], tuple]]] = {}
    for doc_id, tk, at, words in group:
        place, before, after = at >> 16, (at >> 8) & 255, at & 255
        words = words.split(b" ")
        for d in range(after, before + 1):  # suffixes that reach the anchor after d words
            by.setdefault(d, []).append((words[before - d:], (doc_id, tk, place - d)))
    for items in by.values():
        if len(items) > 1:
            for node in deep_nodes(items, window):
                first = min(node)
                for who in node:
                    if who != first:
                        yield who


def later_copies(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, tk, at): runs of windows that are not first occurrences."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, first = None, [], None
        out: list[tuple[int, int, int]] = []
        for b in batches:
            for k, doc_id, tk, at, words in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "tk", "at", "words"))):
                if k != key:
                    if len(group) > 1:
                        out.extend(later_windows(group, window))
                    key, group, first = k, [], (doc_id, tk, at)
                if words is not None:
                    group.append((doc_id, tk, at, words))
                elif (doc_id, tk, at) != first:  # rows of a whole-window group come in order
                    out.append((doc_id, tk, at))
            if len(out) > 50_000:
                yield _run_batch(out)
                out = []
        if len(group) > 1:
            out.extend(later_windows(group, window))
        if out:
            yield _run_batch(out)

    return (rows.repartition("key").sortWithinPartitions("key", "doc_id", "tk", "at")
            .mapInArrow(walk, "doc_id long, tk int, at long"))


def _run_batch(windows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Neighbouring starts of a document as one row."""
    ids, tks, starts = (np.array(c) for c in zip(*sorted(set(windows))))
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tks[1:] != tks[:-1]) | (np.diff(starts) != 1))))
    end = np.concatenate((cut[1:], [len(starts)])) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[cut], pa.int64()), pa.array(tks[cut], pa.int32()), pa.array((starts[cut] << 32) | starts[end], pa.int64())],
        ["doc_id", "tk", "at"])


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text): tk tells texts of one doc_id apart. Null ids as LAST."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
                       text_key().bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tk"),
                       F.col("text").cast("binary").alias("text"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
                  block: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, tk, runs) of every document with windows that are not first
    occurrences; a run is first start << 32 | last start."""
    rows = _texts(docs)
    frequent = frequent_grams(rows, window, gram, block)
    marks = written(repeated_anchors(anchors(rows, frequent, window, gram, block), group), "substring-marks")
    found = (marks.where(f"kind <> {RUN}").groupBy(F.col("doc_id").alias("fid"), F.col("tk").alias("ftk"))
             .agg(F.collect_set(F.struct("kind", "gram", "at")).alias("found")))
    texts = rows.join(found, (F.col("doc_id") == F.col("fid")) & (F.col("tk") == F.col("ftk")))
    runs = written(later_copies(suffixes(texts.select("doc_id", "tk", "text", "found"), window), window), "substring-runs")
    every = marks.where(f"kind = {RUN}").select("doc_id", "tk", "at").union(runs)
    return every.groupBy("doc_id", "tk").agg(F.collect_list("at").alias("runs"))


def _kept(text: bytes | None, runs: list[int] | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """(words, words that stay)."""
    words = (text or b"").split()
    if not runs:
        return words, words
    edge = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        edge[r >> 32] += 1
        edge[(r & 0xFFFFFFFF) + window] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return words, [w for w, s in zip(words, stay.tolist()) if s]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
                     block: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by a space), and these words as ``text`` if asked for."""
    runs = repeated_runs(docs, window, gram, group, block).select(
        F.col("doc_id").alias("rid"), F.col("tk").alias("rtk"), "runs")
    rows = _texts(docs).join(runs, (F.col("doc_id") == F.col("rid")) & (F.col("tk") == F.col("rtk")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, r in zip(b.column("text"), b.column("runs").to_pylist()):
                words, kept = _kept(text.as_buffer().to_pybytes() if text.is_valid else None, r, window)
                left = b" ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            out = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            if with_text:
                out.append(pa.array(cols[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    done = rows.select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else ""))
    kind = docs.schema["doc_id"].dataType
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")).cast(kind))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))
