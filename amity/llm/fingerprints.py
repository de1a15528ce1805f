"""Document fingerprints by one-permutation MinHash.

Every shingle of ``SHINGLE_WORDS`` words is hashed once; the top bits name its
bin, and a bin keeps the least hash that falls into it. An empty bin takes the
value of the first occupied bin in an order of its own (optimal densification:
every bin's order is an independent permutation, fixed by a seed). The low
``BITS`` bits of each bin's value, mixed with the bin's number so that bins
which share a value agree by chance independently, are packed into the
fingerprint; the share of equal
entries, less what equal low bits give by chance, estimates the Jaccard
likeness of the two sets of shingles.

``fingerprint_edits`` puts each document beside the next one in descending
doc_id. Documents are dealt by ranges of doc_id in one shuffle; the largest id
of each range is known beforehand, and its document is sent to the range above
too, so that a task meets every neighbour it needs and streams its rows.

Defined cases: doc_ids are integers where edits are made; a null text is an empty one; a text without words has one
shingle, the empty one; with fewer words than a shingle its whole sequence is
the shingle; rows of equal doc_id follow each other in the order of their text
keys, null doc_ids come last; a single row is its own next; an empty table
gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, text_key

SHINGLE_WORDS = 5
BINS = 512
BITS = 4
SEED = 7
#: Text a task holds, and the most ranges there may be.
RANGE_BYTES = 4 << 20
MAX_RANGES = 100_000
CACHE_WORDS = 1 << 18


class WordHashes(dict):
    """Word -> 64-bit hash, made at the first lookup."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_WORDS = WordHashes()
_ORDERS: dict[int, np.ndarray] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the worker remembers those it has met."""
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included."""
    h = word_hashes(text.split())
    size = max(1, min(size, len(h)))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    if len(h):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return _mixed(out + np.uint64(size))


def _orders(bins: int) -> np.ndarray:
    if bins not in _ORDERS:
        rng = np.random.default_rng(SEED)
        _ORDERS[bins] = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32).T.copy()
    return _ORDERS[bins]


def fingerprint(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Low bits of every bin (uint8). ``bins``: a power of two."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    h = np.sort(hashes)
    bin_of = (h >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    out = np.zeros(bins, np.uint64)
    occupied = np.zeros(bins, bool)
    out[bin_of[first]] = h[first]
    occupied[bin_of[first]] = True
    empty, orders, turn = np.flatnonzero(~occupied), _orders(bins), 0
    while len(empty):
        source = orders[turn, empty]
        found = occupied[source]
        out[empty[found]] = out[source[found]]
        empty, turn = empty[~found], turn + 1
    low = _mixed(out + np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (low & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(entries: np.ndarray, bits: int = BITS) -> str:
    """Hex digits of the entries, ``bits`` each."""
    if bits == 4:
        return ((entries[0::2] << 4) | entries[1::2]).tobytes().hex()
    return np.packbits(np.unpackbits(entries[:, None], axis=1)[:, 8 - bits:].ravel()).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimated Jaccard likeness, without what chance makes equal."""
    by_chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, (np.mean(a == b) - by_chance) / (1 - by_chance))))


def document_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS,
                          shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [packed(fingerprint(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle), bins, bits), bits)
                   for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _ranges(docs: DataFrame) -> tuple[list[int], int | None]:
    """Upper ends (ids of documents) of all ranges but the last; the largest id."""
    total, top = docs.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    n = min(MAX_RANGES, -(-(total or 0) // RANGE_BYTES))
    if n < 2 or top is None:
        return [], top
    at = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted({x for x in at if x < top}), top


def fingerprint_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has its last
    third replaced by as many characters from the start of the next one."""
    ends, top = _ranges(docs)
    splits = np.array(ends, np.int64)

    @F.pandas_udf("array<struct<range: int, guest: boolean>>")
    def seats(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.tolist()
        null = [x is None or x != x for x in ids]
        at = np.searchsorted(splits, np.array([0 if n else int(x) for x, n in zip(ids, null)], np.int64), "left")
        out = []
        for x, n, r in zip(ids, null, at.tolist()):
            here = [{"range": 0 if n else r, "guest": False}]
            if not n and r < len(splits) and splits[r] == x:
                here.append({"range": r + 1, "guest": True})
            if not n and x == top:
                here.append({"range": 0, "guest": True})
            out.append(here)
        return pd.Series(out)

    rows = docs.select("doc_id", "text", text_key().alias("tkey"), F.explode(seats("doc_id")).alias("seat"))
    dealt = (rows.select("doc_id", "text", "tkey", "seat.range", "seat.guest")
             .repartitionById(len(ends) + 1, "range")
             .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "tkey"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(text: str) -> np.ndarray:
        return fingerprint(shingle_hashes(text.encode(), shingle), bins, bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = None  # (range, doc_id, text, fingerprint)
        fitted = None

        def beside(now: tuple, text: str, fp: np.ndarray) -> tuple:
            _, doc_id, own, own_fp = now
            cut = len(own) // 3
            edited = own[:len(own) - cut] + text[:cut]
            edited_fp = of(edited)
            return (doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), packed(own_fp, bits),
                    packed(edited_fp, bits), likeness(own_fp, edited_fp, bits), likeness(own_fp, fp, bits))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [fitted, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            fitted = b.schema.field("doc_id").type
            done = []
            for r, guest, doc_id, text in zip(b.column("range").to_pylist(), b.column("guest").to_pylist(),
                                              b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                fp = of(text)
                if now is not None and now[0] == r:
                    done.append(beside(now, text, fp))
                elif now is not None:  # no id at all: the range ends where it began
                    done.append(beside(now, first[2], first[3]))
                now = None if guest else (r, doc_id, text, fp)
                if first is None or first[0] != r:
                    first = (r, doc_id, text, fp)
            if done:
                yield table(done)
        if now is not None:
            yield table([beside(now, first[2], first[3])])

    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(
        compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
