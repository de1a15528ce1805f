"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set where over half of its shingles' XXH64
values have it. Fingerprints that differ in at most ``max_bits`` bits are
linked; a component of links is a group of near copies.

Index: a 64-bit fingerprint has two 32-bit segments, and stands in the table of each
under that segment's value. Two fingerprints within ``max_bits`` bits differ in at
most half as many, rounded down, in one of the segments. So each fingerprint looks
up the Hamming ball of that radius around each of its segments, and the complete
distance of every match is verified.

A segment value that more than ``HOT_VALUES`` different fingerprints share is hot: there
a lookup that spent f bits on this segment may spend ``max_bits`` - f on the other,
so the ball of that radius around the other segment is looked up too, under both
values at once. The matches are the same, and a hot value costs its fingerprints
times a ball, never its fingerprints squared. Links stay few by themselves: a
fingerprint has no more neighbours than the ball around it.

Equal fingerprints are collapsed before anything else, with partial counts, so
a group of a third of all rows is one entry of the index.

Defined cases: null, empty and word-less texts have fingerprint zero, linked
like any other; a text with fewer words than a shingle is one shingle; equal
rows have the same result each; the component of rows whose doc_ids are all
null is null; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, text_key, written
from amity.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: More bits would want more segments than two.
MOST_BITS = 3
SEGMENT_BITS = 32
#: Different fingerprints under one segment value that are matched without the
#: other segment's ball.
HOT_VALUES = 500


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    h = b"".join([digest(flat[a:b], SEED) for a, b in
                  zip(starts[:len(w) - shingle + 1].tolist(), ends[shingle - 1:].tolist())])
    ones = _bit_counts(h)
    return int.from_bytes(np.packbits(2 * ones > len(h) // 8).tobytes(), "big")


def _bit_counts(digests: bytes, block: int = 1 << 16) -> np.ndarray:
    """How often each of the 64 bits is set, in blocks of bounded memory."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(rows), block):
        total += np.unpackbits(rows[at:at + block], axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tkey, fp) per row of ``docs``; fp is the signed 64-bit value."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in b.column("text")]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), fp], ["doc_id", "tkey", "fp"])

    rows = docs.select("doc_id", text_key().alias("tkey"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long, fp long")


def ball(radius: int, bits: int = SEGMENT_BITS) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _flips(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot_values: int = HOT_VALUES) -> DataFrame:
    """(a, b), a < b: all pairs of the different fingerprints of ``prints`` (fp)
    that differ in at most ``max_bits`` bits, ``MOST_BITS`` or fewer."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"max_bits must be 0 to {MOST_BITS}")
    high, low = F.shiftrightunsigned("fp", SEGMENT_BITS), F.col("fp").bitwiseAND((1 << SEGMENT_BITS) - 1)
    halves = F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("value"), o.alias("other"))
                       for k, (v, o) in enumerate([(high, low), (low, high)])])
    table = written(prints.select("fp", F.explode(halves).alias("h")).select("fp", "h.*"), "simhash-table")
    place = ["segment", "value"]
    hot = (table.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > hot_values).select(*place))
    probes = (table.withColumn("flip", F.explode(_flips(ball(max_bits // 2))))
              .select(F.col("fp").alias("a"), "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"),
                      "other", F.bit_count("flip").alias("spent")))
    entries = table.select(*place, "other", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    met = entries.join(hot, place, "left_anti").join(probes.drop("other"), place).where(near).select("a", "b")
    # hot values: the ball of what is left around the other segment
    spare = F.element_at(F.array(*[_flips(ball(max_bits - f)) for f in range(max_bits // 2 + 1)]), F.col("spent") + 1)
    both = (probes.join(hot, place, "left_semi").withColumn("flip", F.explode(spare))
            .select("a", *place, F.col("other").bitwiseXOR(F.col("flip")).alias("other")))
    met_hot = entries.join(hot, place, "left_semi").join(both, [*place, "other"]).where(near).select("a", "b")
    return met.union(met_hot).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, tkey, fp, component_id (the smallest doc_id
    of its group) and first_key (the text key of the row that stays: of the
    rows with that doc_id, the smallest)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    classes = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
                                             .alias("first")), "simhash-classes")
    found = written(links(classes.select("fp"), max_bits), "simhash-links")
    roots = components(found).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    group = rooted.groupBy("root").agg(F.min("first").alias("group"))
    found = written(rooted.join(group, "root").select(
        "fp", F.col("group.doc_id").alias("component_id"), F.col("group.tkey").alias("first_key")), "simhash-groups")
    return rows.join(found, "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: of the smallest doc_id, then of the
    smallest text key; one of rows that are equal."""
    g = near_groups(docs, shingle, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tkey") == F.col("first_key")))
    stay = g.select(F.col("doc_id").alias("kid"), F.col("tkey").alias("kkey")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key().alias("tkey"))
    same = F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("tkey") == F.col("kkey"))
    return (rows.join(stay, same).dropDuplicates(["doc_id", "tkey"])
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
