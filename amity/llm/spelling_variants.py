"""Spelling variant grouping with asymmetric q-chunks.

Words are counted over all documents (``word_counts``: tasks count their texts in
bounded tables, Spark adds the counts up). Two words are near if one inserted,
deleted or replaced code point turns one into the other (``near_pairs``):

* the longer word (either of two of equal length) contributes chunks: two disjoint
  ones of q = length div 2 code points, at places 0 and q;
* the other contributes its positional grams of q code points, for its own length
  and the next, as the partner may be one longer;
* one edit leaves a chunk whole, and the gram equal to it starts within one place
  of it, so words meet under an equal chunk and gram. As the chunk's word is not
  the shorter one, the gram stands where the chunk does, or, for the chunk at q and
  a partner one shorter, one place before; other grams meet nothing and are not
  sent.

What lies on one side of the whole chunk is then equal too, and the edit is on the
other. That side is cut into two chunks in the same way, one of which is whole, so a
key is everything but a gap of about a quarter of the word: (whole chunk, chunk of
the rest, both at their places). A common beginning or ending shared by any number
of words is thus no hot key: words under a key differ in the gap alone. Each
candidate is verified in the join itself, so that no candidate that fails is
ever a row.

A word's form is its near word with the most occurrences if that has ``RATIO`` times
its own; counts at least double from a word to its form, so following forms (by
pointer doubling) ends at the root.

Defined cases: a null or word-less text has no words; a null doc_id counts as the
empty text in the checksum; equal rows count as often as they stand; an empty table
gives an empty result; other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, written

#: Runs of [A-Za-zÀ-ÿ] in UTF-8, A-Z already lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run in so many loses a code point, by its checksum.
EDIT_ONE_IN = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: How many times a word's count its form has at least.
RATIO = 2
#: Different words a task counts before it passes the counts on.
TABLE_WORDS = 200_000


def edited(run: bytes, checksum: int) -> bytes:
    """The run, without one code point if ``EDIT_ONE_IN`` divides the checksum."""
    if checksum % EDIT_ONE_IN:
        return run
    s = run.decode()
    at = checksum % len(s)
    return (s[:at] + s[at + 1:]).encode()


def count_text(counts: Counter, doc_id, text: bytes) -> None:
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower())).items():    # bytes.lower: A-Z only
        checksum = zlib.crc32(run, seed)
        counts[edited(run, checksum) if checksum % EDIT_ONE_IN == 0 else run] += n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with ``min_length`` code
    points and ``min_count`` occurrences or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) - w.count(b"\xc3") >= min_length]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()),
                                               pa.array([n for _, n in kept], pa.int64())], ["word", "n"])
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if x.is_valid:
                    count_text(counts, d, x.as_buffer().to_pybytes())
                    if len(counts) >= TABLE_WORDS:
                        yield rows()
        yield rows()

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _keys(words: DataFrame, longer_by: int) -> DataFrame:
    """(key, word, n): the four keys of every word for a longest partner of its
    own length plus ``longer_by``. 0: the word as chunk side, or as gram side of a
    partner of equal length; 1: as gram side of a partner one longer.

    With l the longer word's length and q = l div 2, the first chunk [0, q) leaves
    a rest of l - q, the second one, with what follows it, a rest of q; a rest of
    r code points is cut at r div 2. The shorter word lacks ``longer_by`` code points
    in the gap, and what follows the gap stands that much earlier. Keys are
    hashes; words that share one by chance are told apart by the verification."""
    long = F.length("word") + longer_by
    q = F.floor(long / 2).cast("int")
    r, h = F.floor((long - q) / 2).cast("int"), F.floor(q / 2).cast("int")
    gaps = [(q + r, long), (q, q + r), (h, q), (F.lit(0), h)]   # first place of the gap, place after it
    keys = [F.xxhash64(long, F.lit(k), F.substr("word", F.lit(1), a), F.substr("word", b - longer_by + 1))
            for k, (a, b) in enumerate(gaps)]
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of the pairs of ``words`` (word, n: no
    word twice) that differ by exactly one edit."""
    chunks = _keys(words, 0)
    a = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = chunks.unionByName(_keys(words, 1)).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # of two equally long words, the smaller one takes the chunk side
    side = (F.length("b") < F.length("a")) | (F.col("a") < F.col("b"))
    found = (a.join(b, (a["key"] == b["key"]) & side & (F.levenshtein("a", "b", 1) == 1))
             .select("a", "a_n", "b", "b_n").distinct())
    both = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"),
                              F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])
    return found.select(F.explode(both).alias("p")).select("p.*")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of ``words`` (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.rank") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` (word, form, ...) with ``root``: the end of the word's chain of
    forms, itself without one. Pointers double until all are at a root."""
    at = written(found.where("form is not null").select("word", F.col("form").alias("at")), "variants-chains")
    while True:
        step = at.select(F.col("word").alias("at"), F.col("at").alias("next"))
        moved = written(at.join(step, "at", "left").select("word", F.coalesce("next", "at").alias("at"),
                                                           F.col("next").isNotNull().alias("went")), "variants-chains")
        at = moved.select("word", "at")
        if moved.where("went").isEmpty():
            break
    return found.join(at, "word", "left").withColumn("root", F.coalesce("at", "word")).drop("at")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``."""
    words = written(word_counts(docs, min_length, min_count), "variants-words")
    found = written(forms(words, ratio), "variants-forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir).select("doc_id", "text"))
