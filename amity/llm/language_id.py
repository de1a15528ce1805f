"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted over
all training documents and then frozen. A byte costs -log2 of its probability
in the longest context that the tree holds; a byte not seen there costs the
escape (as many parts as the context has different bytes) and is looked up in
the next shorter context, at last among all bytes alike. The language whose
tree encodes a text in the fewest bits is predicted.

Bytes are folded before: A-Z as a-z, digits as one symbol, other ASCII
characters as one symbol; bytes of other characters stay. Only grams of at
least ``LEAST_SHARE`` of a language's bytes enter its tree, so a tree holds at
most 1 / LEAST_SHARE grams of each order, whatever the corpus; that bounds what
reaches the driver and the workers. All training rows are counted.

As the counts are frozen, the cost of a byte depends on its context only. A
worker expands the trees once into a table (context, byte) -> cost in every
language, where a context is the longest suffix that any tree holds; scoring is
one lookup a byte. The table grows with contexts times languages, so languages
are scored in groups whose table stays within ``TABLE_BYTES`` (one language has at
most 4 / LEAST_SHARE contexts). Several groups are as many passes over the
different texts, whose code lengths are put together by text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language teach nothing; no training rows at all: every text is
``und``; equal costs: the first language in code point order; an empty table
gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, written

ORDER = 3
LEAST_SHARE = 1e-5
#: A worker's table of costs, but for a single language.
TABLE_BYTES = 256 << 20
#: Grams a task holds before it counts them.
BLOCK = 8 << 20
FOLDS, HELD_OUT_FOLD = 4, 2
UNDETERMINED = "und"
SYMBOLS = 156  # 26 letters, digit, other, 128 bytes of longer characters

_FOLD = np.full(256, 27, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = _FOLD[ord("A"):ord("Z") + 1] = np.arange(26)
_FOLD[ord("0"):ord("9") + 1] = 26
_FOLD[128:] = np.arange(28, 156)
_TABLES: dict[str, tuple] = {}


def fold_of(doc_id: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def symbols(text: bytes) -> np.ndarray:
    """Folded bytes behind ``ORDER`` symbols of padding."""
    return np.concatenate((np.full(ORDER, 27, np.int32), _FOLD[np.frombuffer(text, np.uint8)].astype(np.int32)))


def grams(s: np.ndarray) -> np.ndarray:
    """Code of each byte with its ``ORDER`` predecessors."""
    n = len(s) - ORDER
    code = np.zeros(n, np.int32)
    for k in range(ORDER + 1):
        code = code * SYMBOLS + s[k:k + n]
    return code


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): grams of ``ORDER`` + 1 folded bytes over all rows with a
    language. A task counts a batch at a time; counts are summed by Spark."""
    def counted(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, codes in by.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())],
                ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                by.setdefault(lang, []).append(grams(symbols(text.as_buffer().to_pybytes())))
                held += len(by[lang][-1])
                if held > BLOCK:
                    yield from counted(by)
                    by, held = {}, 0
        yield from counted(by)

    rows = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, least_share: float = LEAST_SHARE) -> list[tuple[str, int, int, int]]:
    """The frozen statistics: (lang, order, code, n) of the grams of ORDER + 1
    down to 1 bytes that reach ``least_share`` of their language."""
    full = gram_counts(docs)
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), (F.col("code") % SYMBOLS ** (k + 1)).cast("int").alias("code"))
                                 for k in range(ORDER + 1)]))
    every = full.select("lang", "n", orders.alias("g")).groupBy("lang", "g.order", "g.code").agg(F.sum("n").alias("n"))
    totals = every.where("order = 0").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    kept = every.join(F.broadcast(totals), F.col("lang") == F.col("of")).where(F.col("n") >= least_share * F.col("total"))
    return [tuple(r) for r in kept.select("lang", "order", "code", "n").orderBy("lang", "order", "code").collect()]


def cost_table(stats: list[tuple[str, int, int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, context of ORDER symbols -> state, state x symbol x language
    -> bits)."""
    a = SYMBOLS
    by: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for lang, order, code, n in stats:
        by.setdefault((lang, order), []).append((code, n))
    counts_of = {k: np.array(v, np.int64) for k, v in by.items()}
    langs = sorted({lang for lang, _ in by})
    contexts = [np.zeros(1, np.int64)] + [
        np.unique(np.concatenate([v[:, 0] // a for (_, o), v in counts_of.items() if o == k] or [np.zeros(0, np.int64)]))
        for k in range(1, ORDER + 1)]
    first = np.cumsum([0] + [len(c) for c in contexts])
    state = np.zeros(a ** ORDER, np.int32)
    for k in range(1, ORDER + 1):  # longer contexts overwrite their suffixes
        grid = state.reshape(-1, a ** k)
        grid[:, contexts[k].astype(np.int64)] = first[k] + np.arange(len(contexts[k]), dtype=np.int32)
    p = np.zeros((first[-1], a, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        for k in range(ORDER + 1):
            mine = counts_of.get((lang, k), np.zeros((0, 2), np.int64))
            counts = np.zeros((len(contexts[k]), a))
            counts[np.searchsorted(contexts[k], mine[:, 0] // a), mine[:, 0] % a] = mine[:, 1]
            if k == 0:
                lower = np.full((1, a), 1 / a)
            else:  # the state of the context without its oldest symbol
                shorter = contexts[k] % a ** (k - 1)
                at = np.searchsorted(contexts[k - 1], shorter)
                at = np.minimum(at, len(contexts[k - 1]) - 1)
                lower = p[first[k - 1] + at, :, j].astype(float)
            n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                seen = np.where(counts > 0, counts / (n + d), lower * d / (n + d))
            p[first[k]:first[k + 1], :, j] = np.where(n > 0, seen, lower)
    return langs, state, -np.log2(p)


def _table(key: str, stats) -> tuple:
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = cost_table(stats)
    return _TABLES[key]


def code_lengths(text: bytes, state: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Bits of ``text`` in each language."""
    s = symbols(text)
    g = grams(s)
    at = state[g // SYMBOLS] * np.int64(SYMBOLS) + g % SYMBOLS
    flat = cost.reshape(-1, cost.shape[2])
    total = np.zeros(cost.shape[2])
    for i in range(0, len(at), 1 << 16):
        total += flat[at[i:i + (1 << 16)]].sum(axis=0, dtype=np.float64)
    return total


def language_groups(stats: list[tuple[str, int, int, int]], limit: int = TABLE_BYTES) -> list[list[tuple[str, int, int, int]]]:
    """The statistics in groups of languages, in code point order, whose tables
    keep within ``limit`` bytes."""
    by: dict[str, list] = {}
    for row in stats:
        by.setdefault(row[0], []).append(row)
    groups: list[list] = []
    contexts: set = set()
    n = 0
    for lang in sorted(by):
        own = {(order, code // SYMBOLS) for _, order, code, _ in by[lang]}
        if not groups or 4 * SYMBOLS * (n + 1) * (len(contexts | own) + 1) > limit:
            groups.append([])
            contexts, n = set(), 0
        groups[-1] += by[lang]
        contexts, n = contexts | own, n + 1
    return groups


def _lengths(stats: list[tuple[str, int, int, int]], spark: SparkSession):
    """A function of a text: the bits of the text in each language of ``stats``
    (sorted), None where it is null or has no letter."""
    import uuid
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(stats)

    def of(text: bytes | None) -> np.ndarray | None:
        if text is None or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return None
        _, state, cost = _table(key, sent.value)
        return code_lengths(text, state, cost)
    return of


def predict(docs: DataFrame, stats: list[tuple[str, int, int, int]], table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, lang_pred, score) per row; the score is the language's posterior
    probability among the learned ones, all alike before."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    langs, groups = sorted({r[0] for r in stats}), language_groups(stats, table_bytes)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if len(groups) > 1:
        return _predict_in_groups(docs, langs, groups)
    lengths = _lengths(stats, spark)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                bits = lengths(t.as_buffer().to_pybytes() if t.is_valid and langs else None)
                best = 0 if bits is None else int(np.argmin(bits))
                out.append((UNDETERMINED, 0.0) if bits is None else
                           (langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def _predict_in_groups(docs: DataFrame, langs: list[str], groups: list) -> DataFrame:
    """The same, a pass over the different texts for each group of languages."""
    names = [F.xxhash64(F.col("text")).alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]   # 128 bits
    texts = written(docs.where("text is not null").select(*names, F.col("text").cast("binary").alias("text"))
                    .dropDuplicates(["k1", "k2"]), "language-texts")
    bits = None
    for i, group in enumerate(groups):
        def measure(batches: Iterator[pa.RecordBatch], of=_lengths(group, docs.sparkSession)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [of(t.as_buffer().to_pybytes()) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, pa.list_(pa.float64()))],
                                                 ["k1", "k2", f"bits{i}"])
        one = written(texts.mapInArrow(measure, f"k1 long, k2 long, bits{i} array<double>"), "language-bits")
        bits = one if bits is None else bits.join(one, ["k1", "k2"])
    bits = bits.select("k1", "k2", F.concat(*[f"bits{i}" for i in range(len(groups))]).alias("bits"))
    best = F.array_min("bits")
    total = F.aggregate("bits", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.greatest(best - x, F.lit(-1000.0))))
    found = bits.select(F.col("k1").alias("a"), F.col("k2").alias("b"), (1 / total).alias("p"), F.get(
        F.array(*[F.lit(x) for x in langs]), (F.array_position("bits", best) - 1).cast("int")).alias("l"))
    rows = docs.select("doc_id", *[F.when(F.col("text").isNotNull(), n).alias(f"k{i}") for i, n in enumerate(names, start=1)])
    return rows.join(found, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left").select(
        "doc_id", F.coalesce("l", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("p", F.lit(0.0)).alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stats = fit(docs.where(fold_of("doc_id", FOLDS) != HELD_OUT_FOLD).select("text", "lang"))
    return predict(docs, stats).select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"),
                                       "lang_pred", "score")
