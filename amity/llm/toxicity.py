"""Toxicity by gradient-boosted trees over dense features, with isotonic
calibration.

Labelled training rows are split three ways by a hash of doc_id: the first part
(the largest, as it must have met the words) teaches a lexicon (words and beginnings of words whose document frequency differs most
between the labels), the second the trees, the third the calibration, so no part is judged
by words it chose itself. Together they are a sample of about
``TRAIN_ROWS`` rows at most, chosen by hash; scoring covers every row.

Features of a text: densities and counts of strong and weak lexicon words, the count
of those whose odds are beyond doubt, their largest number among ``NEAR``
neighbouring words, how many stand near a second-person word, shares of capitals and of punctuation, and the rate of obfuscated words
(letters with digits or symbols between), alone and spelled back to a lexicon
word.

Defined cases: null and empty texts have all features zero and the score that
belongs to them; labels are the largest of a doc_id's labels, null ones are
none; without both labels among the training rows every score is 0; equal rows
score alike; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import documents, written

FOLDS, HELD_OUT_FOLD = 3, 1
THRESHOLD = 0.7
TRAIN_ROWS = 30_000
#: Where the shares of lexicon and trees end.
LEXICON_SHARE, TREES_SHARE = 0.6, 0.85
#: Lengths of the beginnings of words that the lexicon may hold.
STEMS = (4, 5, 6, 7)
#: Entries of the lexicon, and how often a toxic document must hold one at least.
LEXICON_WORDS, LEAST_TOXIC = 400, 4
STRONG, WEAK = 3.0, 1.0  # log odds
CLEAR = 4.5  # log odds over their standard error
NEAR = 20
TREES, DEPTH = 20, 4
#: Second-person words of the languages expected.
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes "
                          "vous votre vos usted ustedes tú ti tus vosotros os".split())
#: Characters that stand for letters.
SPELLED = str.maketrans("0134578@$!", "oieastbasi")
EDGES = ".,;:!?\"'()[]{}<>-_*"
OBFUSCATED = re.compile(r"(?=.*[^\W\d_])[^\W_]*[\d@$!*#%^&_.\-]+[^\W_]+")
FEATURES = ("clear", "strong", "weak", "strong_density", "weak_density", "cluster", "second", "second_near", "capitals",
            "shouted", "exclaims", "asks", "punctuation", "obfuscated", "spelled_back", "log_words")


#: Entry -> log odds, log odds over their standard error.
Lexicon = dict[str, tuple[float, float]]


def fold_of(doc_id: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w.strip(EDGES) for w in text.lower().split()]


def stems(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings, marked by
    a tilde, so that inflected and compound forms of a word are met too."""
    return [word, *[word[:k] + "~" for k in STEMS if len(word) > k]]


def odds_of(word: str, lexicon: Lexicon) -> float:
    """Largest log odds among the entries for a word, 0 for none."""
    return max((lexicon[x][0] for x in stems(word) if x in lexicon), default=0.0)


def is_clear(word: str, lexicon: Lexicon) -> bool:
    return any(lexicon[x][1] >= CLEAR for x in stems(word) if x in lexicon)


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    low = tokens(text)
    known: dict[str, float] = {w: odds_of(w, lexicon) for w in set(low)}
    sure = {w for w, odds in known.items() if odds and is_clear(w, lexicon)}
    hits = [(i, known[w]) for i, w in enumerate(low) if known[w]]
    odd = [w for w in words if not w.isalpha() and OBFUSCATED.match(w.strip(EDGES))]
    back = sum(odds_of(w.lower().translate(SPELLED).replace("*", "").strip(EDGES), lexicon) >= STRONG for w in odd)
    strong = [i for i, s in hits if s >= STRONG]
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = cluster = 0
    if strong:
        at, yous = np.array(strong), np.array(second)
        cluster = int((np.searchsorted(at, at + NEAR) - np.arange(len(at))).max())
        if len(yous):
            near = int((np.searchsorted(yous, at + 6) - np.searchsorted(yous, at - 5) > 0).sum())
    letters = sum(map(str.isalpha, text)) or 1
    capitals = sum(map(str.isupper, text))
    marks = text.count("!"), text.count("?")
    punctuation = len(re.findall(r"[^\w\s]", text))
    return [float(sum(w in sure for w in low)), float(len(strong)), float(len(hits) - len(strong)), 100 * len(strong) / n, 100 * (len(hits) - len(strong)) / n,
            float(cluster), 100 * len(second) / n, float(near), capitals / letters,
            100 * sum(len(w) > 2 and w.isupper() for w in words) / n, 100 * marks[0] / n, 100 * marks[1] / n,
            punctuation / len(text), 100 * len(odd) / n, float(back), float(np.log1p(n))]


def featured(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``rows`` (text and the columns ``keep``) with an array ``x`` in place of
    the text."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "", lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(of, f"{kinds}, x array<double>")


def learn_lexicon(part: DataFrame) -> Lexicon:
    """Word -> log odds of the label among documents that hold it, and these over
    their standard error, for the
    ``LEXICON_WORDS`` words with the clearest odds. ``part``: text, toxic."""
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, toxic = [], []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                own = {x for w in set(tokens(t or "")) if 1 < len(w) <= 40 for x in stems(w)}
                words.extend(own)
                toxic.extend([y] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    labels = part.groupBy().agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = labels["t"] or 0, labels["n"] - (labels["t"] or 0)
    if not toxic or not clean:
        return {}
    counts = part.mapInArrow(seen, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= LEAST_TOXIC)
    a, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (toxic - F.col("t") + 0.5)) - F.log(c / (clean - (F.col("n") - F.col("t")) + 0.5))
    error = F.sqrt(1 / a + 1 / c)
    top = (counts.withColumn("odds", odds).withColumn("sure", odds / error).where(F.col("odds") >= WEAK)
           .orderBy(F.desc("sure"), "word").limit(LEXICON_WORDS).collect())
    return {r["word"]: (r["odds"], r["sure"]) for r in top}


def training_parts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, part 0 to 2): the sampled training rows, written."""
    y = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("lid")).agg(F.max("toxic").cast("int").alias("toxic"))
    train = y.where(fold_of("lid", FOLDS) != HELD_OUT_FOLD)
    n = train.count()
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "lid"), F.lit(1 << 30)) / float(1 << 30)
    train = train.withColumn("place", place * max(1.0, n / rows)).where("place < 1")
    part = (F.col("place") >= LEXICON_SHARE).cast("int") + (F.col("place") >= TREES_SHARE).cast("int")
    texts = docs.select("doc_id", "text").join(train, F.col("doc_id") == F.col("lid"))
    return written(texts.select("text", "toxic", part.alias("part")), "toxicity-train")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """(lexicon, trees, calibration), or None without both labels in each part."""
    parts = training_parts(docs, labels, rows)
    both = parts.groupBy("part").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).collect()  # 3 rows
    if sum(r["a"] != r["b"] for r in both) < 3:
        return None
    lexicon = learn_lexicon(parts.where("part = 0").select("text", "toxic"))
    x = featured(parts.where("part > 0"), lexicon, ["toxic", "part"])
    x = written(x.select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), "part")
                .coalesce(4), "toxicity-features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1).fit(x.where("part = 1"))
    fitted = trees.transform(x.where("part = 2")).select(_raw().alias("raw"), "label")
    return lexicon, trees, IsotonicRegression(featuresCol="raw").fit(fitted)


def _raw() -> Column:
    return vector_to_array("probability")[1]


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    lexicon, trees, calibration = model
    x = featured(docs, lexicon, ["doc_id"]).select("doc_id", array_to_vector("x").alias("features"))
    raw = trees.transform(x).select("doc_id", _raw().alias("raw"))
    return calibration.setPredictionCol("calibrated").transform(raw).select(
        "doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return score(docs, train(docs, labels)).select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
