"""What the operators compute inside, against plain restatements: features of
toxicity, densification, flows, tables of language groups, fold columns; and the
pipeline's stages on odd tables."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amity.llm import fingerprints, language_id, mixing, toxicity

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ toxicity

def test_features_of_a_text():
    lexicon = {"slur": (4.0, 5.0), "bad": (1.5, 9.0), "idio~": (3.5, 2.0)}
    text = "You SLUR, you! Bad b4d idiotic sl*r? fine words here"
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
    words = text.split()
    assert len(words) == 10
    assert got["strong"] == 2 and got["weak"] == 1                  # slur, idiotic; bad
    assert got["clear"] == 2                                        # slur, bad
    assert got["strong_density"] == 20 and got["weak_density"] == 10
    assert got["cluster"] == 2 and got["second"] == 20 and got["second_near"] == 2
    letters = [c for c in text if c.isalpha()]
    assert got["capitals"] == sum(c.isupper() for c in letters) / len(letters)
    assert got["shouted"] == 10 and got["exclaims"] == 10 and got["asks"] == 10
    marks = [c for c in text if not c.isalnum() and not c.isspace() and c != "_"]
    assert got["punctuation"] == len(marks) / len(text)
    assert got["obfuscated"] == 20 and got["log_words"] == float(np.log1p(10))
    assert set(toxicity.features("", lexicon)) == set(toxicity.features(" \n", lexicon)) == {0.0}
    far = "slur " + "x " * 30 + "you"
    assert dict(zip(toxicity.FEATURES, toxicity.features(far, lexicon)))["second_near"] == 0


def test_held_out_and_predicted_columns(spark):
    got = toxicity.op3_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1
    for r in language_id.op8_language_id(spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


# ------------------------------------------------------------------ fingerprints

@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 5000])
def test_densification_equals_a_naive_one(n):
    rng = np.random.default_rng(n)
    hashes = fingerprints._mixed(rng.integers(0, 1 << 63, n).astype(np.uint64))
    bins, bits = fingerprints.BINS, fingerprints.BITS
    least: dict[int, int] = {}
    for h in hashes.tolist():
        b = h >> (64 - 9)
        least[b] = min(h, least.get(b, h))
    orders = fingerprints._orders(bins)          # of every bin, the order in which it asks the others
    want = []
    for b in range(bins):
        source = b if b in least else next(int(x) for x in orders[:, b] if int(x) in least)
        z = (least[source] + (b + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % (1 << 64)
        want.append((z ^ (z >> 31)) & ((1 << bits) - 1))
    assert fingerprints.fingerprint(hashes).tolist() == want
    assert sorted(orders[:, 3].tolist()) == list(range(bins))
    assert int(fingerprints.packed(np.array(want, np.uint8)), 16) == int("".join(f"{x:x}" for x in want), 16)


# ------------------------------------------------------------------ mixing

def cost(given, capacity):
    return sum(min(w // capacity, 2) for w in range(given))


def test_flow_equals_an_exhaustive_search():
    rng = random.Random(4)
    for _ in range(25):
        member = [rng.choice([[0], [1], [0, 1]]) for _ in range(3)]
        capacity = [rng.randint(1, 2) for _ in member]
        quota = [rng.randint(0, 7), rng.randint(0, 7)]
        choices = [[f for f in itertools.product(range(3 * c + 1), repeat=len(m)) if sum(f) <= 3 * c]
                   for c, m in zip(capacity, member)]
        best = None
        for flow in itertools.product(*choices):
            got = [0, 0]
            for m, f in zip(member, flow):
                for s, x in zip(m, f):
                    got[s] += x
            if got[0] <= quota[0] and got[1] <= quota[1]:
                key = (-sum(got), sum(cost(sum(f), c) for f, c in zip(flow, capacity)))
                best = key if best is None else min(best, key)
        found = mixing.min_cost_flow(capacity, member, [float(q) for q in quota])
        given = [round(sum(f)) for f in found]
        assert all(abs(sum(f) - g) < 1e-4 and g <= 3 * c for f, g, c in zip(found, given, capacity))
        assert (-sum(given), sum(cost(g, c) for g, c in zip(given, capacity))) == best
        apart = mixing.routed(capacity, member, [float(q) for q in quota])
        assert round(sum(map(sum, apart))) == sum(given)


def test_patterns_are_linked_through_sources():
    assert sorted(map(sorted, mixing.linked([[0], [1, 2], [2, 3], [4], [0], [3]]))) == [[0, 4], [1, 2, 5], [3]]
    n = 20_000     # a source each: no flow between them
    flow = mixing.routed([10] * n, [[i] for i in range(n)], [25.0] * n)
    assert all(abs(f[0] - 25) < 1e-6 for f in flow)


# ------------------------------------------------------------------ languages

def test_groups_of_languages_give_what_one_table_gives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(
        [(-1, None, None), (-2, "", None), (-3, "12 34", "en"), (None, "The weather is fine", None)], docs.schema))
    stats = language_id.fit(docs)
    assert len(language_id.language_groups(stats)) == 1
    small = 4 * language_id.SYMBOLS * 3_000
    assert len(language_id.language_groups(stats, small)) > 1
    assert [r for g in language_id.language_groups(stats, small) for r in g] == stats
    one = sorted(map(tuple, language_id.predict(docs, stats).collect()), key=repr)
    two = sorted(map(tuple, language_id.predict(docs, stats, small).collect()), key=repr)
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(one, two))


def test_components_of_no_edges(spark):
    from amity.llm.components import components
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    same = components(spark.createDataFrame([(4, 4), (4, 4)], "a long, b long")).collect()
    assert [tuple(r) for r in same] == [(4, 4)]


# ------------------------------------------------------------------ pipeline

def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, columns with the names that
    the operators use inside."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, row string, tkey long, bad string, "
              "size long, pattern string, copies long, k long")
    words = [f"word{i}" for i in range(400)]
    rng = random.Random(9)
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, body(60), "en", "ab"[i % 2]) for i in range(12)]
    rows += [(None, body(60), "en", "a"), (3, rows[3][1], "en", "b"), (3, rows[3][1], "en", "b"), (7, body(50), None, None),
             (20, None, "en", "a"), (21, "", "en", "a")]
    frame = lambda r: spark.createDataFrame(
        [(i, t, g, s, len(t or ""), "r", 1, "b", 2, "p", 3, 4) for i, t, g, s in r], schema)
    for name, start in (("odd", rows), ("empty", [])):
        docs = frame(start)
        for stage, fn in corpus_pipeline.STAGES:
            out = fn(spark, docs, str(tmp_path))
            if stage != "best_fit_packing":
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            path = str(tmp_path / name / stage)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            ids = [r["doc_id"] for r in docs.collect()]
            if name == "empty":
                assert ids == []
            else:
                assert None in ids and not {20, 21} & set(ids)
                assert docs.where(F.col("doc_id") == 7).count() >= 1
