"""Spelling variants, benchmark decontamination and lexical search against brute
force: small hand-made tables with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns, and random ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from amity.llm import decontamination as leak
from amity.llm import lexical_search as lex
from amity.llm import spelling_variants as var
from amity.llm.terms import terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, shard long, term string, items string, row string"
RNG = random.Random(7)
WORDS = [a + b for a in ("an", "be", "co", "du", "él", "fi") for b in ("", "n", "ra", "s1", "ü")]
PASSAGE = " ".join(RNG.choice(WORDS) for _ in range(40))


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


DOCS = [(1, prose(60)), (2, prose(20) + " " + PASSAGE + " " + prose(20)), (3, None), (4, ""), (5, " \n--!! "),
        (6, PASSAGE.upper()), (6, PASSAGE.upper()), (7, PASSAGE.replace(" ", ", ")), (8, " ".join(PASSAGE.split()[5:17])),
        (9, prose(21_000)), (10, "zeta"), (10, "another zeta text of an id"), (None, "zeta " + PASSAGE), (11, "zeta"),
        *[(100 + i, prose(RNG.randrange(1, 40))) for i in range(60)], *[(200 + i, DOCS_COPY) for i in range(3)
                                                                        for DOCS_COPY in ("equal copies of one text",)]]
ITEMS = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[8:25])), (3, "Zeta!"), (4, None), (5, ""), (6, "never written anywhere here"),
         (7, prose(30)), (7, "equal copies of one text"), (None, "another zeta text"), (12, "equal COPIES"),
         *[(20 + i, prose(12)) for i in range(5)]]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "x", "y", "z") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_terms_in_pieces():
    text = ("Ab,cD é9 " * 50).encode()
    whole = [w for part in terms(text) for w in part]
    assert whole == [w for part in terms(text, piece=16) for w in part] == [w.encode() for w in words(text.decode())]
    assert [w for part in terms(b"x" * 100, piece=16) for w in part] == [b"x" * 100]
    assert list(terms(None)) == []


# ------------------------------------------------------------------ decontamination

def windows(window=10):
    for i, t in ITEMS:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            yield (None if i is None else str(i)), a, w[a:a + k]


def brute_leaks(text):
    w, hit, found = words(text), set(), set()
    for name, _, g in windows():
        for a in range(len(w) - len(g) + 1):
            if w[a:a + len(g)] == g:
                hit.update(range(a, a + len(g)))
                found.add(name)
    return len(w), len(hit), tuple(sorted(n for n in found if n is not None))


@pytest.mark.parametrize("shard_words, block_chars", [(1_000_000, 4_000_000), (25, 4_000_000), (300, 120)])
def test_contamination_equals_brute_force(docs, items, shard_words, block_chars):
    got = leak.contamination(docs, items, shard_words=shard_words, block_chars=block_chars).collect()
    flat = Counter((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), tuple(r["items"])) for r in got)
    assert flat == Counter((i, *brute_leaks(t)) for i, t in DOCS)
    for r in got:   # runs of hit words are apart
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_longest_matches_equal_brute_force(docs, items):
    got = {(r["item_id"], r["item_at"]): r for r in leak.longest_matches(docs, items.where("item_id in (1, 2, 7)"), shard_words=200).collect()}
    texts = [(i, words(t)) for i, t in DOCS]
    want = {}
    for i, t in ITEMS:
        w = words(t)
        for a in range(len(w) - min(10, len(w)) + 1 if i in (1, 2, 7) else 0):
            most, places = 0, []
            for d, x in texts:
                for p in range(len(x)):
                    n = 0
                    while a + n < len(w) and p + n < len(x) and w[a + n] == x[p + n]:
                        n += 1
                    if n > most:
                        most, places = n, []
                    if n == most:
                        places.append((d is None, d, p))
            if most >= min(10, len(w)):
                old = want.get((str(i), a), (0, []))
                want[str(i), a] = max(old, (most, places), key=lambda x: x[0]) if old[0] != most else (most, old[1] + places)
    assert set(got) == set(want)
    for key, (most, places) in want.items():
        first = min(places, key=lambda p: (p[0], p[1] or 0, p[2]))
        assert (got[key]["n_words"], got[key]["n_places"], got[key]["doc_id"], got[key]["doc_at"]) == (most, len(places), *first[1:])


def test_decontaminate_removes_affected_documents(docs, items, none):
    left = leak.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(d for d in DOCS if not brute_leaks(d[1])[1])
    assert leak.decontaminate(none, items).collect() == []
    assert leak.decontaminate(docs, items.limit(0)).count() == len(DOCS)
    assert leak.longest_matches(docs, items.limit(0)).collect() == []


def test_suffix_array_sorts_suffixes_within_runs():
    rng = np.random.default_rng(3)
    for words_, size in ((2, 400), (40, 900), (70_000, 300)):
        ids = rng.integers(0, words_ + 1, size) if words_ < 100 else rng.integers(words_ - 3, words_ + 1, size)
        ids = np.concatenate([ids, ids[50:200], [0]])

        def run(p):
            end = p
            while ids[end]:
                end += 1
            return ids[p:end].tolist()
        got = [run(p) for p in leak.SuffixArray(ids, words_).order.tolist()]
        assert got == sorted(run(p) for p in np.flatnonzero(ids).tolist())


def test_suffix_array_up_to_a_depth():
    """Groups of suffixes that agree in their first words, in the order of their places."""
    rng = np.random.default_rng(8)
    for words_, limit in ((1, 20), (2, 7), (3, 20), (50, 2), (9, 1), (70_000, 5)):
        ids = np.concatenate([rng.integers(0 if i % 2 else 1, words_ + 1, 60) for i in range(12)])
        ids = np.concatenate([ids, ids[100:300], np.zeros(1, ids.dtype)])
        array = leak.SuffixArray(ids, words_, limit)
        ends = np.flatnonzero(ids == 0)

        def head(p):
            return tuple(ids[p:min(p + limit, ends[np.searchsorted(ends, p)])])
        heads = [head(p) for p in array.order.tolist()]
        assert heads == sorted(heads)
        assert array.new.tolist() == [i == 0 or heads[i] != heads[i - 1] for i in range(len(heads))]
        assert all(array.new[i] or array.order[i] > array.order[i - 1] for i in range(1, len(heads)))


def test_query_columns_of_leaks(spark, docs, items, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in leak.op12_benchmark_decontamination(spark, str(tmp_path)).collect():
        options = [brute_leaks(t) for i, t in DOCS if i == r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) in [
            (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for n, h, f in options]


# ------------------------------------------------------------------ lexical search

def brute_search(k=20):
    texts = [(i, Counter(words(t))) for i, t in DOCS if words(t)]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = {}
    for item in {i for i, _ in ITEMS}:
        asked = Counter(w for i, t in ITEMS if i == item for w in words(t))
        rows = []
        for d, c in texts:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                        for w, q in asked.items() if c[w])
            if score > 0:
                rows.append((-score, d is None, d))
        out[item] = [(d, -s) for s, _, d in sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("shard_bytes, item_block", [(16_000_000, 2_000), (400, 2_000), (100, 3)])
def test_search_equals_brute_force(docs, items, shard_bytes, item_block):
    got: dict = {}
    for r in lex.search(lex.build_index(docs, shard_bytes), items, item_block=item_block).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert got == {i: [(k + 1, *r) for k, r in enumerate(rows)] for i, rows in brute_search().items()}


def test_search_of_empty_tables(docs, items, none):
    assert lex.search(lex.build_index(none), items).collect() == []
    assert lex.search(lex.build_index(docs), items.limit(0)).collect() == []


def test_lists_hold_what_was_put_in():
    rng = np.random.default_rng(5)
    key = np.unique(rng.integers(0, 40 * 90_000, 3_000))
    term, doc = key // 90_000, key % 90_000
    term, doc = np.append(term, np.full(500, 40)), np.append(doc, np.arange(500))
    tf = rng.choice([1, 2, 300, 70_000], len(term))
    lengths = rng.integers(1, 100_000, 90_000)
    lists, mean = lex.Lists(41, term, doc, tf, lengths), (90_000, int(lengths.sum()))
    m = lex.length_norm(lengths, *mean)
    for t in range(41):
        a, b = lists.blocks[t], lists.blocks[t + 1]
        data = lists.postings[lists.bytes[t]:lists.bytes[t + 1]].tobytes()
        p = lex.PostingList(lists.last[a:b], lists.tf[a:b], lists.shortest[a:b], lists.size[a:b], lists.width[a:b], data, mean, m)
        docs, worth = p.all()
        mine = term == t
        assert docs.tolist() == doc[mine].tolist()
        assert worth.tolist() == lex.impact(tf[mine], m[doc[mine]]).tolist()
        for k in range(b - a):   # a block bound holds for all of its postings
            assert (p.blocks(np.array([k]))[1] <= p.bound[k]).all()


def test_best_of_rejects_before_decompression(monkeypatch):
    """A long common list is opened only where a candidate can still get in."""
    n = 64 * 100
    lengths = np.full(n, 50)
    doc = np.concatenate([np.arange(n), [5, 70, 6_000]])
    term = np.concatenate([np.zeros(n, np.int64), [1, 1, 1]])
    tf = np.concatenate([np.ones(n, np.int64), [1, 9, 1]])
    lists, mean = lex.Lists(2, term, doc, tf, lengths), (n, 50 * n)
    m = lex.length_norm(lengths, *mean)
    opened = []
    whole = lex.PostingList.blocks
    monkeypatch.setattr(lex.PostingList, "blocks", lambda self, which: opened.append((len(self.last), which.tolist())) or whole(self, which))
    ps = []
    for t in range(2):
        a, b = lists.blocks[t], lists.blocks[t + 1]
        data = lists.postings[lists.bytes[t]:lists.bytes[t + 1]].tobytes()
        ps.append(lex.PostingList(lists.last[a:b], lists.tf[a:b], lists.shortest[a:b], lists.size[a:b], lists.width[a:b], data, mean, m))
    least = int(9000 * lex.impact(np.array([9]), m[:1])[0])
    docs, scores = lex.best_of([(10, ps[0]), (9000, ps[1])], n, least)
    assert docs.tolist() == [70] and scores[0] == least + 10 * lex.impact(np.array([1]), m[:1])[0]
    assert (100, [1]) in opened and all(len(w) <= 1 for size, w in opened if size == 100)


# ------------------------------------------------------------------ spelling variants

def brute_words(rows, min_length=5, min_count=3):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def check_variants(got, counts):
    close = {w: [x for x in counts if near(w, x)] for w in counts}

    def form(w):
        best = min(close[w], key=lambda x: (-counts[x], x), default=None)
        return best if best is not None and counts[best] >= 2 * counts[w] else None
    want = set()
    for w, n in counts.items():
        root = w
        while form(root):
            root = form(root)
        want.add((w, form(w), root, n, len(close[w]), counts[form(w)] if form(w) else None))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def vocabulary_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abéy") for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["señorita", "abcdefghijkl"]
    variants = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            variants += [w[:i] + w[i + 1:], w[:i] + rng.choice("abcéÿ") + w[i + 1:], w[:i] + rng.choice("aby") + w[i:]]
    return [(k, " ".join(rng.choice(variants).upper() if k % 5 == 0 else rng.choice(variants) for _ in range(60))) for k in range(60)]


def test_spelling_variants_equal_brute_force(spark):
    rows = vocabulary_rows() + [(None, "straße straße straße"), (500, None), (501, ""), (502, "Été×÷ été×÷ ÉTÉ×÷ abcde1abcde2abcde"),
                                (503, "words " * 4000), (503, "words " * 4000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(4)
    check_variants(var.spelling_variants(docs).collect(), brute_words(rows))


def test_spelling_variants_with_chains_and_ties(spark):
    counts = {"abcde": 3, "abcdf": 6, "abcdg": 6, "abcgg": 12, "abggg": 24, "agggg": 48, "ggggg": 96, "gggggg": 200,
              "lonely": 9, "zzzzz": 5, "zzzzy": 5, "ééééé": 4, "éééé": 9, "éééééé": 8}
    words_ = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = var.with_roots(var.forms(words_)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    check_variants(got, counts)
    root = {r["word"]: r["root"] for r in got}
    assert root["abcdg"] == root["abcgg"] == "gggggg" and root["abcde"] == "abcdf"   # of a tie, the smaller word


def test_near_pairs_share_long_beginnings_and_endings(spark):
    """All words share their beginning or their end, so that a chunk alone would
    bring all of them together; pairs are whole, none twice."""
    rng = random.Random(13)
    tails = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(120)}
    vocabulary = sorted({"prefix" + t for t in tails} | {t + "suffix" for t in tails})
    df = spark.createDataFrame([(w, 3) for w in vocabulary], "word string, n long")
    got = [(r["word"], r["near"]) for r in var.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in vocabulary for b in vocabulary if near(a, b)}


def test_spelling_variants_of_an_empty_table(none):
    got = var.spelling_variants(none)
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_whole_table_equals_brute_force(spark):
    """The registered query over all documents of the smallest table."""
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = brute_words(rows)
    got = {r["word"]: r for r in var.op11_spelling_variants(spark, sf).collect()}
    assert {w: r["n"] for w, r in got.items()} == counts
    for w in sorted(counts)[::50]:
        assert got[w]["n_near"] == sum(near(w, x) for x in counts)
