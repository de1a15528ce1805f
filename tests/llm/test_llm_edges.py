"""Defined cases of every operator: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with clashing names; each against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from amity.llm import (fingerprints, language_id, license_scan, line_dedup, mixing, packing, quality_rules, simhash,
                       substring_dedup, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tkey long, bad string"
LINE = "one common line that everyone repeats here"
BODY = "\n".join(f"line {i} of a passage that is copied whole with words enough w{i} x{i}" for i in range(6))
TEXTS = [
    (1, BODY, "en", "a"), (2, BODY, "en", "a"), (3, "own start\n" + BODY + "\nown end", "en", "b"),
    (4, None, None, "a"), (5, "", "en", None), (6, "  \n\t ", "de", "b"), (7, "Word", "de", "b"),
    (8, "great words " * 3000, "en", "b"), (9, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 4, "de", "b"),
    (10, "Released under the MIT License.\nAll rights reserved.", "en", "c"), (10, "another text of the same id", "en", "c"),
    (None, "a text without an id that is long enough to have some shingles of its own", "en", "c"),
    (11, LINE + "\n" + BODY.upper(), "en", "a"), (11, LINE + "\n" + BODY.upper(), "en", "a"),
    (12, "plain english words that were written only here and nowhere else in all of this table " * 2, "en", "a"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "r", 7, "x") for i, t, g, s in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_substring_dedup_equals_brute_force(docs, none):
    got = substring_dedup.dedup_substrings(docs, group=2, block=50, with_text=True).collect()
    order = sorted({(i is None, i or 0, t) for i, t, _, _ in TEXTS if t is not None}, key=lambda r: r[:2])
    seen, want = set(), {}
    for null, i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(k)
        want[None if null else i, t] = " ".join(x for x, g in zip(w, gone) if not g)
    for r in got:
        options = [v for (i, t), v in want.items() if i == r["doc_id"]] or [""]
        if r["doc_id"] not in (10,):
            assert r["text"] in options
        assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert r["n_words"] - r["n_removed"] == len(words(r["text"]))
    assert len(got) == len(TEXTS)
    assert {r["doc_id"]: r["n_removed"] for r in got}[2] == len(words(BODY))
    assert substring_dedup.dedup_substrings(none).collect() == []


def test_deep_nodes_are_the_groups_of_equal_prefixes():
    items = [([b"a", b"b", b"c"], 1), ([b"a", b"b", b"d"], 2), ([b"x", b"b", b"c"], 3)]
    assert [sorted(n) for n in substring_dedup.deep_nodes(items, 2)] == [[1, 2]]


def test_simhash_equals_brute_force(docs, none):
    got = simhash.near_groups(docs).collect()

    def brute(t):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, brute(t)) for i, t, _, _ in TEXTS]
    group = list(range(len(rows)))
    for _ in rows:
        for a, (_, x) in enumerate(rows):
            for b, (_, y) in enumerate(rows):
                if bin(x ^ y).count("1") <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = [min((rows[b][0] for b in range(len(rows)) if group[b] == g and rows[b][0] is not None), default=None) for g in group]
    want = Counter((i, fp, c) for (i, fp), c in zip(rows, least))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    stay = simhash.near_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(set(group))
    assert simhash.near_dedup(none).count() == 0


def test_components_of_chains_and_stars(spark):
    from amity.llm.components import components
    edges = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(20)] + [(300, 300)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len({roots[i] for i in range(31)}) == 1 and len({roots[200 + i] for i in range(20)} | {roots[100]}) == 1
    assert len(set(roots.values())) == 3


def test_line_dedup_equals_brute_force(docs, none):
    got = line_dedup.line_report(docs).collect()
    order = sorted({(i is None, i or 0, t) for i, t, _, _ in TEXTS if t is not None}, key=lambda r: r[:2])
    seen, want = set(), {}
    for null, i, t in order:
        lines = [x for x in t.split("\n") if words(x)]
        gone = set()
        for s in range(len(lines) - 2):
            k = tuple(lines[s:s + 3])
            gone |= {s, s + 1, s + 2} if k in seen else set()
            seen.add(k)
        want.setdefault(None if null else i, []).append((len(lines), len(gone)))
    for r in got:
        assert (r["n_lines"], r["n_removed"]) in want.get(r["doc_id"], [(0, 0)])
    assert {r["doc_id"]: r["n_removed"] for r in got}[3] == 6
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == len(TEXTS)
    assert line_dedup.line_report(none).collect() == []


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    got = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    tk = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _, _ in TEXTS:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            raw = np.array(ids[k:k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    fill = sorted(sum(n for _, n in places) for places in by.values())
    assert fill[0] + fill[1] > 64  # no two sequences fit into one
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a.b., c.. d ., e", "It's they'LL go. Don't, no.", "<|endoftext|> A <|ENDOFTEXT|>. B",
                                  "Straße, ΣΑΣ. İstanbul, é. x…. y", "1.5, 2. 3, a1. \t b.　c,", "日本語。テキスト, ok. ١٢٣. ²."])
def test_words_encode_as_in_the_text(text):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode([text], path)[0], "<u4").tolist() == whole


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}  # 38 of capacity 10
    plan = packing.complete_bins(counts, 10)
    held = Counter()
    for filling, n in plan:
        assert sum(s * k for s, k in filling) <= 10
        for s, k in filling:
            held[s] += k * n
    assert held == counts and sum(n for _, n in plan) == 4


def test_mixing(docs, none):
    rows, member, sizes, quota = mixing.mix(docs)
    got = rows.collect()
    size = Counter()
    for _, t, _, s in TEXTS:
        size[s] += len(words(t))
    assert sizes == dict(size) and abs(sum(quota.values()) - sum(size.values())) < 1e-6
    assert all(quota[s] <= 3 * sizes[s] + 1e-9 for s in sizes) and all(0 <= r["copies"] <= 3 for r in got)
    assert Counter(r["copies"] * r["size"] for r in got) == Counter(r["copies"] * r["size"] for r in mixing.mix(docs)[0].collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(none)[0].count() == 0


def test_flow_of_overlapping_sources_prefers_unread_words():
    flow = mixing.min_cost_flow([10, 10], [[0, 1], [1]], [10.0, 10.0])
    assert flow[0][0] == 10 and flow[0][1] == 0 and flow[1] == [10]
    flow = mixing.min_cost_flow([10, 10], [[0, 1], [1]], [25.0, 5.0])
    assert abs(flow[0][0] - 25) < 1e-6 and abs(flow[1][0] - 5) < 1e-6


def test_targets_reshare_the_excess():
    t = mixing.targets({"a": 10, "b": 100}, {"a": 5, "b": 2}, 110)
    assert t == {"a": 30.0, "b": 80.0}


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(TEXTS) and fingerprints.fingerprint_edits(none).collect() == []
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[2]["near_next"] == 1.0
    assert by[4]["fingerprint"] == by[5]["fingerprint"]  # null and empty
    edited = BODY[:len(BODY) - len(BODY) // 3] + BODY[:len(BODY) // 3]
    assert by[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()  # next of 2 is 1
    last = by[1]  # the smallest id but for the null one
    own = next(t for i, t, _, _ in TEXTS if i is None)
    want = BODY[:len(BODY) - len(BODY) // 3] + own[:len(BODY) // 3]
    assert last["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_fingerprints_estimate_likeness():
    rng = np.random.default_rng(3)
    for keep in (0, 300, 600, 900):
        a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate((a[:keep], rng.integers(0, 1 << 63, 1000 - keep).astype(np.uint64)))
        a, b = fingerprints._mixed(a), fingerprints._mixed(b)
        want = keep / (2000 - keep)
        assert abs(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - want) < 0.1


def test_language_id(docs, none):
    stats = language_id.fit(docs.select("text", "lang"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, stats).collect() if r["doc_id"] not in (10, 11)}
    assert got[9]["lang_pred"] == "de" and got[12]["lang_pred"] == "en"
    assert [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and got[4]["score"] == 0
    assert language_id.predict(docs, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, stats).count() == 0


def test_code_lengths_equal_the_definition():
    text = b"abab abba"
    s = language_id.symbols(text)
    grams = Counter()
    for k in range(4):
        for i in range(3, len(s)):
            code = 0
            for x in s[i - k:i + 1]:
                code = code * 156 + int(x)
            grams["x", k, code] += 1
    langs, state, cost = language_id.cost_table([(g, k, c, n) for (g, k, c), n in grams.items()])

    def p(context, x):
        seen = {c % 156: n for (_, k, c), n in grams.items() if k == len(context) and c // 156 == sum(
            int(y) * 156 ** (len(context) - 1 - j) for j, y in enumerate(context))}
        n, d = sum(seen.values()), len(seen)
        lower = 1 / 156 if not len(context) else p(context[1:], x)
        if not n:
            return lower
        return seen[x] / (n + d) if x in seen else lower * d / (n + d)

    q = language_id.symbols(b"baba cab")
    want = -sum(np.log2(p(tuple(q[i - 3:i]), int(q[i]))) for i in range(3, len(q)))
    assert abs(language_id.code_lengths(b"baba cab", state, cost)[0] - want) < 1e-3


def test_license_scan(docs, none):
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect() if r["license"]}
    assert got[10]["license"] == "MIT" and got[10]["sequence"] == "MITShort AllRights"
    assert license_scan.license_scan(docs).count() == len(TEXTS) and license_scan.license_scan(none).count() == 0
    for sentence, _ in license_scan.SENTENCES:
        assert any(t in sentence for t in license_scan.TRIGGERS) or sentence == "you may obtain a copy of the license at", sentence
        assert re.sub("[^a-z0-9]+", " ", sentence) == sentence


def test_license_of_wrapped_text(spark):
    text = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
            "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.")
    assert license_scan.license_scan(frame(spark, [(1, text, "en", "a")])).first()["license"] == "ISC"


def test_quality_filter(spark, docs, none):
    got = quality_rules.quality_filter(docs, max_texts=1, max_percent=0)
    assert got.columns == docs.columns and quality_rules.quality_filter(none).count() == 0
    fine = [(20, " ".join(f"word{k}" for k in range(25)), "en", None)]
    report = quality_rules.quality_report(frame(spark, TEXTS + fine))
    assert [r["doc_id"] for r in report.where("kept").collect()] == [20]  # the others are short or repeat themselves
    assert {r["doc_id"]: r["n_repeat_words"] for r in report.collect()}[8] == 6000
    assert quality_rules.quality_report(docs).count() == len(TEXTS)


def test_boilerplate_goes_and_depleted_documents_with_it(spark):
    own = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    rows = [(i, f"{LINE}\n{own(i, 40)}", "en", "a") for i in range(30)] + [(99, f"{LINE} \n{LINE}\n{LINE}\n{own(99, 12)}", "en", "a")]
    rows.append((100, f"{LINE}\n{own(100, 40)}", "en", None))
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["text"] for r in quality_rules.quality_filter(docs, max_texts=20, max_percent=1).collect()}
    assert 99 not in got and got[3] == own(3, 40) and got[100].startswith(LINE)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    bad = "you utter fool"
    rows = [(i, ("calm words about rivers and hills number%d " % i) * 3 + (bad if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    many = frame(spark, rows + [(1000, None, None, None), (1001, "", None, None)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(many, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(many, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held) and got[1000] == got[1001] < 0.7
    assert toxicity.score(none, model).count() == 0
