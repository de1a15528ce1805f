"""The pipeline's stages one after another, each written and read again, against
brute force on what its predecessor kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from amity.llm import packing

BLOCK = "\n".join(f"shared passage line {i} with words that many copies hold {i * 7}" for i in range(5))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = words((t or "").lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows = [(i, "\n".join(text(12) for _ in range(4)), "en", "abc"[i % 3]) for i in range(24)]
    rows += [(30, rows[0][1], "en", "a"), (31, rows[0][1], "en", "b")]                    # copies
    rows += [(40, BLOCK + "\n" + text(60), "en", "a"), (41, text(60) + "\n" + BLOCK, "en", "b")]
    rows += [(50, "too short", "en", "a"), (51, None, "en", None), (52, "again " * 80, "en", "c")]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs.collect()

    clean = {i for i, *_ in rows} - {50, 51, 52}
    assert {r["doc_id"] for r in left["quality_rules"]} == clean
    lines = {r["doc_id"]: r["text"].split("\n") for r in left["line_dedup"]}
    assert set(lines) == clean
    assert lines[40][:5] == BLOCK.split("\n") and len(lines[41]) == 1  # the later copy goes
    prints = [fingerprint(r["text"]) for r in left["simhash_near_dedup"]]
    assert all(bin(a ^ b).count("1") > 2 for k, a in enumerate(prints) for b in prints[:k])
    before = {fingerprint(r["text"]) for r in left["line_dedup"]}
    assert all(any(bin(a ^ b).count("1") <= 2 for b in prints) for a in before)
    times = Counter(r["doc_id"] for r in left["source_mixing"])
    assert set(times) <= {r["doc_id"] for r in left["simhash_near_dedup"]} and max(times.values()) <= 3
    from tokenizers import Tokenizer
    tk, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in left["source_mixing"]:
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[r["doc_id"], k, zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in left["best_fit_packing"]) == want
