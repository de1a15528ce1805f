"""Repeated passages of many words on fewer lines than MIN_LINES, against brute force."""

import random

import corpus_pipeline
from amity.llm import line_dedup


def test_short_runs_of_many_words(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    pool = [text(n) for n in (60, 25, 20, 19, 12, 11, 9, 8, 3, 1)]
    rows = [(1, pool[0]), (2, f"{text(9)}\n{pool[0]}\n{text(9)}"), (3, f"{pool[4]}\n{pool[7]}"), (4, f"{pool[4]}\n \n{pool[7]}"),
            (5, pool[3]), (6, pool[3]), (7, None), (8, ""), (None, pool[0])]
    rows += [(10 + i, "\n".join(rng.choice(pool[3:] + [text(4)]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [x for x in (t or "").split("\n") if x.split()]
        gone = set()
        for n in (1, 2, 3):
            for s in range(len(lines) - n + 1):
                k = tuple(lines[s:s + n])
                if k in seen and (n == 3 or len(" ".join(k).split()) >= 20):
                    gone |= set(range(s, s + n))
                seen.add(k)
        want[i] = [x for k, x in enumerate(lines) if k not in gone]
    assert want[1] and len(want[2]) == 2 and not want[4] and not want[None] and want[5] == want[6]
    for got in (line_dedup.dedup_lines(docs, min_words=20), corpus_pipeline.line_dedup(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: [x for x in (r["text"] or "").split("\n") if x.split()] for r in got.collect()} == want
