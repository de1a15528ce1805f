"""The boilerplate limit: one rule from small hosts to large ones."""

import math

from amity.llm import quality_rules


def least_texts(host_texts):
    return next(k for k in range(1, host_texts + 2) if k - host_texts / 100 > math.sqrt(20 * k))


def test_limit_rises_with_the_host_without_a_step():
    sizes = [30, 100, 500, 1_000, 1_999, 2_000, 2_001, 2_100, 5_000, 100_000, 1_000_000]
    limits = [least_texts(n) for n in sizes]
    assert limits == sorted(limits) and limits[0] > 20
    assert least_texts(2_001) - least_texts(1_999) <= 1
    assert 10_000 < limits[-1] < 11_000       # the share, and little more


def test_line_limit_of_small_and_large_hosts(spark):
    hosts = {"small": 100, "edge": 2000, "large": 2300}
    rows = []
    for host, texts in hosts.items():
        least = least_texts(texts)
        for i in range(texts):
            lines = [f"line at the limit of {host}"] * (i < least - 1) + [f"line above the limit of {host}"] * (i < least)
            rows.append((len(rows), "\n".join(lines + [" ".join(f"{host}{i}x{k}" for k in range(20))]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = [r["text"] for r in quality_rules.quality_filter(docs).collect()]
    assert len(left) == len(rows)
    for host, texts in hosts.items():
        assert sum(f"line at the limit of {host}" in t for t in left) == least_texts(texts) - 1
        assert not any(f"line above the limit of {host}" in t for t in left)
