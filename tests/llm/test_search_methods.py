"""The searches of packing and SimHash against exact ones."""

import random
from functools import lru_cache

import pytest

from amity.llm import packing, simhash


def least_bins(pieces, capacity):
    """Exact bin packing: the fewest sequences, by sets of pieces."""
    n = len(pieces)

    @lru_cache(None)
    def best(done):     # (sequences, fill of the last one) in the best order
        if not done:
            return 0, capacity
        found = (n + 1, 0)
        for i in range(n):
            if done >> i & 1:
                bins, fill = best(done & ~(1 << i))
                found = min(found, (bins, fill + pieces[i]) if fill + pieces[i] <= capacity else (bins + 1, pieces[i]))
        return found
    return best((1 << n) - 1)[0]


def test_packing_equals_an_exact_solver():
    rng, worse = random.Random(2), 0
    for _ in range(100):
        capacity = rng.choice([30, 60, 100])
        pieces = [rng.randint(capacity // 6, capacity // 2) for _ in range(rng.randint(8, 13))]
        counts = {s: pieces.count(s) for s in pieces}
        plan = packing.complete_bins(counts, capacity)
        used = {}
        for filling, times in plan:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                used[s] = used.get(s, 0) + k * times
        assert used == counts
        exact = least_bins(tuple(sorted(pieces)), capacity)
        assert sum(n for _, n in plan) == exact
        worse += sum(n for _, n in packing.best_fit(counts, capacity)) > exact
    assert worse >= 5      # best-fit decreasing alone is not enough


@pytest.mark.parametrize("low,high", [(410, 700), (200, 1500), (500, 1000)])
def test_a_node_is_empty_only_by_the_waste_bound(low, high):
    rng = random.Random(low)
    for _ in range(20):
        pieces = [rng.randint(low, high) for _ in range(300)]
        counts = {s: pieces.count(s) for s in pieces}
        largest, waste = max(counts), rng.choice([0, 3, 40])
        got = packing.fillings(counts, largest, 2048, waste, 8)
        sums = packing._reachable(sorted(counts, reverse=True),
                                  [counts[s] - (s == largest) for s in sorted(counts, reverse=True)], 2048 - largest)[0]
        assert bool(got) == any(sums >> (2048 - largest - w) & 1 for w in range(min(waste, 2048 - largest) + 1))
        left = [2048 - largest - sum(items) for items in got]
        assert left == sorted(left) and all(0 <= x <= waste for x in left)
        for items in got:
            assert all(items.count(s) + (s == largest) <= counts[s] for s in items)


@pytest.mark.parametrize("max_bits,hot", [(2, 500), (2, 3), (3, 500), (3, 3), (1, 3), (0, 1)])
def test_links_equal_all_pairs(spark, max_bits, hot):
    """Fingerprints with a segment that many share, pairs on every distance, and
    the values that are all zeros or ones."""
    rng = random.Random(max_bits)
    flip = lambda x, k: x ^ sum(1 << i for i in rng.sample(range(64), k))
    prints = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(40)}
    shared = rng.getrandbits(32)
    prints |= {shared << 32 | rng.getrandbits(32) for _ in range(30)} | {rng.getrandbits(32) << 32 | shared for _ in range(30)}
    prints |= {flip(x, rng.randint(1, 5)) for x in sorted(prints) for _ in range(4)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = [tuple(r) for r in simhash.links(frame, max_bits, hot).collect()]
    want = {(a, b) for a in map(signed, prints) for b in map(signed, prints)
            if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= max_bits}
    assert len(got) == len(set(got)) and set(got) == want
    assert simhash.links(frame.limit(0), max_bits).collect() == []
    with pytest.raises(ValueError):
        simhash.links(frame, 4)
