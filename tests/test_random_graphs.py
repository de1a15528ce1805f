"""Random rosters (self-loops, duplicate rows, asymmetric edges, null ids)
against a plain-Python restatement of the per-caller steps: one-hop, raw and
strict two-hop, common-friend counts (first-call definition and cached
domain) and relation types, for every caller at once."""

import random

import pytest
from conftest import rows

from amity.operators import common_friends as cf
from amity.operators import relations as rel
from amity.operators import roster as ro

SCHEMA = "rosterID bigint, username string, loginAccount string, userID bigint"


def random_roster(seed, n_accounts=14, n_rows=70):
    rnd = random.Random(seed)
    names = [f"acc{i:02d}" for i in range(n_accounts)]
    uid = {n: (None if rnd.random() < 0.1 else 100 + i) for i, n in enumerate(names)}
    data = []
    for k in range(n_rows):
        u = rnd.choice(names)
        la = u if rnd.random() < 0.05 else rnd.choice(names)
        data.append((k, u, la, uid[la]))
    data += data[:5]  # duplicate rows
    return names, data


def brute(data, names):
    out = {}
    raw = {(u, la) for _, u, la, _ in data}
    for me in names:
        one = {la for u, la in raw if u == me and u != la}
        las = {la for u, la in raw if u == me and la != me}
        two_raw = {la for u, la in raw if u in one}
        two = {la for u, la in raw if u != la and la != me and u in las and la not in las}
        reach = las | two

        def common(c):
            theirs = {la for u, la in raw if u == c and la != me and u != la}
            mine = {la for u, la in raw if u == me}
            return len(theirs & mine)

        ids1 = {i for _, u, la, i in data if u == me and la != me and i is not None}
        ids2 = {i for _, u, la, i in data
                if u != la and la != me and u in las and la not in las and i is not None} - ids1
        out[me] = dict(one=one, two_raw=two_raw, two=two, reach=reach,
                       counts={c: common(c) for c in names + ["nobody"]},
                       table={c: common(c) for c in reach if common(c) > 0},
                       rel={str(i): 1 for i in ids1} | {str(i): 2 for i in ids2})
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_roster(spark, seed):
    names, data = random_roster(seed)
    r = spark.createDataFrame(data, SCHEMA)
    g = ro.FriendGraph.of(r)
    expect = brute(data, names)
    callers = spark.createDataFrame([(n,) for n in names], "caller string")

    def by_caller(df, *cols):
        got = {}
        for t in rows(df, "caller", *cols):
            got.setdefault(t[0], set()).add(t[1:] if len(t) > 2 else t[1])
        return got

    one = by_caller(ro.one_hop(g, callers), "loginAccount")
    two_raw = by_caller(ro.two_hop_raw(g, callers), "loginAccount")
    two = by_caller(ro.two_hop_strict(g, callers), "loginAccount")
    reach = by_caller(ro.reachable_within_two(g, None), "loginAccount")
    table = by_caller(cf.common_friend_table(g, None), "userName", "comFriendsNum")
    relation = by_caller(rel.relation_table_many(g, callers), "userID", "friendType")
    reqs = spark.createDataFrame(
        [(me, i, c) for me in names for i, c in enumerate(names + ["nobody"])],
        "caller string, pos int, candidate string")
    counts = {}
    for c, p, cand, n in rows(cf.common_friend_count_many(g, reqs)):
        counts.setdefault(c, {})[cand] = n
    for me in names:
        e = expect[me]
        assert one.get(me, set()) == e["one"], me
        assert two_raw.get(me, set()) == e["two_raw"], me
        assert two.get(me, set()) == e["two"], me
        assert reach.get(me, set()) == e["reach"], me
        assert table.get(me, set()) == set(e["table"].items()), me
        assert relation.get(me, set()) == set(e["rel"].items()), me
        assert counts[me] == e["counts"], me
    # single-caller forms agree with the batch forms
    me = names[0]
    assert {t[0] for t in rows(ro.friends_two_hop_strict(g, me))} == expect[me]["two"]
    cands = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "pos int, username string")
    assert {(t[1], t[2]) for t in rows(cf.common_friend_count(g, me, cands))} == \
        {(c, expect[me]["counts"][c]) for c in names}
