"""The suffix join of token sets against brute force, with its comparisons counted."""

import numpy as np
import pytest

from namesake.operators import suffix_sets

LEFT = "l_item long, l_seq int, l_vec array<string>"
RIGHT = "r_item long, r_seq int, r_tie long, r_vec array<string>"


def brute(left, right, k, window):
    out = {}
    for li, ls, lv in left:
        hits = []
        for ri, rs, rt, rv in right:
            both = len(set(lv) & set(rv))
            if ls <= rs < ls + window and both:
                hits.append((-round(both / len(set(lv) | set(rv)), 9), rt, ri, rs))
        if hits:
            out[li, ls] = [(h[2], h[3]) for h in sorted(hits)[:k]]
    return out


def search(spark, left, right, k, window, **options):
    out = {}
    for r in suffix_sets.set_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), k, window, **options).orderBy("rank").collect():
        out.setdefault((r.l_item, r.l_seq), []).append((r.r_item, r.r_seq))
    return out


def rows(n, longest, tokens, seed, editions=5):
    """Skewed tokens; the two most frequent are in most sets, a third of all sets are equal."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        size = int(rng.integers(0, longest))
        own = {f"t{int(x)}" for x in rng.zipf(1.6, size) % tokens} | ({"a", "b"} if rng.random() < 0.7 else set())
        if i % 3 == 0:
            own = {"a", "b", "t1"}
        for s in sorted(set(rng.integers(0, editions, 2).tolist())):
            out.append((i, s, sorted(own)))
    return out


@pytest.mark.parametrize("longest,window", [(6, 3), (40, 1)])
def test_equals_brute_force(spark, longest, window):
    left = rows(160, longest, 30, 1)
    right = [(i, s, i * 10 + s, v) for i, s, v in rows(220, longest, 30, 2)]
    assert search(spark, left, right, 6, window) == brute(left, right, 6, window)


def test_unknown_tokens_and_few_hits(spark):
    left = [(1, 0, ["x", "y"]), (2, 0, []), (3, 0, ["a", "nowhere"]), (4, 0, ["nowhere"]), (5, 9, ["a"])]
    right = [(1, 0, 5, ["a"]), (2, 0, 4, ["a", "x"]), (3, 0, 3, []), (4, 0, 2, ["a", "z", "q"]), (5, 1, 1, ["a"])]
    assert search(spark, left, right, 9, 1) == brute(left, right, 9, 1)


def test_a_frequent_token_stays_cheap(spark):
    """All sets share a token and most only that: the pairs compared don't follow the square of the rows."""
    counts = []
    for n in (200, 800):
        right = [(i, 0, i, ["common", f"own{i}"]) for i in range(n)]
        left = [(i, 0, ["common", f"own{i}"]) for i in range(n)]
        compared = []
        assert search(spark, left, right, 4, 1, compared=compared) == brute(left, right, 4, 1)
        counts.append(sum(compared))
    assert counts[1] <= 4.5 * counts[0] and counts[1] < 800 * 5


def test_empty(spark):
    assert suffix_sets.set_join(spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT), 3).collect() == []


def test_index_holds_asked_tokens_alone(spark, monkeypatch):
    """Words that no left set has are in no row of the index, yet count in sizes and places."""
    left = [(i, 0, sorted({f"c{i}", f"c{i + 1}", "common"})) for i in range(4)]
    right = [(i, 0, i, sorted({f"c{i % 6}", "common", *[f"own{i}-{j}" for j in range(i % 9)]})) for i in range(40)]
    built = []
    index = suffix_sets._index
    monkeypatch.setattr(suffix_sets, "_index", lambda *a: built.append(index(*a)) or built[-1])
    got = suffix_sets.set_join(
        spark.createDataFrame(left, "l_item long, l_seq int, l_vec array<string>"),
        spark.createDataFrame(right, "r_item long, r_seq int, r_tie long, r_vec array<string>"), 3,
    )
    want = []
    for l, _, a in left:
        sims = sorted((-round(len(set(a) & set(b)) / len(set(a) | set(b)), 9), t, r) for r, _, t, b in right if set(a) & set(b))
        want += [(l, r, -s) for s, _, r in sims[:3]]
    assert sorted((r.l_item, r.r_item, r.sim) for r in got.collect()) == sorted(want)
    assert built[0].select("token").distinct().count() <= 6
