"""Top-k joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.operators import nearest, nearest_sets

WINDOW, K = 4, 7


def brute(left, right, sim, k, window, positive):
    out = {}
    for li, ls, lv in left:
        hits = []
        for ri, rs, rt, rv in right:
            if ls <= rs < ls + window:
                s = round(sim(lv, rv), 9)
                if s > 0 or not positive:
                    hits.append((-s, rt, ri, rs))
        out[li, ls] = [(ri, rs) for _, _, ri, rs in sorted(hits)[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r["l_item"], r["l_seq"]), []).append((r["r_item"], r["r_seq"]))
    return out


def same(found, expected):
    assert {k: v for k, v in expected.items() if v} == found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = centres[rng.integers(0, 6, 300)] + 0.15 * rng.normal(size=(300, 8))
    # A third of the rows are copies of one vector.
    rows[:100] = rows[0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    seqs = rng.integers(0, 12, 300)
    return [(i, int(s), [float(x) for x in v]) for i, (s, v) in enumerate(zip(seqs, rows))]


@pytest.mark.parametrize("pivots", [1, 5, 40])
def test_cosine(spark, vectors, pivots, monkeypatch):
    monkeypatch.setitem(nearest.BLOCKS, "cosine", (50, 40))
    monkeypatch.setattr(nearest, "MIN_BLOCK", 40)
    left = spark.createDataFrame(vectors, "l_item long, l_seq int, l_vec array<double>")
    right = spark.createDataFrame([(i, s, i, v) for i, s, v in vectors], "r_item long, r_seq int, r_tie long, r_vec array<double>")
    found = got(nearest.nearest_join(left, right, K, "cosine", WINDOW, pivots))
    expected = brute(vectors, [(i, s, i, v) for i, s, v in vectors], lambda a, b: float(np.dot(a, b)), K, WINDOW, False)
    same(found, expected)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnop")
    rows = []
    for i in range(240):
        size = int(rng.integers(1, 12))
        picked = set(rng.choice(letters, size, replace=False))
        if i % 3 == 0:
            picked = set("ab") | set(list(picked)[:1])
        rows.append((i, int(rng.integers(0, 10)), sorted(picked)))
    return rows


def jac(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


@pytest.mark.parametrize("strategy,max_tokens", [("blocks", 8), ("subsets", 8), ("subsets", 5), ("auto", 8)])
def test_jaccard(spark, sets, strategy, max_tokens):
    left = spark.createDataFrame(sets, "l_item long, l_seq int, l_vec array<string>")
    right = spark.createDataFrame([(i, s, i, v) for i, s, v in sets], "r_item long, r_seq int, r_tie long, r_vec array<string>")
    found = got(nearest_sets.nearest_sets(left, right, K, WINDOW, strategy, max_tokens))
    same(found, brute(sets, [(i, s, i, v) for i, s, v in sets], jac, K, WINDOW, True))


def test_jaccard_pivots(spark, sets):
    left = spark.createDataFrame(sets, "l_item long, l_seq int, l_vec array<string>")
    right = spark.createDataFrame([(i, s, i, v) for i, s, v in sets], "r_item long, r_seq int, r_tie long, r_vec array<string>")
    found = got(nearest.nearest_join(left, right, K, "jaccard", WINDOW, 9))
    same(found, brute(sets, [(i, s, i, v) for i, s, v in sets], jac, K, WINDOW, True))
