"""The metric tree join against brute force, with its comparisons counted."""

import numpy as np
import pytest

from namesake.operators import metric_tree

LEFT = "l_item long, l_seq int, l_vec array<double>"
RIGHT = "r_item long, r_seq int, r_tie long, r_vec array<double>"


def brute(rows, k, window):
    """rows: (item, seq, vec) on both sides."""
    vecs = {i: np.array(v) for i, _, v in rows}
    out = {}
    for li, ls, _ in rows:
        hits = sorted((-round(float(vecs[li] @ vecs[ri]), 9), ri * 100 + rs, ri, rs) for ri, rs, _ in rows if ls <= rs < ls + window)
        out[li, ls] = [(h[2], h[3]) for h in hits[:k]]
    return out


def search(spark, rows, k, window, **sizes):
    left = spark.createDataFrame(rows, LEFT)
    right = spark.createDataFrame([(i, s, i * 100 + s, v) for i, s, v in rows], RIGHT)
    out = {}
    for r in metric_tree.tree_join(left, right, k, window, **sizes).orderBy("rank").collect():
        out.setdefault((r.l_item, r.l_seq), []).append((r.r_item, r.r_seq))
    return out


def clustered(n, centres, spread, copies, seed, editions=6, dims=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    v = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    v[:copies] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        for s in sorted(set(rng.integers(0, editions, 2).tolist())):
            rows.append((i, s, v[i].tolist()))
    return rows


def same(found, want):
    assert found == {q: h for q, h in want.items() if h}


@pytest.mark.parametrize("window", [1, 3])
def test_equals_brute_force(spark, window, monkeypatch):
    """A third of the items equal, blocks smaller than nodes, several levels."""
    monkeypatch.setattr(metric_tree, "LEFT_BLOCK", 40)
    monkeypatch.setattr(metric_tree, "RIGHT_BLOCK", 30)
    rows = clustered(240, 9, 0.2, 80, 1)
    same(search(spark, rows, 5, window, fan=4, leaf=12), brute(rows, 5, window))


def test_comparisons_stay_few(spark):
    """Many tight groups: each item is compared with few others, and that share falls as the table grows."""
    shares = []
    for n in (400, 1600):
        rows = [(i, 0, v) for i, _, v in clustered(n, n // 20, 0.02, 0, 2, editions=1)]
        compared = []
        same(search(spark, rows, 5, 1, fan=8, leaf=32, compared=compared), brute(rows, 5, 1))
        shares.append(sum(compared) / n**2)
    assert shares[1] < 0.25 and shares[1] < shares[0]


def test_rare_editions(spark):
    """Editions with fewer items than asked for are searched to their end."""
    rows = clustered(150, 6, 0.3, 0, 3) + [(900, 60, [1.0] + [0.0] * 7), (901, 63, [0.0, 1.0] + [0.0] * 6)]
    same(search(spark, rows, 4, 2, fan=5, leaf=10), brute(rows, 4, 2))


def test_empty(spark):
    assert metric_tree.tree_join(spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT), 3).collect() == []


@pytest.mark.parametrize("window", [1, 3])
def test_spread_evenly(spark, window, monkeypatch):
    """No bound rules anything out: all are compared once, in blocks beyond the leaves, and none is visited by turns."""
    monkeypatch.setattr(metric_tree, "DENSE_LEFT", 50)
    monkeypatch.setattr(metric_tree, "DENSE_RIGHT", 70)
    monkeypatch.setattr(metric_tree, "CHUNK", 16)
    rows = clustered(200, 200, 1.0, 40, 5, dims=32)
    compared = []
    same(search(spark, rows, 5, window, fan=4, leaf=12, compared=compared), brute(rows, 5, window))
    assert len(compared) == 2 and compared[1] == 200 * 200
