"""Gram vectors against the dense factorisation of the same matrix."""

import math
import random

import numpy as np

from namesake.operators import factor

SYMBOLS = "grams array<string>"


def dense(rows, window):
    counts = {}
    for grams in rows:
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if 0 < abs(i - j) <= window:
                    counts[a, b] = counts.get((a, b), 0) + window + 1 - abs(i - j)
    names = sorted({g for r in rows for g in r})
    at = {g: k for k, g in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for (a, b), c in counts.items():
        n[at[a], at[b]] = c
    margin = n.sum(axis=1)
    m = np.zeros_like(n)
    for (a, b), c in counts.items():
        m[at[a], at[b]] = max(0.0, math.log(c * n.sum() / (margin[at[a]] * margin[at[b]])))
    return names, m


def test_against_dense_factors(spark):
    """With room for all of it, products of vectors give the positive part of the matrix back."""
    r = random.Random(1)
    rows = [[f"g{r.randrange(9)}" for _ in range(r.randint(1, 8))] for _ in range(40)] + [["alone"]]
    names, m = dense(rows, 5)
    found = {x.gram: np.array(x.vec) for x in factor.factor_gram_vectors(spark.createDataFrame([(g,) for g in rows], SYMBOLS), 12, rounds=2).collect()}
    assert sorted(found) == names and not found["alone"].any()
    v = np.array([found[g] for g in names])
    values, vectors = np.linalg.eigh(m)
    positive = (vectors * np.maximum(values, 0)) @ vectors.T
    assert np.abs(v @ v.T - positive).max() < 1e-4


def test_neighbours_and_repeats(spark):
    """Grams that share their surroundings are alike; a second run gives the same vectors."""
    r = random.Random(2)
    rows = [[r.choice("abcd") if i % 2 else r.choice("wxyz") for i in range(8)] if k % 2 else [r.choice("1234") if i % 2 else r.choice("6789") for i in range(8)] for k in range(300)]
    df = spark.createDataFrame([(g,) for g in rows], SYMBOLS).repartition(5)
    runs = [sorted((x.gram, tuple(x.vec)) for x in factor.factor_gram_vectors(df, 4).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    vec = {g: np.array(v) / (np.linalg.norm(v) or 1) for g, v in runs[0]}
    assert min(vec["a"] @ vec["b"], vec["1"] @ vec["4"]) > vec["a"] @ vec["1"] + 0.3


def test_empty(spark):
    assert factor.factor_gram_vectors(spark.createDataFrame([], SYMBOLS), 3).collect() == []
