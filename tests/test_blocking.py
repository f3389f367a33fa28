"""Blocking and features against brute force, with one name on a third of the rows."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.operators import blocking, features
from namesake.plans.preparation import describe_values
from namesake.operators.tokens import symbol_tokens
from namesake.session import cut
from namesake.spec import LinkageSpec

SPEC = LinkageSpec(
    match_cols=("xing", "ming", "town"), block_cols=("xing", "ming"), guarantee_cols=("xing", "ming", "town"), window=3, top_k=4
)
XING = ["wang", "li", "zhao", "?", "（a+b）"]
MING = ["ming", "ying", "?", "de", "z", "gong zu", "（m+i）n"]


def rows():
    rng = random.Random(8)
    out = []
    for i in range(150):
        if i % 3 == 0:
            name = ("wang", "ming")
        else:
            name = (rng.choice(XING), rng.choice(MING))
        out.append((i, rng.randint(0, 7), 1800.0 + rng.randint(0, 3), *name, rng.choice(["x", "y", "? ?"])))
    return out


def symbols(v):
    if "（" in v and "）" in v:
        a, b = v.index("（"), v.index("）")
        return list(v[:a]) + [v[a + 1:b].replace("+", "")] + list(v[b + 1:])
    return list(v)


def grams(symbol):
    units = []
    for c in symbol:
        units += ["?"] if c in "？? " else [c, c]
    seq = ["*", *units, "*"]
    return ["".join(seq[i:i + 3]) for i in range(len(seq) - 2)]


def gram_vec(g):
    rng = np.random.default_rng(sum(ord(c) * 131**i for i, c in enumerate(g)) % 2**32)
    return rng.normal(size=6)


def mean_vec(syms):
    return np.mean([np.mean([gram_vec(g) for g in grams(s)], axis=0) for s in syms], axis=0)


def cosine(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def phon(v):
    return {("?" if c in "？? " else c) for s in symbols(v) for c in s}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def prepared(spark):
    df = cut(spark.createDataFrame(rows(), "record_id long, edition_seq int, year double, xing string, ming string, town string"))
    known = symbol_tokens(features.feature_values(df, SPEC)).select(F.explode("grams").alias("g")).distinct().collect()
    vecs = spark.createDataFrame([(r["g"], gram_vec(r["g"]).tolist()) for r in known], "gram string, vec array<double>")
    return df, describe_values(df, SPEC, vecs)


def brute(data, buffered):
    out = set()
    k = SPEC.top_k
    for l in data:
        for method in ("shape", "phon"):
            scored = []
            for r in data:
                if not l[1] <= r[1] < l[1] + SPEC.window:
                    continue
                if method == "shape":
                    s = cosine(mean_vec(symbols(l[3]) + symbols(l[4])), mean_vec(symbols(r[3]) + symbols(r[4])))
                else:
                    s = jac(phon(l[3]) | phon(l[4]), phon(r[3]) | phon(r[4]))
                    if s == 0:
                        continue
                scored.append((-round(s, 9), r[0], r[3:] == l[3:]))
            scored.sort()
            if buffered:
                scored = scored[: 2 * k]
            out |= {(l[0], r) for _, r, exact in [x for x in scored if not x[2]][:k]}
    return out


@pytest.mark.parametrize("buffered,strategy", [(True, "blocks"), (True, "subsets"), (False, "subsets")])
def test_candidates(spark, prepared, buffered, strategy):
    df, v = prepared
    spec = replace(SPEC, buffered=buffered)
    found = blocking.block(df, spec, v.block_vectors, v.block_tokens, strategy=strategy).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == brute(rows(), buffered)
    per_left = {}
    for r in found:
        per_left[r["left_id"]] = per_left.get(r["left_id"], 0) + 1
    assert max(per_left.values()) <= 2 * SPEC.top_k


def test_left_editions(spark, prepared):
    df, v = prepared
    some = spark.createDataFrame([(0,), (4,)], "edition_seq int")
    found = blocking.block(df, SPEC, v.block_vectors, v.block_tokens, some)
    lefts = {r[0] for r in rows() if r[1] in (0, 4)}
    assert {(r["left_id"], r["right_id"]) for r in found.collect()} == {p for p in brute(rows(), True) if p[0] in lefts}


def test_features(spark, prepared):
    df, v = prepared
    pairs = spark.createDataFrame([(i, (i * 7 + 1) % 150) for i in range(150)], "left_id long, right_id long")
    found = features.pair_features(pairs, df, SPEC, v.vectors, v.tokens).collect()
    assert len(found) == 150
    data = {r[0]: r for r in rows()}
    import re
    gone = re.compile(r"^(\?\s?)+$").match
    for r in found:
        a, b = data[r["left_id"]], data[r["right_id"]]
        for i, c in enumerate(SPEC.match_cols, start=3):
            if gone(a[i]) or gone(b[i]):
                expected = (-1.0, -1.0)
            else:
                expected = (cosine(mean_vec(symbols(a[i])), mean_vec(symbols(b[i]))), jac(phon(a[i]), phon(b[i])))
            assert math.isclose(r[f"{c}_stroke"], expected[0], abs_tol=1e-9)
            assert math.isclose(r[f"{c}_pinyin"], expected[1], abs_tol=1e-9)
        assert r["ming_cnt_diff"] == abs(len(a[4]) - len(b[4]))
        sa, sb = symbols(a[4]), symbols(b[4])
        for i in (0, 1):
            if min(len(sa), len(sb)) <= i or "*?*" in (grams(sa[i])[0], grams(sb[i])[0]):
                expected = -1.0
            else:
                expected = cosine(mean_vec([sa[i]]), mean_vec([sb[i]]))
            assert math.isclose(r[f"ming_sim{i + 1}"], expected, abs_tol=1e-9), (a, b, i)
        assert r["same_year"] == float(a[2] == b[2])


def test_features_look_at_patterns_once_for_each_record(spark, prepared, capsys):
    df, v = prepared
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "left_id long, right_id long")
    features.pair_features(pairs, df, SPEC, v.vectors, v.tokens).explain("extended")
    plan = capsys.readouterr().out
    assert "Physical Plan" in plan and "RLIKE" not in plan and "split(" not in plan


def test_features_by_sent_and_by_joined_scores(spark, prepared, monkeypatch, capsys):
    """Scores of few value pairs need no shuffle of the record pairs; both ways give the same rows."""
    df, v = prepared
    pairs = spark.createDataFrame([(i, (i * k + 1) % 150) for i in range(150) for k in (0, 3, 7)], "left_id long, right_id long")
    got = []
    for most in (features.SENT, -1):
        monkeypatch.setattr(features, "SENT", most)
        found = features.pair_features(pairs, df, SPEC, v.vectors, v.tokens)
        found.explain()
        got.append((sorted(map(str, found.collect())), "hashpartitioning" in capsys.readouterr().out))
    assert got[0][0] == got[1][0] and len(got[0][0]) == 450
    assert [shuffled for _, shuffled in got] == [False, True]


def test_records_are_not_sent_to_every_task(spark, prepared, capsys):
    """Pairs are made where the records lie: the join of records with the lists of their group is sorted."""
    df, v = prepared
    blocking.block(df, SPEC, v.block_vectors, v.block_tokens).explain()
    plan = capsys.readouterr().out
    assert [line for line in plan.splitlines() if "Join" in line][0].count("SortMergeJoin") == 1


def test_features_of_odd_values(spark, prepared):
    """Nulls, missing markers, empty values and empty brackets, each with itself and with a name."""
    _, v = prepared
    values = [None, "", "?", "？", "? ?", "（）", "王"]
    data = [(i, 0, 1800.0, "王", value, "x") for i, value in enumerate(values)]
    df = spark.createDataFrame(data, "record_id long, edition_seq int, year double, xing string, ming string, town string")
    pairs = spark.createDataFrame([(i, j) for i in range(7) for j in (i, 6)][:-1], "left_id long, right_id long")
    found = {(r.left_id, r.right_id): r for r in features.pair_features(pairs, df, SPEC, v.vectors, v.tokens).collect()}
    same = [(found[i, i].ming_stroke, found[i, i].ming_sim1) for i in range(7)]
    # An empty value has no symbol; the full-width mark is a value, but no known symbol.
    assert same == [(-1.0, -1.0), (0.0, -1.0), (-1.0, -1.0), (1.0, -1.0), (-1.0, -1.0), (1.0, 1.0), (1.0, 1.0)]
    assert [found[i, 6].ming_stroke for i in (0, 2, 4)] == [-1.0] * 3 and found[0, 6].ming_cnt_diff is None


def test_char_repr_mode(spark, prepared):
    df, v = prepared
    pairs = spark.createDataFrame([(1, 2)], "a string, b string").select(F.lit("de").alias("a"), F.lit("ying").alias("b"))
    got = features.value_pair_scores(pairs, v.vectors, v.tokens, "char_repr").first()["phon"]
    assert math.isclose(got, jac(set("['d' 'e']"), set("['y' 'i' 'n' 'g']")))


def test_unbuffered_needs_block_columns_in_the_key(spark, prepared):
    df, v = prepared
    with pytest.raises(ValueError):
        blocking.block(df, replace(SPEC, buffered=False, guarantee_cols=("town",)), v.block_vectors, v.block_tokens)
