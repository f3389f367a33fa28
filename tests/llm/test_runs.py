"""Runs against a search of every period, and suffix trees against plain comparison."""

import hashlib
import random
import re
import zlib

import numpy as np

from namesake.llm import queries, runs
from namesake.llm.suffixtree import SuffixTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least_words=6, least_periods=4):
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i if j > i else 0
            if length >= max(least_words, least_periods * q):
                part = words[i : i + length]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r):
    k, n = r.choice([1, 2, 2, 3, 5]), r.randint(0, 60)
    w = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), 1 + r.randrange(n // 5 + 1)
        for i in range(a + p, n):
            w[i] = w[a + (i - a) % p]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(n)] = r.randrange(k + 3)
    return w


def test_runs():
    r, found = random.Random(1), 0
    for _ in range(2500):
        words = random_words(r)
        want = slow_runs(words)
        assert [tuple(x) for x in runs.runs_of_words(words).tolist()] == want
        found += len(want)
    assert found > 1000


def test_other_limits():
    r = random.Random(2)
    for _ in range(500):
        words = random_words(r)
        assert [tuple(x) for x in runs.runs_of_words(words, 3, 2).tolist()] == slow_runs(words, 3, 2)


def test_suffix_tree():
    r = random.Random(3)
    for n in (1, 2, 7, 60, 300):
        s = [r.randrange(3) for _ in range(n)]
        tree = SuffixTree(s)
        order = sorted(range(n + 1), key=lambda i: s[i:])
        assert [int(tree.rank[i]) for i in order] == list(range(n + 1))
        falling = sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])
        assert tree.tour(falling=True)[0] == falling
        a, b = np.array([(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, n)]).T
        for i, j, c in zip(a.tolist(), b.tolist(), tree.common(a, b).tolist()):
            same = 0
            while j + same < n and s[i + same] == s[j + same]:
                same += 1
            assert c == same


def test_only_what_may_repeat_enters_the_trees():
    words = [f"w{i}" for i in range(500)] + ["a", "b"] * 6 + [f"v{i}" for i in range(500)] + ["the"] * 3
    codes = np.unique(words, return_inverse=True)[1]
    assert runs.repetitive(codes, 6, 4).tolist() == list(range(500, 512))
    assert runs.runs_of_words(words).tolist() == [[500, 12, 2]]


def test_kept_words():
    words = ["x"] + ["a", "b"] * 5 + ["y"]
    found = runs.runs_of_words(words)
    assert found.tolist() == [[1, 10, 2]]
    assert [w for w, k in zip(words, runs.kept_words(len(words), found)) if k] == ["x", "a", "b", "y"]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        str(doc_id), len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query(spark, odd, odd_rows, tmp_path):
    r = random.Random(6)
    rows = [x[:2] for x in odd_rows if x[1] is None or len(x[1]) < 5000]
    for i in range(100, 400):
        words = [str(w) for w in random_words(r)] if i % 3 else [f"w{r.randrange(300)}" for _ in range(r.randint(1, 120))]
        rows.append((i, " \t".join(words) if i % 7 == 0 else " \n".join(words)))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, runs int, _words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_runs(spark, str(tmp_path)).collect()
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(((str(x.doc_id), *[x[c] for c in columns]) for x in got), key=str) == sorted((expected(*x) for x in rows), key=str)


def test_tables(spark, odd, odd_rows, none):
    got = runs.find_runs(odd, keep=("doc_id", "size"))
    assert got.columns == ["doc_id", "size", "n_words", "runs", "collapsed"]
    sizes = {(str(r[0]), len(WORD.findall(r[1] or ""))) for r in odd_rows}
    assert {(str(x.doc_id), x.n_words) for x in got.collect()} == sizes and got.count() == len(odd_rows)
    assert runs.find_runs(none).collect() == []
    long = spark.createDataFrame([(1, "a b c " * 40_000)], "doc_id long, text string")
    (row,) = runs.find_runs(long).collect()
    assert [tuple(x) for x in row.runs] == [(0, 120_000, 3)] and row.collapsed == "a b c"
