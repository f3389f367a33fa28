"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from namesake.llm import convtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    for c in by:
        by[c] = [(r, x) for _, _, r, x in sorted(by[c])]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(int)
    for c in list(by):
        h = zlib.crc32(str(c).encode()) % 9
        # The remainder takes the sign of the id, as in SQL.
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        turns = by.get(first, [])[:h] + by[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        s = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += s
    text = lambda k: ",".join(map(str, sorted(ends[k]))).encode()
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k] if k in kids else 0, leaves[k], saved[k], hashlib.sha256(text(k)).hexdigest())
            for k, m in members.items()
        ),
        key=str,
    )


def talk(seed, convs, most, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["u", "u", "u", "a"]), r.choice(words)) for c in range(convs) for t in range(r.randint(0, most))]


def check(spark, rows, **sizes):
    got = convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_split_by_jobs(spark):
    """Bounds so small that components are parted by joins and groups run through blocks."""
    check(spark, talk(1, 80, 9, ["x", "yé", ""]), bound=12, block=16, chunk=3)


def test_deep_and_hot(spark):
    """One conversation with most of the rows, and one first turn shared by all others."""
    rows = [(5, t, "u", str(t)) for t in range(240)] + [(7 * k + 1, t, "u", "same" if t == 0 else str(k % 3)) for k in range(40) for t in range(3)]
    check(spark, rows, bound=30, block=20, chunk=4)


def test_odd_rows(spark):
    rows = [
        (3, None, None, None), (3, None, None, None), (3, 1, "u", "x"), (3, 1, "u", "x"), (None, 1, "a", "lost"), (7, 2, "ab", "c"), (7, 2, "a", "bc"),
        (-7, 1, "u", "long " * 20_000), (10, 0, "u", "x"), (11, 0, "u", "x"), (14, 0, "u", "x"),
    ]
    check(spark, rows)
    extra = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", rep long, depth int, `a.b` string")
    assert sorted((tuple(r) for r in convtrie.prefix_trie(extra).collect()), key=str) == plain(rows)


def test_empty(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_local_decomposition():
    """Random forests: the totals of the in-task part equal sums over subtrees."""
    r = random.Random(2)
    for n in (1, 2, 3, 40, 400):
        parent = [-1] + [r.randrange(max(0, i - 5), i) for i in range(1, n)]
        own, value = [r.randint(1, 3) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        weight, want = list(own), list(value)
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
        got = [0] * n
        convtrie._part(list(range(n)), parent, weight, [value], [got])
        assert got == want


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables absent")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(queries.ORACLES["op11_conversation_trie"])
    columns = [d[0] for d in cursor.description]
    got = queries.op11_conversation_trie(spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)
