"""Break test and cluster splits."""

from functools import reduce
from itertools import combinations

import pytest

from namesake.operators import bisect, temporal
from namesake.spec import LinkageSpec

MEMBERS = "record_id long, cluster long, seq int, year double, gkey string"
EDGES = "src long, dst long, weight double"


def path_rows(n, missing, cluster=1):
    rows = [(i, cluster, i, 1800.0, None) for i in range(n)]
    edges = [(i, i + 1, 1.0) for i in range(n - 1) if i not in missing]
    return rows, edges


def counts(spark, rows, edges, **kw):
    m = spark.createDataFrame(rows, MEMBERS)
    e = spark.createDataFrame(edges, EDGES)
    return temporal.break_counts(m, e, "cluster", 20.0, **kw)


def test_break_ratio(spark):
    rows, edges = path_rows(6, {1, 3})
    r = counts(spark, rows, edges).first()
    assert (r["n_rows"], r["breaks"], r["ratio"]) == (6, 2, 2 / 6)
    assert counts(spark, rows, edges, denominator="pairs").first()["ratio"] == 2 / 5


def test_exact_key_closes_a_break(spark):
    rows = [(1, 9, 0, 1800.0, "k"), (2, 9, 1, 1819.75, "k"), (3, 9, 2, 1839.75, "k"), (4, 9, 3, 1840.0, "j")]
    r = counts(spark, rows, [(7, 8, 1.0)]).first()
    # 1-2 match; 2-3 are 20 years apart; 3-4 differ in key.
    assert (r["n_rows"], r["breaks"]) == (4, 2)


@pytest.mark.parametrize("size,breaks,leaf", [(21, 6, False), (20, 6, True), (30, 5, True), (15, 9, True)])
def test_leaf_rule(spark, size, breaks, leaf):
    rows, edges = path_rows(size, set(range(breaks)))
    got = counts(spark, rows, edges).select(temporal.is_leaf(LinkageSpec()).alias("leaf")).first()["leaf"]
    assert got is leaf


@pytest.mark.parametrize("grouped", [False, True])
def test_two_bridged_cliques(spark, grouped):
    """Interleaved cliques part at their bridge, listed or in grouped form."""
    sides = [range(0, 30, 2), range(1, 30, 2)]
    rows = [(i, 0, i, 1800.0 + i / 4, ("even" if i % 2 == 0 else "odd") if grouped else None) for i in range(30)]
    edges = [(0, 1, 0.6)]
    if not grouped:
        edges += [(a, b, 1.0) for s in sides for a, b in combinations(s, 2)]
    m = spark.createDataFrame(rows, MEMBERS)
    e = spark.createDataFrame(edges, EDGES)
    found = bisect.split_clusters(m, e, LinkageSpec(), restarts=3).collect()
    parts = {}
    for r in found:
        parts.setdefault(r["path"], set()).add(r["record_id"])
    assert sorted(map(sorted, parts.values())) == [list(s) for s in sides]
    assert all(p.startswith("0_") for p in parts)


def test_small_or_calm_clusters_stay(spark):
    a, ea = path_rows(10, {0, 2, 4, 6, 8}, cluster=1)
    b = [(100 + i, 2, i, 1800.0, "k") for i in range(40)]
    m = spark.createDataFrame(a + b, MEMBERS)
    found = bisect.split_clusters(m, spark.createDataFrame(ea, EDGES), LinkageSpec())
    assert {r["path"] for r in found.collect()} == {"1", "2"}
    assert found.count() == 50


def test_split_runs_to_its_end(spark):
    """No record would gain by moving to the other side, however long many move at once."""
    import random

    rng = random.Random(3)
    rows = [(i, 0, i, 1800.0 + i / 4, None) for i in range(60)]
    edges = [(a, b, 1.0) for a, b in combinations(range(60), 2) if rng.random() < (0.35 if a % 2 == b % 2 else 0.05)]
    nodes = spark.createDataFrame([(i, "0", None, s, y) for i, _, s, y, _ in rows], "record_id long, path string, gkey string, seq int, year double")
    near = {i: {b for a, b, _ in edges if a == i} | {a for a, b, _ in edges if b == i} for i in range(60)}
    total = 2 * len(edges)
    for shared in (0, 3, 10):
        found = bisect.bisect(nodes, spark.createDataFrame(edges, EDGES), 20.0, restarts=2, shared_steps=shared).collect()
        side = {r["record_id"]: r["side"] for r in found}

        def modularity(s):
            ones = sum(len(near[i]) for i in s if s[i])
            inner = sum(s[a] == s[b] for a, b, _ in edges) * 2
            return inner / total - (ones**2 + (total - ones) ** 2) / total**2

        q = modularity(side)
        assert q > 0.2
        assert all(modularity(side | {i: 1 - side[i]}) <= q + 1e-9 for i in range(60))


def test_steps_within_tasks_are_those_of_the_jobs(spark):
    """Records of several clusters, some with exact keys, get the same sides either way; large ones go by jobs beside small ones."""
    import random

    rng = random.Random(4)
    data, edges = [], []
    for path, n in (("a", 20), ("b", 14), ("c", 4)):
        base = len(data)
        data += [(base + i, path, f"k{i % 3}" if i % 4 else None, i, 1800.0 + i) for i in range(n)]
        edges += [(base + i, base + j, 1.0) for i, j in combinations(range(n), 2) if rng.random() < (0.4 if i % 2 == j % 2 else 0.05)]
    nodes = spark.createDataFrame(data, "record_id long, path string, gkey string, seq int, year double")
    e = spark.createDataFrame(edges, EDGES)
    found = [
        {(r.record_id, r.path): r.side for r in bisect.bisect(nodes, e, 20.0, restarts=2, ordered=True, in_task=some).collect()}
        for some in (0, 60, 100_000)
    ]
    assert len(found[0]) == 38 and {found[0][i, "a"] for i in range(20)} == {0, 1}
    assert found[0] == found[1] == found[2]


def test_draws_within_tasks_are_those_of_the_jobs(spark):
    import numpy as np
    from pyspark.sql import functions as F

    ids = [0, 1, -5, 77, 2**40 + 3, *range(100, 400)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    want = rows.select(bisect.drawn(F.lit(2), "id", F.lit(1007), F.lit(1)).alias("d")).collect()
    assert [r.d for r in want] == bisect.drawn_rows(2, np.array(ids), 1007, 1).tolist()


def test_levels_within_tasks_are_those_of_the_jobs(spark):
    """Paths are the same whether levels go by jobs, within tasks to the end, or a level at a time beside a large cluster."""
    import random

    rng = random.Random(9)
    rows, edges = [], []
    for cluster, n in ((0, 48), (100, 30), (200, 5)):
        rows += [(cluster + i, cluster, i, 1800.0 + i / 4, f"k{i % 5}" if i % 7 == 0 else None) for i in range(n)]
        edges += [(cluster + i, cluster + j, 1.0) for i, j in combinations(range(n), 2) if rng.random() < (0.5 if i % 4 == j % 4 else 0.04)]
    m = spark.createDataFrame(rows, MEMBERS)
    e = spark.createDataFrame(edges, EDGES)
    spec = LinkageSpec(min_size=6, max_breaks=2)
    found = [
        {(r.record_id, r.cluster): r.path for r in bisect.split_clusters(m, e, spec, restarts=2, **way).collect()}
        for way in ({"in_task": 0}, {}, {"in_task": 300, "levels": 1, "to_the_end": 10})
    ]
    assert len(found[0]) == 83 and max(p.count("_") for p in found[0].values()) >= 2
    assert found[0] == found[1] == found[2]


def test_coins_within_tasks_are_those_of_the_jobs(spark):
    import numpy as np
    from pyspark.sql import functions as F

    ids = [0, -5, 2**40 + 3, *range(100, 200)]
    rows = spark.createDataFrame([(i, "17_0_1_0_1_1_0_0_1_1_0_1_0_0_0_1_1") for i in ids], "id long, path string")
    want = rows.select(bisect._coin("id", "path", F.lit(7)).alias("a"), bisect._coin("id", "path", F.lit(8)).alias("b")).collect()
    got = bisect.coin_rows(bisect._hash_longs(np.array(ids)), rows.first()["path"], range(7, 9))
    assert [list(r) for r in want] == got.tolist()


def test_clusters_of_the_size_met_at_six_gigabytes_stay_within_tasks(spark, monkeypatch):
    """A cluster of 600,000 records and arcs takes no job a step, and small clusters go to no task."""
    from pyspark.sql import functions as F

    def no_jobs(*args):
        raise AssertionError("a step of its own job")

    monkeypatch.setattr(bisect, "_bisect_by_jobs", no_jobs)
    n, block = 120_000, 1000
    members = spark.range(n + 60).select(
        F.col("id").alias("record_id"), F.when(F.col("id") < n, 0).otherwise(n + F.floor((F.col("id") - n) / 3)).cast("long").alias("cluster"),
        (F.col("id") * 7919 % 50).cast("int").alias("seq"), F.lit(1800.0).alias("year"), F.lit(None).cast("string").alias("gkey"),
    )
    at, step = F.col("id") % block, F.col("id") - F.col("id") % block
    edges = reduce(
        lambda a, b: a.unionByName(b),
        [spark.range(n).select(F.col("id").alias("src"), (step + (at + k) % block).alias("dst"), F.lit(1.0).alias("weight")).filter("src < dst") for k in (1, 37)]
    )
    across = spark.range(0, n - block, block).select(F.col("id").alias("src"), (F.col("id") + block).alias("dst"), F.lit(1.0).alias("weight"))
    got = bisect.split_clusters(members, edges.unionByName(across), LinkageSpec(), restarts=2)
    paths = {r.record_id: r.path for r in got.collect()}
    assert len(paths) == n + 60
    assert all(paths[i] == str(n + (i - n) // 3) for i in range(n, n + 60))
    assert all(paths[i].startswith("0_") for i in range(n))
