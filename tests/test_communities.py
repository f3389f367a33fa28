"""Communities on planted graphs, and that no record gains by moving."""

import random
from itertools import combinations

import pytest

from namesake.operators import communities

NODES, EDGES = "record_id long, path string", "src long, dst long, weight double"


def modularity(edges, comm):
    total = 2 * sum(w for _, _, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    sums = {}
    for n, d in degree.items():
        sums[comm[n]] = sums.get(comm[n], 0) + d
    return 2 * sum(w for a, b, w in edges if comm[a] == comm[b]) / total - sum(s * s for s in sums.values()) / total**2


def found(spark, nodes, edges):
    rows = communities.communities(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()
    assert sorted((r.record_id, r.path) for r in rows) == sorted(nodes)
    comm = {r.record_id: r.community for r in rows}
    assert all(comm[c] == c and c == min(n for n in comm if comm[n] == c) for c in set(comm.values()))
    return comm


@pytest.mark.parametrize("seed", [1, 2])
def test_no_record_gains_by_moving(spark, seed):
    r = random.Random(seed)
    n = 48
    edges = [(a, b, round(r.random(), 3) + 0.01) for a, b in combinations(range(n), 2) if r.random() < (0.5 if a % 4 == b % 4 else 0.06)]
    comm = found(spark, [(i, "p") for i in range(n)], edges)
    q = modularity(edges, comm)
    assert q >= modularity(edges, {i: i % 4 for i in range(n)}) - 0.02 and len(set(comm.values())) > 2
    for i in range(n):
        for c in {*comm.values(), -1}:
            assert modularity(edges, comm | {i: c}) <= q + 1e-8


def test_cliques_on_a_ring(spark):
    """Ten cliques on a ring in one cluster, and two bridged ones in another; no edge counts between clusters."""
    edges = [(c * 6 + a, c * 6 + b, 1.0) for c in range(10) for a, b in combinations(range(6), 2)]
    edges += [(c * 6, (c * 6 + 7) % 60, 0.5) for c in range(10)]
    edges += [(100 + c * 5 + a, 100 + c * 5 + b, 2.0) for c in range(2) for a, b in combinations(range(5), 2)] + [(100, 105, 0.1), (3, 104, 50.0)]
    nodes = [(i, "ring") for i in range(60)] + [(100 + i, "pair") for i in range(10)] + [(500, "lone")]
    comm = found(spark, nodes, edges)
    assert [comm[i] for i in range(60)] == [i // 6 * 6 for i in range(60)]
    assert [comm[100 + i] for i in range(10)] == [100] * 5 + [105] * 5 and comm[500] == 500


def test_moves_left(spark):
    """What is left to gain equals the change of modularity recomputed as a whole."""
    r = random.Random(5)
    edges = [(a, b, round(r.random(), 3) + 0.01) for a, b in combinations(range(14), 2) if r.random() < 0.4]
    comm = {i: r.randrange(3) for i in range(14)}
    parts = spark.createDataFrame([(i, "p", c) for i, c in comm.items()] + [(90, "q", 90)], "record_id long, path string, community long")
    got = {x.record_id: x.gain for x in communities.moves_left(parts, spark.createDataFrame(edges, EDGES)).collect()}
    q = modularity(edges, comm)
    for i in range(14):
        near = {comm[b if a == i else a] for a, b, _ in edges if i in (a, b)} - {comm[i]}
        want = max(modularity(edges, comm | {i: c}) - q for c in {*near, -1})
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[90] == 0


def test_split_into_several(spark):
    """Three interleaved groups, one held together by an exact key, part in one level; paths have one step."""
    from namesake.operators import bisect
    from namesake.spec import LinkageSpec

    groups = [range(g, 45, 3) for g in range(3)]
    rows = [(i, 0, i, 1800.0 + i / 4, "key" if i % 3 == 0 else None) for i in range(45)]
    edges = [(a, b, 0.9) for g in groups[1:] for a, b in combinations(g, 2)] + [(0, 1, 0.3), (1, 2, 0.3), (2, 3, 0.3), (0, 3, 0.9)]
    m = spark.createDataFrame(rows, "record_id long, cluster long, seq int, year double, gkey string")
    out = bisect.split_clusters(m, spark.createDataFrame(edges, EDGES), LinkageSpec(), multi=True).collect()
    parts = {}
    for x in out:
        parts.setdefault(x.path, []).append(x.record_id)
    assert {p: sorted(v) for p, v in parts.items()} == {f"0_{g}": list(groups[g]) for g in range(3)}


def test_clusters_within_tasks_fare_as_by_jobs(spark):
    """Weights are binary fractions, so that no order of summing shows."""
    r = random.Random(8)
    nodes, edges = [], []
    for path, n in (("a", 20), ("b", 12), ("c", 2), ("d", 1)):
        base = len(nodes)
        nodes += [(base + i, path) for i in range(n)]
        edges += [(base + a, base + b, r.randrange(1, 9) / 8) for a, b in combinations(range(n), 2) if n == 2 or r.random() < (0.5 if a % 4 == b % 4 else 0.06)]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    by_jobs, both, within = (
        {(x.record_id, x.path): x.community for x in communities.communities(n, e, in_task=some).collect()} for some in (0, 80, 100_000)
    )
    assert len(by_jobs) == 35 and len(set(by_jobs.values())) > 5
    assert by_jobs == both == within
