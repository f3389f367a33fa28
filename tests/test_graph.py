"""Exact-key groups, components and order operators against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from namesake.operators import components, edges, guarantee, ordered


def closure(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def table_rows(seed, chronological):
    rng = random.Random(seed)
    rows = []
    for i in range(220):
        seq = rng.randint(0, 14)
        year = 1800 + 4 * seq if chronological else 1800 + (seq * 37) % 120
        # One key holds a third of the rows.
        key = "hot" if i % 3 == 0 else rng.choice("abcdefgh")
        rows.append((i, seq, float(year), key))
    return rows


def all_pairs(rows, diff):
    ordered_rows = sorted(rows, key=lambda r: (r[1], r[0]))
    return [(a[0], b[0]) for a, b in combinations(ordered_rows, 2) if a[3] == b[3] and b[2] - a[2] < diff]


@pytest.mark.parametrize("seed,chronological", [(1, True), (2, False), (3, False)])
def test_groups_equal_all_pairs(spark, seed, chronological):
    rows = table_rows(seed, chronological)
    df = spark.createDataFrame(rows, "record_id long, seq int, year double, gkey string")
    pairs = all_pairs(rows, 20.0)
    links = [(r["src"], r["dst"]) for r in guarantee.guarantee_links(df, 20.0).collect()]
    ids = [r[0] for r in rows]
    assert closure(ids, links) == closure(ids, pairs)
    assert len(links) < len(rows)
    degree = {i: 0 for i in ids}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    found = {r["record_id"]: r["n_matches"] for r in guarantee.guarantee_degrees(df, 20.0).collect()}
    assert found == degree


def test_year_bound(spark):
    rows = [(1, 0, 1800.0, "k"), (2, 1, 1819.75, "k"), (3, 2, 1820.0, "j"), (4, 0, 1800.0, "j"), (5, 3, 1775.0, "j")]
    df = spark.createDataFrame(rows, "record_id long, seq int, year double, gkey string")
    found = {r["record_id"]: r["n_matches"] for r in guarantee.guarantee_degrees(df, 20.0).collect()}
    # 4 and 3 are 20 years apart; 5 lies 25 and 45 years back but later in order.
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


@pytest.mark.parametrize("seed", range(3))
def test_edition_spanning_the_bound(spark, seed):
    """Years that vary inside an edition by more than the bound: the order of ids decides."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), 1800.0 + rng.choice([0, 5, 19, 20, 45]), rng.choice("kj")) for i in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "record_id long, seq int, year double, gkey string")
    degree = {r[0]: 0 for r in rows}
    pairs = all_pairs(rows, 20.0)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert {r["record_id"]: r["n_matches"] for r in guarantee.guarantee_degrees(df, 20.0).collect()} == degree
    links = [(r["src"], r["dst"]) for r in guarantee.guarantee_links(df, 20.0).collect()]
    ids = [r[0] for r in rows]
    assert closure(ids, links) == closure(ids, pairs)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, parts, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(components, "HOT_MIN_ROWS", 5)
        monkeypatch.setattr(components, "HOT_SHARE", 20)
    rng = random.Random(5)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(70)]
    pairs += [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 60)]
    ids = sorted({x for p in pairs for x in p} | {999})
    e = spark.createDataFrame(pairs, "src long, dst long").repartition(parts)
    v = spark.createDataFrame([(i,) for i in ids], "record_id long")
    found = {r["record_id"]: r["cluster"] for r in components.connected_components(e, v).collect()}
    assert found == closure(ids, pairs)
    no_vertices = {r["record_id"]: r["cluster"] for r in components.connected_components(e).collect()}
    used = {x for a, b in pairs if a != b for x in (a, b)}
    assert no_vertices == {k: c for k, c in found.items() if k in used}


def test_components_without_edges(spark):
    e = spark.createDataFrame([], "src long, dst long")
    v = spark.createDataFrame([(3,), (4,)], "record_id long")
    assert {tuple(r) for r in components.connected_components(e, v).collect()} == {(3, 3), (4, 4)}


def test_union_keeps_highest_weight(spark):
    a = spark.createDataFrame([(1, 2, 0.6), (3, 2, 0.8)], "src long, dst long, weight double")
    b = spark.createDataFrame([(2, 1, 1.0), (5, 5, 1.0)], "src long, dst long, weight double")
    found = {tuple(r) for r in edges.union_edges(a, b).collect()}
    assert found == {(1, 2, 1.0), (2, 3, 0.8)}


def test_dense_index_and_next(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else str(i % 5), rng.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, seq int, id long")
    numbered = ordered.dense_index(df, ["g", "seq", "id"], partitions=11).collect()
    assert [r["id"] for r in sorted(numbered, key=lambda r: r["idx"])] == [r[2] for r in sorted(rows)]
    assert sorted(r["idx"] for r in numbered) == list(range(300))
    found = {r["id"]: r["next_id"] for r in ordered.with_next(df, ["g"], ["seq", "id"], ["id"]).collect()}
    groups = {}
    for g, s, i in sorted(rows):
        groups.setdefault(g, []).append(i)
    expected = {i: n for ids in groups.values() for i, n in zip(ids, ids[1:] + [None])}
    assert found == expected


def test_renumber_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "k string, o long")
    found = {r["o"]: r["n"] for r in ordered.renumber(df, "k", F.struct("o"), "n").collect()}
    assert found == {0: 0, 1: 1, 3: 1, 2: 2}


def test_years_against_the_order_in_a_hot_key(spark):
    """One key with most records, several mistyped years: counted by ranges, equal to all pairs."""
    import random

    r = random.Random(9)
    rows = [(i, r.randrange(12), 0.0, "hot") for i in range(150)] + [(200 + i, r.randrange(6), 0.0, f"k{i % 5}") for i in range(40)]
    rows = [(i, s, 1800.0 + 4 * s + (r.choice([-60, 60]) if r.random() < 0.1 else 0), k) for i, s, _, k in rows]
    want = {}
    for i, s, y, k in rows:
        want[i] = sum(
            (y2 - y if (s, i) < (s2, j) else y - y2) < 20.0 for j, s2, y2, k2 in rows if k2 == k and j != i
        )
    df = spark.createDataFrame(rows, "record_id long, seq int, year double, gkey string")
    assert {x.record_id: x.n_matches for x in guarantee.guarantee_degrees(df, 20.0).collect()} == want


def test_running_totals_and_runs_through_blocks(spark):
    import random

    r = random.Random(4)
    rows = [(i, "a" if i < 70 else r.choice("bc"), r.randrange(3)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    totals = {x.id: x.v for x in ordered.running_totals(df, ["g"], ["id"], ["v"], block=16).collect()}
    firsts = {x.id: x.first for x in ordered.run_starts(df, ["g"], ["id"], "v", "id", "first", block=16).collect()}
    for g in "abc":
        mine, total, first, was = sorted(x for x in rows if x[1] == g), 0, None, None
        for i, _, v in mine:
            total += v
            first = i if v != was else first
            was = v
            assert totals[i] == total and firsts[i] == first
