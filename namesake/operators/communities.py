"""Communities of weighted graphs by local moves and aggregation of levels.

All clusters are worked on together. On a level, each node looks at the weight
that ties it to every neighbouring community, and at being alone; many nodes
move at once. A step counts only if the modularity of its cluster rises: after
one that does not, half as many of the willing nodes are drawn, down to the one
that gains most. When no node of a level gains, communities become the nodes of
the next level, whose arcs and inner weights are sums. When no level gains any
more, single nodes are tried again, so that in the end none gains by moving.

A cluster of bounded size goes through the same steps within one task, all such
clusters in one job; steps are jobs only for larger ones. Nothing is collected
but one flag per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.operators.bisect import HALVINGS, IN_TASK, LEAST_GAIN, drawn, drawn_rows, places_of, within_tasks
from namesake.session import cut, release


def _alone(node: Column) -> Column:
    """A community of one's own, named like no node."""
    return -node - 1


def _moved(nodes: DataFrame, arcs: DataFrame, seed: int) -> DataFrame:
    """(node, path, degree, inner, comm) after the local moves of one level.

    ``nodes(node, path, degree, inner, comm)``, ``arcs(node, other, weight)``
    both ways, without loops; ``inner`` is twice the weight inside a node.
    """
    whole = cut(nodes.groupBy("path").agg(F.sum("degree").alias("total")))
    base = ["node", "path", "degree", "inner", "total"]
    state = nodes.join(whole, "path").select(
        *base, F.col("comm").alias("trial"), "comm", F.lit(0.0).alias("gain"), F.col("comm").alias("goal"), F.lit(-2.0).alias("q"), F.lit(0).alias("halved")
    )
    state = cut(state)
    step = 0
    while True:
        there = state.select(F.col("node").alias("other"), F.col("trial").alias("c"))
        ties = arcs.join(there, "other").groupBy("node", "c").agg(F.sum("weight").alias("w"))
        sums = state.groupBy("path", F.col("trial").alias("c")).agg(F.sum("degree").alias("sum"))
        # Being alone is open to a node that is not, under a name that nobody bears.
        apart = state.select("node", _alone(F.col("node")).alias("c"), F.lit(0.0).alias("w"))
        apart = apart.join(sums.select("c"), "c", "left_anti").select("node", "c", "w")
        options = cut(ties.unionByName(apart).join(sums.select("c", "sum"), "c", "left").withColumn("sum", F.coalesce("sum", F.lit(0.0))))
        own = options.select("node", F.col("c").alias("trial"), F.col("w").alias("own"))
        placed = state.join(own, ["node", "trial"], "left").join(sums.select(F.col("c").alias("trial"), F.col("sum").alias("own_sum")), "trial")
        placed = cut(placed.withColumn("own", F.coalesce("own", F.lit(0.0))))
        total, degree = F.col("total"), F.col("degree")
        change = 2 * (F.col("w") - F.col("own") - degree * (F.col("sum") - F.col("own_sum") + degree) / total) / total
        ways = options.join(placed.select("node", "trial", "own", "own_sum", "degree", "total"), "node").filter((F.col("c") != F.col("trial")) & (total > 0))
        found = ways.groupBy("node").agg(F.max(F.struct(change.alias("gain"), (-F.col("c")).alias("c"))).alias("m"))
        found = found.select("node", F.col("m.gain").alias("now_gain"), (-F.col("m.c")).alias("now_goal"))
        inner = placed.groupBy("path").agg(F.sum(F.col("own") + F.col("inner")).alias("_in"))
        squares = sums.groupBy("path").agg(F.sum(F.col("sum") * F.col("sum")).alias("_sq"))
        joined = placed.join(found, "node", "left").join(inner, "path").join(squares, "path")
        q_now = F.when(total > 0, F.col("_in") / total - F.col("_sq") / (total * total)).otherwise(F.lit(0.0))
        better = q_now > F.col("q") + 1e-12
        joined = joined.select(
            *base,
            F.when(better, F.col("trial")).otherwise(F.col("comm")).alias("comm"),
            F.when(better, F.coalesce("now_gain", F.lit(0.0))).otherwise(F.col("gain")).alias("gain"),
            F.when(better, F.coalesce("now_goal", "trial")).otherwise(F.col("goal")).alias("goal"),
            F.when(better, q_now).otherwise(F.col("q")).alias("q"),
            F.when(better, F.greatest(F.lit(1), F.col("halved") - 1)).otherwise(F.least(F.lit(HALVINGS), F.col("halved") + 1)).alias("halved"),
        )
        willing = F.col("gain") > LEAST_GAIN
        leads = joined.filter(willing).groupBy("path").agg(F.max(F.struct("gain", "node"))["node"].alias("lead"))
        joined = joined.join(leads, "path", "left")
        lead = F.coalesce(F.col("lead") == F.col("node"), F.lit(False))
        lot = (F.col("halved") < HALVINGS) & drawn(F.col("halved"), "node", F.lit(seed + step))
        former = state
        state = cut(joined.select(*base, F.when(willing & (lot | lead), F.col("goal")).otherwise(F.col("comm")).alias("trial"), "comm", "gain", "goal", "q", "halved"))
        for table in (former, options, placed):
            release(table)
        if state.filter(willing).isEmpty():
            return state.select("node", "path", "degree", "inner", "comm")
        step += 1


def _moved_rows(node, degree, inner, comm, src, dst, weight, seed: int) -> np.ndarray:
    """The communities after the local moves of one level of one cluster, as ``_moved`` finds them.

    ``node`` rises; ``src`` and ``dst`` are places in it.
    """
    total, n = degree.sum(), len(node)
    if total <= 0:
        return comm
    trial, gain, goal, q, halved, step = comm, None, None, -2.0, 0, 0
    while True:
        names, at = np.unique(trial, return_inverse=True)
        sums = np.bincount(at, degree)
        pairs, which = np.unique(src * len(names) + at[dst], return_inverse=True)
        tied, there, w = pairs // len(names), pairs % len(names), np.bincount(which, weight, len(pairs))
        own = np.zeros(n)
        mine = there == at[tied]
        own[tied[mine]] = w[mine]
        apart = np.flatnonzero(~np.isin(-node - 1, names))
        way_node = np.concatenate([tied[~mine], apart])
        way_to = np.concatenate([names[there[~mine]], -node[apart] - 1])
        way_w = np.concatenate([w[~mine], np.zeros(len(apart))])
        way_sum = np.concatenate([sums[there[~mine]], np.zeros(len(apart))])
        deg = degree[way_node]
        change = 2 * (way_w - own[way_node] - deg * (way_sum - sums[at[way_node]] + deg) / total) / total
        # Of each node the way that gains most; of equal ones the least name.
        order = np.lexsort([-way_to, change, way_node])
        last = order[np.flatnonzero(np.diff(way_node[order], append=-1))]
        now_gain, now_goal = np.zeros(n), trial.copy()
        now_gain[way_node[last]], now_goal[way_node[last]] = change[last], way_to[last]
        now_q = (own + inner).sum() / total - (sums * sums).sum() / (total * total)
        if now_q > q + 1e-12:
            comm, gain, goal, q, halved = trial, now_gain, now_goal, now_q, max(1, halved - 1)
        else:
            halved = min(HALVINGS, halved + 1)
        willing = gain > LEAST_GAIN
        if not willing.any():
            return comm
        moves = willing & drawn_rows(halved, node, seed + step) if halved < HALVINGS else np.zeros(n, bool)
        moves[np.flatnonzero(gain == gain.max())[-1]] = True
        trial = np.where(moves, goal, comm)
        step += 1


def _named_rows(node: np.ndarray, comm: np.ndarray) -> np.ndarray:
    """Communities named by their smallest node; ``node`` rises."""
    _, first, at = np.unique(comm, return_index=True, return_inverse=True)
    return node[first][at]


def _communities_rows(rows: pa.Table, arcs: pa.Table, seed: int) -> pa.Table:
    """(node, path, comm) of one cluster: the levels and rounds of ``communities``."""
    rows = rows.sort_by("node")
    node, degree, inner = (rows[c].to_numpy() for c in ("node", "degree", "inner"))
    order = np.arange(len(node))
    src, dst = (places_of(node, order, arcs[c].to_numpy()) for c in ("node", "other"))
    weight = arcs["weight"].to_numpy()
    comm = node
    while True:
        comm = _named_rows(node, _moved_rows(node, degree, inner, comm, src, dst, weight, seed))
        level = (node, degree, inner, comm, src, dst, weight)
        while True:
            below, d, i, of, a, b, w = level
            above, to = np.unique(of, return_inverse=True)
            pairs, which = np.unique(to[a] * len(above) + to[b], return_inverse=True)
            one, other, summed = pairs // len(above), pairs % len(above), np.bincount(which, w, len(pairs))
            loop = one == other
            up_inner = np.bincount(to, i) + np.bincount(one[loop], summed[loop], len(above))
            up = (above, np.bincount(to, d), up_inner, above, one[~loop], other[~loop], summed[~loop])
            higher = _named_rows(above, _moved_rows(*up, seed))
            if np.array_equal(higher, above):
                break
            comm = higher[np.searchsorted(above, comm)]
            level = (*up[:3], higher, *up[4:])
        again = _named_rows(node, _moved_rows(node, degree, inner, comm, src, dst, weight, seed + 1))
        changed, comm = not np.array_equal(again, comm), again
        if not changed:
            return pa.table([rows["node"], rows["path"], pa.array(comm)], names=["node", "path", "comm"])


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 0, in_task: int = IN_TASK) -> DataFrame:
    """(record_id, path, community): the communities within each ``path``, named by their smallest unit.

    ``nodes(record_id, path)`` and undirected ``edges(src, dst, weight)`` with
    positive weights, one row per pair; edges between paths are left out, nodes
    without an edge are communities of their own. With ``unit`` and ``matches``
    in ``nodes``, records of one unit stay together; ``matches`` is the weight
    that ties a record to others of its unit and is in no edge. Clusters of at
    most ``in_task`` units and arcs are done within tasks.
    """
    if "unit" not in nodes.columns:
        nodes = nodes.select("record_id", "path", F.col("record_id").alias("unit"), F.lit(0.0).alias("matches"))
    named = nodes.select("record_id", F.col("unit").alias("node"), "path")
    there = named.select(F.col("record_id").alias("dst"), F.col("node").alias("other"), F.col("path").alias("_path"))
    sided = edges.join(named.withColumnRenamed("record_id", "src"), "src").join(there, "dst").filter(F.col("path").eqNullSafe(F.col("_path")) & (F.col("src") != F.col("dst")))
    sided = cut(sided.select("node", "other", F.col("weight").cast("double").alias("weight")))
    loops = sided.filter("node = other").groupBy("node").agg(F.sum(2 * F.col("weight")).alias("_loops"))
    apart = sided.filter("node <> other")
    both = apart.unionByName(apart.select(F.col("other").alias("node"), F.col("node").alias("other"), "weight"))
    arcs = cut(both.groupBy("node", "other").agg(F.sum("weight").alias("weight")))
    degrees = arcs.groupBy("node").agg(F.sum("weight").alias("degree"))
    units = nodes.groupBy(F.col("unit").alias("node"), "path").agg(F.sum(F.col("matches").cast("double")).alias("inner"))
    units = units.join(loops, "node", "left").withColumn("inner", F.col("inner") + F.coalesce("_loops", F.lit(0.0))).drop("_loops")
    ground = cut(
        units.join(degrees, "node", "left").select("node", "path", (F.coalesce("degree", F.lit(0.0)) + F.col("inner")).alias("degree"), "inner", F.col("node").alias("comm"))
    )
    small, large = within_tasks(ground, arcs, "node", in_task)
    rows = ground.join(small, "path").select("node", "path", "degree", "inner")
    own = arcs.join(rows.select("node", F.col("path").alias("_path")), "node")
    kinds = {f.name: f.dataType.simpleString() for f in ground.schema.fields}
    found = cut(rows.groupBy("path").cogroup(own.groupBy("_path")).applyInArrow(
        lambda a, b: _communities_rows(a, b, seed), f"node {kinds['node']}, path {kinds['path']}, comm {kinds['node']}"
    ))
    if not large.isEmpty():
        some = cut(ground.join(large, "path").select(*ground.columns))
        some_arcs = cut(arcs.join(some.select("node"), "node", "left_semi"))
        found = found.unionByName(_by_jobs(some, some_arcs, seed).select(*found.columns))
    return named.join(found.select("node", F.col("comm").alias("community")), "node").select("record_id", "path", "community")


def _by_jobs(ground: DataFrame, arcs: DataFrame, seed: int) -> DataFrame:
    """(node, path, degree, inner, comm): the steps of ``communities`` as jobs over clusters of any size."""
    while True:
        settled = cut(_named(_moved(ground, arcs, seed)))
        moved = settled
        level, level_arcs = settled, arcs
        while True:
            # Communities become nodes.
            of = level.select("node", F.col("comm").alias("to"))
            summed = level_arcs.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("to").alias("to_other")), "other")
            summed = cut(summed.groupBy("to", "to_other").agg(F.sum("weight").alias("weight")))
            within = summed.filter("to = to_other").select(F.col("to").alias("node"), F.col("weight").alias("_within"))
            above = level.groupBy(F.col("comm").alias("node"), "path").agg(F.sum("degree").alias("degree"), F.sum("inner").alias("inner"))
            above = above.join(within, "node", "left").select(
                "node", "path", "degree", (F.col("inner") + F.coalesce("_within", F.lit(0.0))).alias("inner"), F.col("node").alias("comm")
            )
            above_arcs = summed.filter("to <> to_other").select(F.col("to").alias("node"), F.col("to_other").alias("other"), "weight")
            higher = cut(_named(_moved(cut(above), above_arcs, seed)))
            if higher.filter("node <> comm").isEmpty():
                break
            joined = moved.join(higher.select(F.col("node").alias("comm"), F.col("comm").alias("_up")), "comm")
            moved = cut(joined.select("node", "path", "degree", "inner", F.col("_up").alias("comm")))
            level, level_arcs = higher, above_arcs
        # Single records once more, from what the levels found.
        ground = moved
        again = cut(_named(_moved(ground, arcs, seed + 1)))
        changed = not again.join(moved.select("node", F.col("comm").alias("_was")), "node").filter("comm <> _was").isEmpty()
        ground = again
        if not changed:
            return again


def _named(moved: DataFrame) -> DataFrame:
    """Communities named by their smallest node."""
    lowest = moved.groupBy("comm").agg(F.min("node").alias("low"))
    return moved.join(lowest, "comm").select("node", "path", "degree", "inner", F.col("low").alias("comm"))


def moves_left(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, path, degree, gain): the best change of modularity that moving one record alone would bring.

    ``parts(record_id, path, community)`` as ``communities`` returns them, from
    the same ``edges``; a record alone in its cluster has gain 0.
    """
    both = edges.select(F.col("src").alias("record_id"), F.col("dst").alias("other"), "weight").unionByName(
        edges.select(F.col("dst").alias("record_id"), F.col("src").alias("other"), "weight")
    )
    there = parts.select(F.col("record_id").alias("other"), F.col("path").alias("_path"), F.col("community").alias("c"))
    ties = both.join(parts.select("record_id", "path"), "record_id").join(there, "other").filter(F.col("path").eqNullSafe(F.col("_path")))
    ties = cut(ties.groupBy("record_id", "c").agg(F.sum("weight").alias("w")))
    degrees = ties.groupBy("record_id").agg(F.sum("w").alias("degree"))
    full = cut(parts.join(degrees, "record_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0))))
    sums = full.groupBy("path", F.col("community").alias("c")).agg(F.sum("degree").alias("sum"))
    whole = full.groupBy("path").agg(F.sum("degree").alias("total"))
    own = ties.select("record_id", F.col("c").alias("community"), F.col("w").alias("own"))
    at = full.join(own, ["record_id", "community"], "left").join(whole, "path").join(
        sums.select("path", F.col("c").alias("community"), F.col("sum").alias("own_sum")), ["path", "community"]
    )
    own_weight, total = F.coalesce("own", F.lit(0.0)), F.col("total")

    def change(w: Column, c: Column) -> Column:
        return 2 * (w - own_weight - F.col("degree") * (c - F.col("own_sum") + F.col("degree")) / total) / total

    joins = at.join(ties.join(sums.drop("path"), "c").select("record_id", "c", "w", "sum"), "record_id").filter("c <> community")
    best = joins.groupBy("record_id").agg(F.max(change(F.col("w"), F.col("sum"))).alias("_best"))
    alone = F.when(total > 0, change(F.lit(0.0), F.lit(0.0))).otherwise(F.lit(0.0))
    return at.join(best, "record_id", "left").select("record_id", "path", "degree", F.greatest(alone, F.coalesce("_best", F.lit(-1.0))).alias("gain"))
