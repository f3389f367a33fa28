"""The prefix trie of conversations, and totals over its subtrees.

Each distinct sequence of first turns is a node. Nodes are told apart by running
sums of hashes of (place, turn), 120 bits in two halves, so a prefix's key comes
from running totals and not from a walk along the conversation: conversations of
any length are spread over all tasks. A node is named by its smallest member and
its depth.

Totals over subtrees come from a centroid decomposition of the parent edges. The
weight of a node is its number of members; the weight of its subtree, the turns
that its members have from there on, is known from one aggregation. In a
component, the nodes with over half of its weight below them are a path from its
top down to its centroid. What lies at or below the centroid is summed up and
added to every node of that path, the weights of the path are lowered by the
centroid's, and the component falls apart into the centroid's child trees and
the rest above it, each of half the weight at most. So every pair of a node and
its ancestor is met once, when a centroid parts them, and the number of levels
is the logarithm of the turns, whatever the depth.

All components of a level are split together by joins and sums. A component that
weighs no more than ``bound`` holds at most that many nodes; those are finished
by the same method within tasks, many to a task.

The digest of a node's ends runs over their ids in order, which only one task
can do; it reads them in short chunks made before, as a stream.

Defined results: turns are ordered by turn (null first), then by role and text,
so repeated rows are turns of their own next to each other; null roles and texts
are empty, texts of any length count whole; rows without conv_id belong to no
conversation and are left out; an empty table has no conversation and so no
node. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.operators.components import join_counted
from namesake.operators.ordered import dense_index
from namesake.session import cut, release

#: Rows of one block of an order; a group in several blocks carries one row for each.
BLOCK = 65_536
#: Components of this weight at most are finished within a task.
BOUND = 20_000
#: Ids of one chunk of a node's ends.
CHUNK = 256
_KEY = "decimal(30,0)"


def running(placed: DataFrame, group: str, sums: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``n``, a row's number in its group from 1, and ``rows``, the group's; ``sums`` become running totals.

    ``placed`` is numbered by ``_idx`` over the group and its order. Totals run
    within blocks of that order, and a group in several blocks carries one row
    for each of them. So no task holds a group as a whole.
    """
    placed = placed.withColumn("_block", F.floor(F.col("_idx") / block))
    parts = placed.groupBy("_block", group).agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "_block",
        group,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.sum("_n").over(Window.partitionBy(group)).alias("rows"),
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums],
    )
    within = Window.partitionBy("_block", group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.select("*", F.count("*").over(within).alias("_row"), *[F.sum(s).over(within).alias(f"_r_{s}") for s in sums])
    return inner.join(carried, ["_block", group]).select(
        *[c for c in placed.columns if c not in sums and c != "_block"],
        (F.col("_n") + F.col("_row")).alias("n"),
        "rows",
        *[(F.col(f"_s_{s}") + F.col(f"_r_{s}")).cast(_KEY).alias(s) for s in sums],
    )


def shared_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8, block: int = BLOCK) -> DataFrame:
    """(conv, part, place, said, bytes): first turns of a family's first conversation, then a conversation's own.

    ``said`` is a digest of role and text, ``bytes`` the text's length. Each
    conversation also has a row without a turn (part -1), so that one without
    turns is not lost. ``most`` bounds the shared turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        # The role's length keeps role and text apart.
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
        # Rows that are alike are told apart, so that ranges can part any number of them.
        F.monotonically_increasing_id().alias("_uid"),
    )
    placed = dense_index(turns, ["conv", "turn", "role", "text", "_uid"], "_idx", carry=["conv", "said", "bytes"])
    ordered = cut(running(placed, "conv", [], block).select("conv", (F.col("n") - 1).alias("place"), "said", "bytes"))
    convs, share = ordered.filter("place = 0").select("conv"), shared_turns(F.col("conv"))
    taken = convs.select("conv", (F.col("conv") - F.col("conv") % family).alias("_first"), share.alias("_share"))
    first = ordered.filter((F.col("place") < most) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "_first")
    front = taken.join(first, "_first").filter(F.col("place") < F.col("_share"))
    return reduce(
        DataFrame.unionByName,
        [
            rows.select("conv", F.lit(part).alias("part"), "place", "said", "bytes")
            for part, rows in (
                (-1, convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit("").alias("said"), F.lit(0).cast("long").alias("bytes"))),
                (0, front),
                (1, ordered.filter(F.col("place") >= share)),
            )
        ],
    )


def incidence(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, length, bytes, rep, n_convs, weight): the nodes of each conversation, from the root on.

    ``rep`` is the node's smallest member, ``weight`` what its members have from there on.
    """
    numbered = cut(running(dense_index(turns, ["conv", "part", "place"], "_idx"), "conv", [], block))
    digest = F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), "said"), 256)
    lanes = {f"k{p}": F.conv(F.substring(digest, p, 15), 16, 10).cast(_KEY) for p in (1, 17)}
    hashed = numbered.select(
        "_idx", "conv", "bytes", *[F.when(F.col("part") < 0, F.lit(0).cast(_KEY)).otherwise(v).alias(k) for k, v in lanes.items()]
    )
    depth = F.col("n") - 1
    keyed = cut(
        running(hashed, "conv", list(lanes), block).select(
            "conv", depth.alias("depth"), (F.col("rows") - 1).alias("length"), "bytes", F.struct(depth.alias("depth"), *lanes).alias("key")
        )
    )
    nodes = cut(
        keyed.groupBy("key").agg(
            F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
        )
    )
    return cut(join_counted(keyed, nodes.withColumn("_n", F.col("n_convs")), "key", "_n", keyed.count()).drop("key"))


def trie(visits: DataFrame) -> DataFrame:
    """One row for each node: rep, depth, parent_rep, n_convs, n_children, bytes, weight."""
    above = visits.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_rep"))
    own = visits.filter("conv = rep").drop("length")
    named = own.join(above, ["conv", "depth"], "left").drop("conv")
    children = (
        named.filter("depth > 0")
        .groupBy(F.col("parent_rep").alias("rep"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count("*").alias("n_children"))
    )
    return named.join(children, ["rep", "depth"], "left").fillna(0, ["n_children"])


def _part(rows: list[int], parent: list[int], weight: list[int], values: list[list[int]], totals: list[list[int]]) -> None:
    """Centroid decomposition of one component, given from the top down."""
    stack = [rows]
    while stack:
        part = stack.pop()
        whole = weight[part[0]]
        path = [v for v in part if 2 * weight[v] > whole]
        centre = path[-1]
        below, upper, trees = {centre: None}, [], []
        for v in part:
            if v == centre:
                continue
            above = parent[v]
            if above not in below:
                upper.append(v)
                continue
            tree = below[above]
            if tree is None:
                tree = []
                trees.append(tree)
            below[v] = tree
            tree.append(v)
        lost = weight[centre]
        for value, total in zip(values, totals):
            gained = sum(value[v] for v in below)
            for v in path:
                total[v] += gained
        for v in path[:-1]:
            weight[v] -= lost
        stack.extend(trees)
        if upper:
            stack.append(upper)


def _finish(parts: DataFrame, values: list[str]) -> DataFrame:
    """Totals of components that are small enough for a task."""
    columns = ["rep", "depth", *[f"t_{v}" for v in values]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            rep, depth, up, weight, *rest = map(list, zip(*[r[2:] for r in rows]))
            values_, totals = rest[: len(values)], rest[len(values) :]
            index = {k: i for i, k in enumerate(zip(rep, depth))}
            parent = [index.get((u, d - 1), -1) for u, d in zip(up, depth)]
            start = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i][:2] != rows[start][:2]:
                    # A top's parent lies in another component.
                    parent[start] = -1
                    _part(list(range(start, i)), parent, weight, values_, totals)
                    start = i
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rep, depth, *totals)], names=columns)

        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*[c.to_pylist() for c in batch.columns]))
            # The last component may go on in the next batch.
            last = len(held)
            while last and held[last - 1][:2] == held[-1][:2]:
                last -= 1
            if last:
                yield done(held[:last])
                held = held[last:]
        if held:
            yield done(held)

    flat = parts.select(
        F.col("comp.rep").alias("c_rep"), F.col("comp.depth").alias("c_depth"), "rep", "depth", "parent_rep", "weight",
        *values, *[f"t_{v}" for v in values],
    )
    flat = flat.repartition("c_rep", "c_depth").sortWithinPartitions("c_depth", "c_rep", "depth")
    return flat.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def subtree_totals(nodes: DataFrame, visits: DataFrame, values: list[str], bound: int = BOUND) -> DataFrame:
    """(rep, depth, t_...): the sum of each value over the node and all below it."""
    zeros = [F.lit(0).cast("long").alias(f"t_{v}") for v in values]
    # One tree, whose top is the root's only node.
    top = nodes.filter("depth = 0").select("rep").first()
    comp = F.struct(F.lit(top["rep"] if top else 0).cast("long").alias("rep"), F.lit(0).cast("long").alias("depth")).alias("comp")
    state = cut(nodes.select("rep", "depth", "parent_rep", "n_convs", "weight", *values, *zeros, comp))
    following = visits.select("conv", (F.col("depth") - 1).alias("depth"), F.col("rep").alias("next_rep"))
    steps, n_steps = None, 0
    small, finished = [], []
    while True:
        n = state.count()
        sizes = state.groupBy("comp").agg(F.count("*").alias("_n"), F.max("weight").alias("whole"))
        marked = cut(join_counted(state, sizes, "comp", "_n", n).withColumn("on_path", 2 * F.col("weight") > F.col("whole")))
        release(state)
        small.append(marked.filter(F.col("whole") <= bound))
        large = marked.filter(F.col("whole") > bound)
        rows = large.count()
        if not rows:
            break
        if steps is None:
            # Members of a node, and the node that each enters next.
            steps = cut(
                visits.join(following, ["conv", "depth"], "left").select(F.struct("rep", "depth").alias("node"), "conv", "next_rep")
            )
            n_steps = steps.count()
        centre = cut(
            large.filter("on_path").groupBy("comp").agg(F.max(F.struct("depth", "rep", "weight", "n_convs")).alias("c"), F.max("whole").alias("whole"))
        )
        found = centre.select(F.struct("c.rep", "c.depth").alias("node"), "comp", F.col("c.depth").alias("c_depth"), F.col("c.n_convs").alias("_n"))
        members = join_counted(steps, found, "node", "_n", n_steps).select(
            F.struct("comp", F.col("conv").alias("rep")).alias("_at"), "c_depth", "next_rep"
        )
        large = large.withColumn("_at", F.struct("comp", "rep"))
        keys = large.groupBy("_at").agg(F.count("*").alias("_n")).join(members, "_at", "left")
        below = F.coalesce(F.col("depth") >= F.col("c_depth"), F.lit(False))
        told = cut(join_counted(large, keys, "_at", "_n", rows).drop("_at").withColumn("below", below))
        gained = told.filter("below").groupBy("comp").agg(*[F.sum(v).alias(f"g_{v}") for v in values])
        per = centre.join(gained, "comp").join(told.groupBy("comp").agg(F.count("*").alias("_n")), "comp")
        per = per.select("comp", "_n", F.col("c.weight").alias("c_weight"), F.col("c.depth").alias("_c"), *[f"g_{v}" for v in values])
        after = join_counted(told, per, "comp", "_n", rows)
        here, path = F.col("below") & (F.col("depth") == F.col("_c")), F.col("on_path")
        after = cut(
            after.select(
                "rep", "depth", "parent_rep", "n_convs", *values, here.alias("done"),
                F.when(path & ~here, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
                *[F.when(path, F.col(f"t_{v}") + F.col(f"g_{v}")).otherwise(F.col(f"t_{v}")).alias(f"t_{v}") for v in values],
                F.when(F.col("below") & ~here, F.struct(F.col("next_rep").alias("rep"), (F.col("c_depth") + 1).alias("depth"))).otherwise(F.col("comp")).alias("comp"),
            )
        )
        release(told)
        release(centre)
        finished.append(after.filter("done").select("rep", "depth", *[f"t_{v}" for v in values]))
        state = cut(after.filter("not done").drop("done"))
    if steps is not None:
        release(steps)
    return reduce(DataFrame.unionByName, [_finish(reduce(DataFrame.unionByName, small), values), *finished])


def ends_digest(visits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rep, depth, ends_sha256) of nodes at which a conversation ends: SHA-256 of their ids, rising, comma-joined."""
    ends = visits.filter("depth = length").select("rep", "depth", "conv")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rep, depth, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if not out or out[-1][:2] != (rep, depth) or len(out[-1][3]) == chunk:
                    out.append((rep, depth, conv, []))
                out[-1][3].append(str(conv))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([o[k] for o in out], pa.int64()) for k in range(3)], pa.array([",".join(o[3]) for o in out], pa.string())],
                names=["rep", "depth", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for rep, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("rep", "depth", "ids")]):
                if at == (rep, depth):
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (rep, depth), hashlib.sha256(ids.encode())
            yield _digests(out)
        if at is not None:
            yield _digests([(*at, state.hexdigest())])

    def _digests(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["rep", "depth", "ends_sha256"])

    order = ["rep", "depth", "conv"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join_ids, "rep long, depth long, first long, ids string")
    chunks = chunks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first")
    return chunks.mapInArrow(digest, "rep long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bound: int = BOUND, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """All nodes of the rebuilt conversations, with totals over their subtrees."""
    visits = incidence(rebuilt(conversations, block=block), block)
    nodes = cut(
        trie(visits)
        .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    totals = subtree_totals(nodes, visits, ["leaf", "saved"], bound)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = nodes.join(totals, ["rep", "depth"]).join(ends_digest(visits, chunk), ["rep", "depth"], "left")
    return joined.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent_rep").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("t_leaf").alias("n_leaves"),
        F.col("t_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
