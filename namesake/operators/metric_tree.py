"""Exact k-nearest join of unit vectors by a metric tree that is kept as tables.

Likeness depends on the value alone, so the tree holds distinct right items,
each with the editions it occurs in; left items are searched once for all their
editions. A node is split around pivots of its own until it holds few items:
all nodes of a level together, whatever their number. Nothing of the tree meets
on the driver.

The search goes down the tree twice. First each left item follows the few
nearest nodes of a level down to leaves, whose items give it k hits per edition
and so a radius. Then it goes down again and leaves out what the radius rules
out: by the ring of distances around a pivot (triangle inequality), by the
half-plane between two pivots, and by the editions met below a node. The leaves
that remain are visited in the order of their bounds, one, two, four at a time;
after each turn the radius has shrunk and rules out more.

A node's rows are cut into blocks of bounded size on both sides, so that no task
receives a node as a whole however many items share it. Equal vectors cannot be
told apart by pivots; they stay together in one leaf of many blocks. Where
vectors are spread evenly in many dimensions no bound rules anything out. A few
left items tell how much their radius leaves; if it is much, the second descent
is left out and all pairs are compared in large blocks, still by the radius.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesake.functions.vectors import rows_of
from namesake.session import cut, release

#: Pivots of a node, and items of a leaf.
FAN, LEAF = 24, 512
#: Nodes of a level that the first descent follows.
BEAM = 3
#: Rows of the two sides of one block.
LEFT_BLOCK, RIGHT_BLOCK = 2048, 4096
#: Left items that are tried, and the share of all pairs left to them from which on all are compared in blocks of this many rows.
TRIED, DENSE = 256, 0.2
DENSE_LEFT, DENSE_RIGHT = 4096, 16384
#: Partitions of the blocks at most.
DENSE_PARTITIONS = 2000
#: Left rows whose likenesses stand in memory at once.
CHUNK = 512
#: Similarities are compared at this many decimals, so that ties break the same way whatever order a sum was taken in.
DECIMALS = 9
#: Slack against rounding of distances.
SLACK = 1e-6
#: Editions are folded to so many bits; a shared bit is necessary for a match, not enough.
BITS = 62


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _angles(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1.0, 1.0))


def _bits(seqs: Column, window: int = 1) -> Column:
    """A set of editions, each with the window that begins there, as bits."""
    if window >= BITS:
        return F.lit((1 << BITS) - 1).cast("long")
    one = F.lit(1).cast("long")

    def added(acc: Column, s: Column) -> Column:
        for w in range(window):
            acc = acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(s + w, F.lit(BITS)).cast("int")))
        return acc

    return F.aggregate(seqs, F.lit(0).cast("long"), added)


def _blocks(rows: DataFrame, sizes: DataFrame, item: str) -> DataFrame:
    """``rows`` of each node dealt to ``n_blocks`` of bounded size; ``sizes(node, n_blocks)``."""
    return rows.join(sizes, "node").withColumn("_block", F.pmod(F.xxhash64(item), F.col("n_blocks"))).drop("n_blocks")


def _n_blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.ceil(F.count("*") / LEFT_BLOCK).alias("n_blocks"))


def _each_block(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """``table`` repeated for every block of its node."""
    spread = table.join(sizes, "node")
    return spread.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).drop("n_blocks")


def _typed(schema: T.StructType, *names: str) -> str:
    return ", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names)


def build(items: DataFrame, fan: int = FAN, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(placed, nodes) of ``items(r_item, r_vec, mask)``.

    ``placed`` adds the leaf ``node`` of each item. ``nodes`` has a row for each
    node but the root: node, parent, pivot, inner and outer distance of its
    items, their number n, the editions below as mask, and whether it is a leaf.
    """
    spark = items.sparkSession
    kind = items.schema["r_item"].dataType.simpleString()
    shape = f"r_item {kind}, r_vec array<double>, mask long, node long, d double"

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        own = _whole(pivots["pivots"])[0].values
        d = _angles(rows_of(_whole(rows["r_vec"])) @ rows_of(own).T)
        child = d.argmin(axis=1)
        node = rows["node"].to_numpy() * fan + child + 1
        return pa.table([rows["r_item"], rows["r_vec"], rows["mask"], pa.array(node), pa.array(d[np.arange(len(d)), child])], names=["r_item", "r_vec", "mask", "node", "d"])

    state = cut(items.select("r_item", "r_vec", "mask", F.lit(0).cast("long").alias("node")))
    total = state.count()
    sizes = spark.createDataFrame([(0, total)], "node long, n long").filter(F.col("n") > leaf)
    settled, tables = [], []
    if total <= leaf:
        settled.append(state)
    while total > leaf:
        by_hash = Window.partitionBy("node").orderBy(F.xxhash64("r_item"), "r_item")
        picked = state.withColumn("_j", F.row_number().over(by_hash)).filter(F.col("_j") <= fan)
        pivots = cut(picked.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", "r_vec"))), lambda x: x["r_vec"]).alias("pivots")))
        blocks = cut(_n_blocks(state))
        dealt = _blocks(state, blocks, "r_item").groupBy("node", "_block").cogroup(_each_block(pivots, blocks).groupBy("node", "_block"))
        moved = cut(dealt.applyInArrow(assign, shape))
        release(state)
        found = moved.groupBy("node").agg(F.count("*").alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer"), F.bit_or("mask").alias("mask"))
        found = found.withColumn("parent", F.floor((F.col("node") - 1) / fan))
        above = sizes.select(F.col("node").alias("parent"), F.col("n").alias("_above"))
        # A node that its pivots cannot part stays as it is.
        known = found.join(above, "parent").withColumn("is_leaf", (F.col("n") <= leaf) | (F.col("n") == F.col("_above")))
        centre = pivots.select(F.col("node").alias("parent"), F.posexplode("pivots").alias("_j", "pivot"))
        centre = centre.select((F.col("parent") * fan + F.col("_j") + 1).alias("node"), "pivot")
        level = cut(known.drop("_above").join(centre, "node"))
        tables.append(level)
        leaves = level.filter("is_leaf").select("node")
        settled.append(cut(moved.drop("d").join(leaves, "node", "left_semi")))
        sizes = level.filter(~F.col("is_leaf")).select("node", "n")
        state = cut(moved.drop("d").join(sizes.select("node"), "node", "left_semi"))
        release(moved)
        if state.isEmpty():
            break
    placed = settled[0]
    for s in settled[1:]:
        placed = placed.unionByName(s)
    empty = spark.createDataFrame([], "node long, n long, inner double, outer double, mask long, parent long, is_leaf boolean, pivot array<double>")
    for t in tables:
        empty = empty.unionByName(t)
    return placed, empty


def _descend(queries: DataFrame, nodes: DataFrame, beam: int | None, fan: int) -> DataFrame:
    """(l_item, node, bound) of the leaves that ``queries(l_item, l_vec, mask, radius)`` reach.

    With ``beam`` each follows so many nearest nodes of a level; without it, all
    nodes that its radius does not rule out.
    """
    kind = queries.schema["l_item"].dataType.simpleString()
    shape = f"l_item {kind}, node long, bound double, d double, leaf boolean"
    children = nodes.select(F.col("parent").alias("node"), F.struct("node", "pivot", "inner", "outer", "mask", "is_leaf").alias("child"))
    children = cut(children.groupBy("node").agg(F.sort_array(F.collect_list("child")).alias("children")))

    def step(rows: pa.Table, kids: pa.Table) -> pa.Table:
        own = _whole(kids["children"])[0].values
        field = {n: own.field(n) for n in ("node", "inner", "outer", "mask", "is_leaf")}
        d = _angles(rows_of(_whole(rows["l_vec"])) @ rows_of(own.field("pivot")).T)
        inner, outer = field["inner"].to_numpy(), field["outer"].to_numpy()
        bound = np.maximum(d - outer, inner - d)
        # An item is no nearer to another pivot than to its own.
        bound = np.maximum(bound, (d - d.min(axis=1, keepdims=True)) / 2)
        bound = np.maximum(bound - SLACK, rows["bound"].to_numpy()[:, None])
        met = (rows["mask"].to_numpy()[:, None] & field["mask"].to_numpy()[None, :]) != 0
        if beam is None:
            met &= bound <= rows["radius"].to_numpy()[:, None]
        else:
            far = np.where(met, d, np.inf)
            if far.shape[1] > beam:
                met &= far <= np.partition(far, beam - 1, axis=1)[:, beam - 1 : beam]
        at, child = np.nonzero(met)
        return pa.table(
            [rows["l_item"].take(pa.array(at)), field["node"].take(pa.array(child)), pa.array(bound[at, child]), pa.array(d[at, child]), field["is_leaf"].take(pa.array(child))],
            names=["l_item", "node", "bound", "d", "leaf"],
        )

    frontier = queries.select("l_item", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("bound"))
    reached = []
    while True:
        rows = frontier.join(queries.select("l_item", "l_vec", "mask", "radius"), "l_item")
        blocks = cut(_n_blocks(frontier))
        dealt = _blocks(rows, blocks, "l_item").groupBy("node", "_block").cogroup(_each_block(children.join(blocks.select("node"), "node", "left_semi"), blocks).groupBy("node", "_block"))
        found = dealt.applyInArrow(step, shape)
        if beam is not None:
            nearest = Window.partitionBy("l_item").orderBy("d", "node")
            found = found.withColumn("_j", F.row_number().over(nearest)).filter(F.col("_j") <= beam).drop("_j")
        found = cut(found)
        reached.append(found.filter("leaf").select("l_item", "node", "bound"))
        frontier = found.filter("not leaf").select("l_item", "node", "bound")
        if frontier.isEmpty():
            break
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return out


def _compare(
    visits: DataFrame, queries: DataFrame, placed: DataFrame, k: int, window: int, compared: list | None,
    left_block: int | None = None, right_block: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """The k best hits per (l_item, l_seq) within each leaf block that ``visits(l_item, node)`` name, none beyond the radius."""
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *placed.schema.fields)}
    shape = f"l_item {kinds['l_item']}, l_seq long, r_item {kinds['r_item']}, r_seq long, r_tie {placed.schema['met'].dataType.elementType['tie'].dataType.simpleString()}, sim double"

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["l_item", "l_seq", "r_item", "r_seq", "r_tie", "sim"]
        met = _whole(right["met"])
        owner = np.repeat(np.arange(len(right)), np.diff(met.offsets.to_numpy()))
        flat = met.flatten()
        tie_order = pa.compute.sort_indices(flat.field("tie")).to_numpy()
        owner, seqs, ties = owner[tie_order], flat.field("seq").to_numpy()[tie_order], flat.field("tie").take(pa.array(tie_order))
        l_vecs, r_vecs = rows_of(_whole(left["l_vec"])), rows_of(_whole(right["r_vec"]))
        radius = left["radius"].to_numpy()
        floor = np.where(np.isinf(radius), -np.inf, np.cos(np.minimum(radius, np.pi)) - 10.0**-DECIMALS)
        asked = _whole(left["l_seqs"])
        row_of, asked_seq = np.repeat(np.arange(len(left)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
        parts = []
        for at in range(0, len(left), CHUNK):
            sims = np.round(l_vecs[at : at + CHUNK] @ r_vecs.T, DECIMALS)
            mine = (row_of >= at) & (row_of < at + CHUNK)
            for s in np.unique(asked_seq[mine]):
                rows = row_of[mine & (asked_seq == s)]
                columns = np.flatnonzero((seqs >= s) & (seqs < s + window))
                if not len(columns):
                    continue
                some = sims[rows - at][:, owner[columns]]
                near = some >= floor[rows][:, None]
                if some.shape[1] > k and np.count_nonzero(near) > 4 * k * len(rows):
                    near &= some >= -np.partition(-some, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(near)
                # By row, likeness and tie; of each row the first k.
                order = np.lexsort([j, -some[i, j], i])
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                kept = np.arange(len(i)) - first < k
                i, j = i[kept], j[kept]
                parts.append((rows[i], np.full(len(i), s), columns[j], some[i, j]))
        if not parts:
            empty = [left["l_item"].slice(0, 0), pa.array([], pa.int64()), right["r_item"].slice(0, 0), pa.array([], pa.int64()), ties.slice(0, 0), pa.array([], pa.float64())]
            return pa.table(empty, names=names)
        l, s, c, v = (np.concatenate(x) for x in zip(*parts))
        return pa.table(
            [left["l_item"].take(pa.array(l)), pa.array(s.astype(np.int64)), right["r_item"].take(pa.array(owner[c])), pa.array(seqs[c].astype(np.int64)), ties.take(pa.array(c)), pa.array(v)],
            names=names,
        )

    # Blocks of both sides, worked out where the counts are.
    n_left = visits.groupBy("node").agg(F.count("*").alias("_l"))
    n_right = placed.groupBy("node").agg(F.count("*").alias("_r"))
    layout = cut(n_left.join(n_right, "node").select("node", "_l", "_r", F.ceil(F.col("_l") / (left_block or LEFT_BLOCK)).alias("_lb"), F.ceil(F.col("_r") / (right_block or RIGHT_BLOCK)).alias("_rb")))
    if compared is not None:
        compared.append(layout.agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0))).first()[0])

    def dealt(rows: DataFrame, item: str, own: str, other: str) -> DataFrame:
        spread = rows.join(layout.select("node", "_lb", "_rb"), "node")
        return (
            spread.withColumn(f"{own}_no", F.pmod(F.xxhash64(item), F.col(own)))
            .withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
            .drop("_lb", "_rb")
        )

    keys = ["node", "_lb_no", "_rb_no"]
    lefts = dealt(visits.select("l_item", "node").join(queries.select("l_item", "l_vec", "l_seqs", "radius"), "l_item"), "l_item", "_lb", "_rb")
    rights = dealt(placed, "r_item", "_rb", "_lb")
    if partitions:
        # A block is little to read but much to compare, so small partitions must not be put together.
        lefts, rights = (t.repartition(partitions, *keys) for t in (lefts, rights))
    return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(kernel, shape)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"), "r_tie")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tree_join(
    left: DataFrame, right: DataFrame, k: int, window: int = 1, fan: int = FAN, leaf: int = LEAF, compared: list | None = None
) -> DataFrame:
    """The k most similar right rows of each left row in its edition window.

    ``left(l_item, l_seq, l_vec)`` and ``right(r_item, r_seq, r_tie, r_vec)``,
    with one unit vector per item and one row per item and edition. Ties rank by
    ``r_tie``. Returns (l_item, l_seq, r_item, r_seq, r_tie, sim, rank).
    ``compared``, if given, receives the pairs of items compared in each turn.
    """
    # At most one entry for each edition.
    occurs = F.sort_array(F.collect_list(F.struct(F.col("r_seq").cast("long").alias("seq"), F.col("r_tie").alias("tie"))))
    items = right.groupBy("r_item").agg(F.first("r_vec").alias("r_vec"), occurs.alias("met"))
    items = cut(items.withColumn("mask", _bits(F.transform("met", lambda m: m["seq"]))))
    asked = left.groupBy("l_item").agg(F.first("l_vec").alias("l_vec"), F.sort_array(F.collect_set(F.col("l_seq").cast("long"))).alias("l_seqs"))
    queries = cut(asked.withColumn("mask", _bits(F.col("l_seqs"), window)).withColumn("radius", F.lit(math.inf)))
    leaves, nodes = build(items, fan, leaf)
    placed = cut(leaves.select("r_item", "node").join(items.select("r_item", "r_vec", "met"), "r_item"))

    def result(hits: DataFrame) -> DataFrame:
        return hits.select("l_item", F.col("l_seq").cast(left.schema["l_seq"].dataType), "r_item", F.col("r_seq").cast(right.schema["r_seq"].dataType), "r_tie", "sim", "rank")

    if nodes.isEmpty():
        every = queries.select("l_item", F.lit(0).cast("long").alias("node"))
        return result(_best(_compare(every, queries, placed, k, window, compared), k))
    first = cut(_descend(queries, nodes, BEAM, fan))
    hits = cut(_best(_compare(first, queries, placed, k, window, compared), k).drop("rank"))
    radius = _radii(hits, queries, k)
    n_items = placed.count()
    if _much_is_left(radius, nodes, n_items, fan):
        n_blocks = math.ceil(queries.count() / DENSE_LEFT) * math.ceil(n_items / DENSE_RIGHT)
        every = radius.select("l_item", F.lit(0).cast("long").alias("node"))
        everything = placed.withColumn("node", F.lit(0).cast("long"))
        return result(_best(_compare(every, radius, everything, k, window, compared, DENSE_LEFT, DENSE_RIGHT, min(2 * n_blocks, DENSE_PARTITIONS)), k))
    open_ = cut(_descend(radius, nodes, None, fan).join(first.select("l_item", "node"), ["l_item", "node"], "left_anti"))
    turn = 1
    while True:
        order = Window.partitionBy("l_item").orderBy("bound", "node")
        ranked = cut(open_.join(radius.select("l_item", "radius"), "l_item").filter("bound <= radius").drop("radius").withColumn("_j", F.row_number().over(order)))
        release(open_)
        now = ranked.filter(F.col("_j") <= turn)
        if now.isEmpty():
            return result(_best(hits, k))
        more = _compare(now, radius, placed, k, window, compared)
        former, hits = hits, cut(_best(hits.unionByName(more), k).drop("rank"))
        release(former)
        open_ = cut(ranked.filter(F.col("_j") > turn).drop("_j"))
        release(ranked)
        radius = _radii(hits, queries, k)
        turn *= 2


def _radii(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``queries`` with the distance beyond which nothing can rank, over all editions asked for."""
    worst = hits.groupBy("l_item", "l_seq").agg(F.count("*").alias("_n"), F.min("sim").alias("_sim"))
    full = worst.filter(F.col("_n") >= k).groupBy("l_item").agg(F.count("*").alias("_full"), F.min("_sim").alias("_sim"))
    reach = F.when(F.col("_full") == F.size("l_seqs"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_sim"))) + SLACK)
    return cut(queries.join(full, "l_item", "left").withColumn("radius", F.coalesce(reach, F.lit(math.inf))).drop("_full", "_sim"))


def _much_is_left(queries: DataFrame, nodes: DataFrame, n_items: int, fan: int) -> bool:
    """Whether the radius leaves to a few ``queries`` so many pairs that going by leaves does not pay."""
    tried = cut(queries.orderBy(F.xxhash64("l_item"), "l_item").limit(TRIED))
    reached = _descend(tried, nodes, None, fan).join(nodes.select("node", "n"), "node")
    pairs = reached.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return pairs >= DENSE * n_items * tried.count()
