"""Exact k-nearest join inside an edition window.

Two metrics share one plan: the angle between unit vectors and the Jaccard
distance between token sets. Both obey the triangle inequality, so right rows
are grouped into cells around pivots, and a left row visits only the cells
that can hold one of its k nearest:

1. the cells around it give k hits and with them a search radius,
2. the other cells whose ring of distances reaches into that radius follow.

A cell is cut into blocks of bounded size on both sides, so no task receives
more than one block pair however many rows share a cell. No pair is shuffled;
each task returns at most k rows per left row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesake.functions.vectors import rows_of
from namesake.operators.editions import bucket_of, window_buckets
from namesake.session import cut

# Rows of the two sides of one block; sets take more room than vectors.
BLOCKS = {"cosine": (8192, 16384), "jaccard": (1024, 4096)}
MIN_BLOCK = 256
# Left rows compared at once inside a block.
SLICE = 1024
# Wanted right rows per cell, and the limit on cells.
CELL_ROWS = 4096
MAX_PIVOTS = 2048
# Limit on the (bucket, cell) statistics that meet on the driver.
MAX_STATS = 200_000
# Similarities are compared at this many decimals, so that ties break the same
# way whatever order a sum was taken in.
DECIMALS = 9
# Width of the vocabulary slice of one set-overlap product.
VOCAB_SLICE = 4096


def angular_sims(left: pa.Array, right: pa.Array) -> np.ndarray:
    return rows_of(left) @ rows_of(right).T


def overlap_sims(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Jaccard index of every left set with every right set."""
    sizes = [np.diff(side.offsets.to_numpy()) for side in (left, right)]
    flat = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    codes = flat.indices.to_numpy()
    n_left = int(sizes[0].sum())
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    codes = [codes[:n_left], codes[n_left:]]
    shared = np.intersect1d(codes[0], codes[1])
    position = np.full(len(flat.dictionary) + 1, -1)
    position[shared] = np.arange(len(shared))
    columns = [position[c] for c in codes]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(shared), VOCAB_SLICE):
        width = min(VOCAB_SLICE, len(shared) - start)
        marks = []
        for side, n in enumerate((len(left), len(right))):
            inside = (columns[side] >= start) & (columns[side] < start + width)
            mark = np.zeros((n, width), dtype=np.float32)
            mark[rows[side][inside], columns[side][inside] - start] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    both = both.astype(np.float64)
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


# Per metric: similarity of two columns, distance of a similarity, and whether
# a similarity of 0 counts as a hit.
METRICS = {
    "cosine": (angular_sims, lambda s: np.arccos(np.clip(s, -1.0, 1.0)), True),
    "jaccard": (overlap_sims, lambda s: 1.0 - s, False),
}


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _block_kernel(metric: str, k: int, window: int):
    sims_of, _, zero_counts = METRICS[metric]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [left.schema.field("l_item"), left.schema.field("l_seq")]
            + [right.schema.field(c) for c in ("r_item", "r_seq", "r_tie")]
            + [pa.field("sim", pa.float64())]
        )
        if not len(left) or not len(right):
            return schema.empty_table()
        right = right.sort_by("r_tie")
        vecs, r_seq = _whole(right["r_vec"]), right["r_seq"].to_numpy()[None, :]
        lefts, rights, values = [], [], []
        for start in range(0, len(left), SLICE):
            part = left.slice(start, SLICE)
            sims = np.round(sims_of(_whole(part["l_vec"]), vecs), DECIMALS)
            l_seq = part["l_seq"].to_numpy()[:, None]
            out = (r_seq < l_seq) | (r_seq >= l_seq + window)
            if not zero_counts:
                out |= sims <= 0
            sims[out] = -np.inf
            for i, row in enumerate(sims):
                if len(row) > k:
                    kth = -np.partition(-row, k - 1)[k - 1]
                    hits = np.flatnonzero((row >= kth) & (row > -np.inf))
                else:
                    hits = np.flatnonzero(row > -np.inf)
                hits = hits[np.argsort(-row[hits], kind="stable")[:k]]
                lefts.append(np.full(len(hits), start + i))
                rights.append(hits)
                values.append(row[hits])
        lefts, rights = np.concatenate(lefts), np.concatenate(rights)
        return pa.table(
            [left[c].take(pa.array(lefts)) for c in ("l_item", "l_seq")]
            + [right[c].take(pa.array(rights)) for c in ("r_item", "r_seq", "r_tie")]
            + [pa.array(np.concatenate(values))],
            schema=schema,
        )

    return kernel


def _assigner(metric: str, pivots: pa.Array):
    """Adds to each right row its nearest pivot and the distance to it."""
    sims_of, distance, _ = METRICS[metric]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distance(sims_of(_whole(batch.column("r_vec")), pivots))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "d"],
            )

    return assign


def _prober(metric: str, pivots: pa.Array, stats: dict, k: int, window: int, far: bool):
    """Repeats each left row once per (bucket, cell) it visits.

    With ``far`` unset these are the nearest cells that together hold enough
    rows; with it, all others whose ring meets the radius ``theta``.
    """
    sims_of, distance, zero_counts = METRICS[metric]
    # Slack against rounding of distances.
    slack = 1e-6

    def probe(batches):
        for batch in batches:
            d_all = distance(sims_of(_whole(batch.column("l_vec")), pivots))
            seqs = batch.column("l_seq").to_numpy()
            theta = batch.column("theta").to_numpy() if far else None
            take, buckets, cells = [], [], []
            for i, (d, seq) in enumerate(zip(d_all, seqs)):
                met = [b for b in {int(seq) // window, (int(seq) + window - 1) // window} if b in stats]
                if not met:
                    continue
                held = sum(stats[b][0] for b in met)
                order = np.argsort(d, kind="stable")
                enough = np.searchsorted(np.cumsum(held[order]), 2 * k) + 1
                near = np.zeros(len(d), dtype=bool)
                near[order[:enough]] = True
                for b in met:
                    count, inner, outer = stats[b]
                    if far:
                        gap = np.maximum(d - outer, inner - d) - slack
                        wanted = (gap <= theta[i]) & ~near
                        if not zero_counts:
                            wanted &= gap < 1
                    else:
                        wanted = near
                    for c in np.flatnonzero(wanted & (count > 0)):
                        take.append(i)
                        buckets.append(b)
                        cells.append(int(c))
            rows = batch.select(["l_item", "l_seq", "l_vec"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(buckets, pa.int64()), pa.array(cells, pa.int32())],
                names=[*rows.schema.names, "bucket", "cell"],
            )

    return probe


def _add(schema: T.StructType, *fields: tuple) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t) for n, t in fields])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"), "r_tie")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _layout(met: list, tasks: int, metric: str) -> list:
    """Blocks per (bucket, cell): no larger than allowed, and small enough that
    a few large cells still occupy all tasks."""
    left_block, right_block = BLOCKS[metric]
    while True:
        layout = [(b, c, math.ceil(n / left_block), math.ceil(m / right_block)) for b, c, n, m in met]
        if sum(n * m for _, _, n, m in layout) >= 2 * tasks or right_block <= MIN_BLOCK:
            return layout
        right_block //= 2


def _run_blocks(probes: DataFrame, right: DataFrame, sizes: list, metric: str, k: int, window: int) -> DataFrame:
    """Compare probes with the right rows of their (bucket, cell), block by block."""
    spark = probes.sparkSession
    by_cell = {(r["bucket"], r["cell"]): r["n"] for r in sizes}
    left_counts = probes.groupBy("bucket", "cell").agg(F.count("*").alias("n")).collect()
    met = [(r["bucket"], r["cell"], r["n"], by_cell[r["bucket"], r["cell"]]) for r in left_counts if (r["bucket"], r["cell"]) in by_cell]
    layout = _layout(met, spark.sparkContext.defaultParallelism, metric)
    # At most MAX_STATS rows.
    layout = F.broadcast(spark.createDataFrame(layout, "bucket long, cell int, n_left long, n_right long"))

    def placed(side: DataFrame, item: str, seq: str, own: str, other: str) -> DataFrame:
        spread = side.join(layout, ["bucket", "cell"])
        return (
            spread.withColumn(f"{own}_block", F.pmod(F.xxhash64(item, seq), F.col(f"n_{own}")))
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
            .drop("n_left", "n_right")
        )

    keys = ["bucket", "cell", "left_block", "right_block"]
    lefts = placed(probes, "l_item", "l_seq", "left", "right")
    rights = placed(right, "r_item", "r_seq", "right", "left")
    kinds = {f.name: f.dataType for f in (*probes.schema.fields, *right.schema.fields)}
    out = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("l_item", "l_seq", "r_item", "r_seq", "r_tie")]
        + [T.StructField("sim", T.DoubleType())]
    )
    pairs = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys))
    return pairs.applyInArrow(_block_kernel(metric, k, window), out)


def nearest_join(left: DataFrame, right: DataFrame, k: int, metric: str, window: int = 1, pivots: int | None = None) -> DataFrame:
    """The k most similar right rows of each left row in its edition window.

    ``left(l_item, l_seq, l_vec)`` and ``right(r_item, r_seq, r_tie, r_vec)``
    are scanned several times: pass written tables or plain scans. Vectors must
    be unit vectors, token sets distinct. Ties rank by ``r_tie``.
    Returns ``(l_item, l_seq, r_item, r_seq, r_tie, sim, rank)``.
    """
    right = right.withColumn("bucket", bucket_of(F.col("r_seq"), window))
    # One row per bucket of editions.
    sizes = right.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("cell", F.lit(0)).collect()
    n_pivots = pivots or max(1, min(MAX_PIVOTS, sum(r["n"] for r in sizes) // CELL_ROWS))
    n_pivots = max(1, min(n_pivots, MAX_STATS // max(1, len(sizes))))
    if n_pivots == 1:
        right = right.withColumn("cell", F.lit(0))
        probes = left.withColumn("bucket", F.explode(window_buckets(F.col("l_seq"), window)))
        probes = probes.withColumn("cell", F.lit(0))
        return _best(_run_blocks(probes, right, sizes, metric, k, window), k)

    # At most MAX_PIVOTS rows, picked by hash so that reruns agree.
    picked = right.orderBy(F.xxhash64("r_item", "r_seq"), "r_item", "r_seq").select("r_vec").limit(n_pivots)
    pivot_rows = _whole(picked.toArrow()["r_vec"])
    celled = cut(right.mapInArrow(_assigner(metric, pivot_rows), _add(right.schema, ("cell", T.IntegerType()), ("d", T.DoubleType()))))
    sizes = celled.groupBy("bucket", "cell").agg(
        F.count("*").alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer")
    ).collect()
    stats = {}
    for r in sizes:
        held = stats.setdefault(r["bucket"], tuple(np.zeros(len(pivot_rows)) for _ in range(3)))
        for slot, value in zip(held, (r["n"], r["inner"], r["outer"])):
            slot[r["cell"]] = value
    probe_schema = _add(left.select("l_item", "l_seq", "l_vec").schema, ("bucket", T.LongType()), ("cell", T.IntegerType()))

    def search(rows: DataFrame, far: bool) -> DataFrame:
        probes = cut(rows.mapInArrow(_prober(metric, pivot_rows, stats, k, window, far), probe_schema))
        return _run_blocks(probes, celled, sizes, metric, k, window)

    near = cut(_best(search(left.select("l_item", "l_seq", "l_vec"), far=False), k).drop("rank"))
    worst = F.min("sim")
    radius = F.acos(worst) if metric == "cosine" else 1 - worst
    theta = near.groupBy("l_item", "l_seq").agg(
        F.when(F.count("*") == k, radius).otherwise(F.lit(math.inf)).alias("theta")
    )
    wide = left.join(theta, ["l_item", "l_seq"], "left").withColumn("theta", F.coalesce("theta", F.lit(math.inf)))
    far_hits = search(wide.select("l_item", "l_seq", "l_vec", "theta"), far=True)
    return _best(near.unionByName(far_hits), k)
