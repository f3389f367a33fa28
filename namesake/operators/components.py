"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.session import cut, release

# A key with more rows than this share of the table (and than the minimum) is
# joined by broadcast. At most HOT_SHARE keys can be that frequent.
HOT_SHARE = 1000
HOT_MIN_ROWS = 100_000


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join on a key that may hold much of ``big``.

    ``small`` has one row per key with its number of rows in ``big``. The few
    keys above the threshold are joined where the rows lie; the others shuffle.
    """
    if total <= HOT_MIN_ROWS:
        return big.join(small.drop(count), key)
    at_least = max(HOT_MIN_ROWS, total // HOT_SHARE)
    hot = F.broadcast(small.filter(F.col(count) > at_least).drop(count))
    cold = small.filter(F.col(count) <= at_least).drop(count)
    rest = big.join(hot.select(key), key, "left_anti").join(cold, key)
    return big.join(hot, key).unionByName(rest)


def _lowest_neighbour(arcs: DataFrame, of: str, to: str) -> DataFrame:
    return arcs.groupBy(of).agg(F.min(to).alias("low"), F.count("*").alias("_n")).withColumn("low", F.least("low", of))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every higher neighbour of a node to the lowest one around it."""
    arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest_neighbour(arcs, "u", "v")
    joined = join_counted(arcs, low, "u", "_n", 2 * total)
    # Repeats are left to the other star to remove.
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its lower neighbours to the lowest of them (u > v)."""
    low = _lowest_neighbour(edges, "u", "v")
    joined = join_counted(edges, low, "u", "_n", total)
    lower = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return lower.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    # Folded to 31 bits so that the sum of many rows cannot overflow.
    h = F.pmod(F.xxhash64("u", "v"), F.lit(2**31 - 1))
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first())


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(record_id, cluster): the lowest record id connected to a record.

    ``edges(src, dst)`` is undirected. ``vertices(record_id)`` adds records
    without an edge, each a cluster of its own.
    """
    edges = cut(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    state = _checksum(edges)
    for _ in range(max_rounds):
        former, edges = edges, cut(_small_star(_large_star(edges, state[0]), state[0]))
        release(former)
        before, state = state, _checksum(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    labels = edges.select(F.col("u").alias("record_id"), F.col("v").alias("cluster"))
    if vertices is None:
        roots = edges.select(F.col("v").alias("record_id"), F.col("v").alias("cluster")).distinct()
        return labels.unionByName(roots)
    return vertices.select("record_id").join(labels, "record_id", "left").select(
        "record_id", F.coalesce("cluster", "record_id").alias("cluster")
    )
