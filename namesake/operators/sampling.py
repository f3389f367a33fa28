"""Reproducible samples and diverse selections."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.functions.vectors import vote_entropy
from namesake.operators.ordered import dense_index
from namesake.session import cut, release

# Entropies and distances are ranked at this many decimals, so that equal ones
# tie whatever order they were computed in.
DECIMALS = 9
#: Points that one job of the farthest-first fill brings to the driver.
FARTHEST = 64


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of ids."""
    return F.md5(F.concat_ws("_", F.lit(seed), key.cast("string")))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same on every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def bootstrap_counts(rows: DataFrame, key: str, members: int, seed: int = 42) -> DataFrame:
    """(member, key, times): n draws with replacement per member from n rows."""
    numbered = dense_index(rows.select(key), [key], "_slot")
    n = numbered.count()
    draw = F.concat_ws("_", F.lit(seed), F.col("id").cast("string"))
    number = F.conv(F.substring(F.md5(draw), 1, 8), 16, 10).cast("long")
    draws = rows.sparkSession.range(n * members).select(
        (F.col("id") % members).cast("int").alias("member"), (number % n).alias("_slot")
    )
    counted = draws.groupBy("member", "_slot").agg(F.count("*").alias("times"))
    return counted.join(numbered, "_slot").select("member", key, "times")


def uncertain_pool(scored: DataFrame, labelled: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """The ``n`` unlabelled rows whose vote share ``predicted`` is least decided."""
    open_rows = scored.join(labelled.select(key), key, "left_anti")
    ranked = open_rows.withColumn("uncertainty", vote_entropy(F.col("predicted")))
    return ranked.orderBy(F.desc(F.round("uncertainty", DECIMALS)), key).limit(n)


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centre and scale columns by population deviation; constants become 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"_avg_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_std_{c}") for c in cols]
    )
    joined = df.join(F.broadcast(stats), F.lit(True))
    scaled = {
        c: (F.col(c) - F.col(f"_avg_{c}")) / F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(1.0) for c in cols
    }
    return joined.withColumns(scaled).select(*df.columns)


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def k_centre_fill(points: DataFrame, chosen: DataFrame, total: int, key: str = "pair_id", at_once: int = FARTHEST) -> DataFrame:
    """Extend ``chosen(key)`` to ``total`` rows, each time by the point farthest
    from all chosen so far; ties go to the lowest key.

    ``points(key, vec)``. Without a start the point farthest from the mean
    opens. A job brings the ``at_once`` farthest points to the driver. Gaps only
    shrink, so the last of these bounds all points that stayed behind: as long
    as the best of those at hand is not below it, it is the next pick, and the
    others at hand are measured again. Only then all points are.
    """
    picked = chosen.join(points, key).select(key, "vec")
    have = [(r[key], r["vec"]) for r in picked.orderBy(key).limit(total).collect()]
    if have:
        nearest = F.array_min(F.array(*[distance(F.col("vec"), F.array(*map(F.lit, v))) for _, v in have]))
    else:
        n = len(points.first()["vec"])
        mean = points.agg(*[F.avg(F.col("vec")[i]) for i in range(n)]).first()
        nearest = distance(F.col("vec"), F.array(*map(F.lit, mean)))
    state = cut(points.join(chosen.select(key), key, "left_anti").select(key, "vec", nearest.alias("gap")))
    ids = [i for i, _ in have]
    fresh = not have
    while len(ids) < total:
        # The first pick of all is told by the mean, so what follows must be measured anew.
        rows = state.orderBy(F.desc(F.round("gap", DECIMALS)), key).limit(1 if fresh else at_once).collect()
        if not rows:
            break
        order = lambda gap, row: (-round(gap, DECIMALS), row[key])
        whole = len(rows) < at_once and not fresh
        least = order(rows[-1]["gap"], rows[-1])
        at_hand = [(row["gap"], row) for row in rows]
        new = []
        while at_hand and len(ids) < total:
            gap, row = min(at_hand, key=lambda x: order(*x))
            if not whole and order(gap, row) > least:
                break
            ids.append(row[key])
            new.append(row)
            at_hand = [(min(g, math.dist(r["vec"], row["vec"])), r) for g, r in at_hand if r[key] != row[key]]
        reach = F.array_min(F.array(*[distance(F.col("vec"), F.array(*map(F.lit, row["vec"]))) for row in new]))
        gap = reach if fresh else F.least("gap", reach)
        fresh = False
        former, state = state, cut(state.filter(~F.col(key).isin([row[key] for row in new])).withColumn("gap", gap))
        release(former)
    return points.sparkSession.createDataFrame([(i,) for i in ids], chosen.select(key).schema)


def cluster_representatives(points: DataFrame, k: int, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """(key): for each k-means cluster of ``points(key, vec)`` the row nearest
    to its centre."""
    data = points.select(key, "vec", array_to_vector("vec").alias("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="group").fit(data)
    centres = points.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "group int, centre array<double>"
    )
    grouped = model.transform(data).select(key, "vec", "group").join(F.broadcast(centres), "group")
    gap = F.struct(F.round(distance(F.col("vec"), F.col("centre")), DECIMALS), F.col(key))
    return grouped.groupBy("group").agg(F.min_by(key, gap).alias(key)).select(key)


def diverse_sample(pool: DataFrame, features: list[str], n: int, clusters: int | None = None, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """(key): ``n`` rows of a pool spread over its feature space.

    At most one row per k-means cluster of the standardised features, then the
    rows farthest from those chosen. The pool is bounded by its own selection.
    """
    size = pool.count()
    if n >= size:
        return pool.select(key)
    scaled = standardise(pool.select(key, *features), features)
    points = cut(scaled.select(key, F.array(*features).alias("vec")))
    k = max(1, min(clusters or n, n, size))
    # MLlib asks for at least two clusters.
    first = cluster_representatives(points, max(2, k), seed, key).orderBy(key).limit(k)
    return k_centre_fill(points, cut(first), n, key)
