"""Edge lists of the match graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """One row per unordered pair, with its highest weight; loops are dropped."""
    return (
        edges.filter(F.col(left) != F.col(right))
        .groupBy(F.least(left, right).alias("src"), F.greatest(left, right).alias("dst"))
        .agg(F.max(weight).alias("weight"))
    )


def model_edges(scored: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """Pairs scored at least ``threshold``, as weighted edges."""
    return undirected(scored.filter(F.col(prob) >= threshold), "left_id", "right_id", prob)


def union_edges(*edges: DataFrame) -> DataFrame:
    """Edges of all lists; a pair in several keeps its highest weight."""
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return undirected(all_edges, "src", "dst", "weight")


def induced(edges: DataFrame, members: DataFrame, cluster: str, record_id: str = "record_id") -> DataFrame:
    """Edges whose two ends lie in the same cluster, with that cluster."""
    a = members.select(F.col(record_id).alias("src"), F.col(cluster))
    b = members.select(F.col(record_id).alias("dst"), F.col(cluster).alias("_other"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.filter(F.col(cluster) == F.col("_other")).drop("_other")
