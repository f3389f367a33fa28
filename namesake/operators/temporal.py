"""Breaks of a cluster over time: consecutive rows that are not matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.operators.guarantee import matches
from namesake.operators.ordered import with_next
from namesake.spec import LinkageSpec


def adjacent_breaks(members: DataFrame, edges: DataFrame, cluster: str, max_diff: float) -> DataFrame:
    """Add ``next_record_id`` and ``is_break`` to every member row.

    ``members(record_id, seq, year, gkey, <cluster>)`` in the order (seq,
    record_id). Two rows are matched by an edge ``(src, dst)``, src < dst, or
    by an equal, non-null ``gkey`` within the year bound.
    """
    rows = with_next(members, [cluster], ["seq", "record_id"], ["record_id", "year", "gkey"])
    nxt = F.col("next_record_id")
    linked = edges.select("src", "dst", F.lit(True).alias("_linked"))
    probed = rows.withColumns({"src": F.least("record_id", nxt), "dst": F.greatest("record_id", nxt)}).join(
        linked, ["src", "dst"], "left"
    )
    same_key = matches(F.col("gkey"), F.col("year"), F.col("next_gkey"), F.col("next_year"), max_diff)
    broken = nxt.isNotNull() & ~same_key & F.col("_linked").isNull()
    return probed.select(*members.columns, "next_record_id", broken.alias("is_break"))


def break_counts(
    members: DataFrame, edges: DataFrame, cluster: str, max_diff: float, denominator: str = "rows"
) -> DataFrame:
    """(cluster, n_rows, breaks, ratio); the ratio is over rows or over row pairs."""
    rows = adjacent_breaks(members, edges, cluster, max_diff)
    counts = rows.groupBy(cluster).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("is_break").cast("long")).alias("breaks")
    )
    n = F.col("n_rows") if denominator == "rows" else F.greatest(F.col("n_rows") - 1, F.lit(1))
    return counts.withColumn("ratio", F.col("breaks") / n)


def is_leaf(spec: LinkageSpec) -> Column:
    """Whether a cluster stays whole: few and rare breaks, or few rows."""
    calm = (F.col("breaks") <= spec.max_breaks) & (F.col("ratio") <= spec.max_break_ratio)
    return calm | (F.col("n_rows") <= spec.min_size)
