"""Exact Jaccard k-nearest join for short token sets.

Two sets meet through the subsets they share. All right sets of one size that
contain one subset are equally good or better matches for a left set than that
subset alone promises, so the first k of them by tie order are enough: a later
one is outranked by k others. Lists therefore stay at k entries per edition
however common a token is, and no pair is formed for a common token alone.
Sets too long to enumerate go through ``nearest_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.operators.editions import bucket_of, in_window, window_buckets
from namesake.operators.nearest import CELL_ROWS, nearest_join

SUBSET_SEP = "\u0001"
# A set of n tokens has 2^n - 1 subsets.
MAX_TOKENS = 8


def subsets(tokens: Column) -> Column:
    """All non-empty subsets of a sorted token array, each joined to one key."""
    empty = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(
        tokens,
        empty,
        lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))),
    )
    return F.filter(grown, lambda s: F.size(s) > 0)


def _short_join(left: DataFrame, right: DataFrame, k: int, window: int) -> DataFrame:
    key = F.struct(F.size("subset").alias("n_shared"), F.array_join("subset", SUBSET_SEP).alias("subset"))
    first_k = Window.partitionBy("subset", "r_size", "r_seq").orderBy("r_tie")
    index = (
        right.select("r_item", "r_seq", "r_tie", F.size("r_vec").alias("r_size"), F.explode(subsets(F.col("r_vec"))).alias("subset"))
        .withColumn("subset", F.array_join("subset", SUBSET_SEP))
        .withColumn("n", F.row_number().over(first_k))
        .filter(F.col("n") <= k)
        .withColumn("bucket", bucket_of(F.col("r_seq"), window))
        .groupBy("subset", "bucket", "r_size")
        .agg(F.sort_array(F.collect_list(F.struct("r_tie", "r_seq", "r_item"))).alias("entries"))
    )
    probes = (
        left.select("l_item", "l_seq", F.size("l_vec").alias("l_size"), F.explode(subsets(F.col("l_vec"))).alias("subset"))
        .select("l_item", "l_seq", "l_size", key.alias("key"))
        .select("l_item", "l_seq", "l_size", "key.*")
        .withColumn("bucket", F.explode(window_buckets(F.col("l_seq"), window)))
    )
    # One list holds at most k entries per edition of the bucket.
    lists = probes.join(index, ["subset", "bucket"]).select(
        "l_item",
        "l_seq",
        (F.col("n_shared") / (F.col("l_size") + F.col("r_size") - F.col("n_shared"))).alias("sim"),
        F.slice(F.filter("entries", lambda e: in_window(F.col("l_seq"), e["r_seq"], window)), 1, k).alias("entries"),
    )
    # A list with k entries promises k hits at least this similar.
    floor = F.max(F.when(F.size("entries") >= k, F.col("sim"))).over(Window.partitionBy("l_item", "l_seq"))
    kept = lists.withColumn("floor", floor).filter(F.col("sim") >= F.coalesce("floor", F.lit(0.0)))
    hits = kept.select("l_item", "l_seq", "sim", F.explode("entries").alias("e"))
    return hits.groupBy("l_item", "l_seq", F.col("e.r_item").alias("r_item"), F.col("e.r_seq").alias("r_seq"), F.col("e.r_tie").alias("r_tie")).agg(
        F.round(F.max("sim"), 9).alias("sim")
    )


def nearest_sets(
    left: DataFrame, right: DataFrame, k: int, window: int = 1, strategy: str = "auto", max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """The k right sets with the highest Jaccard index, above 0, per left set.

    Columns as in ``nearest_join``, with sorted distinct token arrays.
    ``strategy`` is ``subsets``, ``blocks`` or ``auto``: right sides that fit
    one cell are compared directly.
    """
    if strategy == "auto":
        strategy = "blocks" if right.count() <= CELL_ROWS else "subsets"
    if strategy == "blocks":
        return nearest_join(left, right, k, "jaccard", window)
    short_left, short_right = F.size("l_vec") <= max_tokens, F.size("r_vec") <= max_tokens
    hits = _short_join(left.filter(short_left), right.filter(short_right), k, window)
    cols = hits.columns
    long_right = right.filter(~short_right)
    if not long_right.isEmpty():
        hits = hits.unionByName(nearest_join(left, long_right, k, "jaccard", window).select(*cols))
    long_left = left.filter(~short_left)
    if not long_left.isEmpty():
        hits = hits.unionByName(nearest_join(long_left, right.filter(short_right), k, "jaccard", window).select(*cols))
    order = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"), "r_tie")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
