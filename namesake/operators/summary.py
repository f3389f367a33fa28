"""Entity ids and cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from namesake.functions.text import cluster_key
from namesake.operators.ordered import renumber

# Histogram range and number of bins.
HIST_RANGE = (0, 60)
HIST_BINS = 20


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its row count taken along by whichever job runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def person_ids(records: DataFrame, clusters: DataFrame, paths: DataFrame) -> DataFrame:
    """Preliminary and final entity ids of ``records(record_id, seq, ...)``.

    ``new_person_id`` is the cluster, ``sub_comm`` the part of it a split made
    (null without a split), ``new_person_id_2`` a dense number in the order of
    first appearance.
    """
    found = (
        records.join(clusters.select("record_id", F.col("cluster").alias("new_person_id")), "record_id", "left")
        .withColumn("new_person_id", F.coalesce("new_person_id", "record_id"))
        .join(paths.select("record_id", "path"), "record_id", "left")
    )
    whole = F.col("new_person_id").cast("string")
    sub = F.when(F.col("path") != whole, F.substr("path", F.length(whole) + 2))
    keyed = found.withColumn("sub_comm", sub).drop("path").withColumn(
        "combined", cluster_key(F.col("new_person_id"), F.col("sub_comm"))
    )
    return renumber(keyed, "combined", F.struct("seq", "record_id"), "new_person_id_2").drop("combined")


def cluster_sizes(members: DataFrame, cluster: str, edition: str | None = None) -> DataFrame:
    """(cluster, n_records[, n_editions])."""
    counts = [F.count("*").alias("n_records")]
    if edition:
        counts.append(F.countDistinct(edition).alias("n_editions"))
    return members.groupBy(cluster).agg(*counts)


def size_stats(sizes: DataFrame, column: str = "n_records") -> DataFrame:
    """Number, mean, population deviation and exact median of cluster sizes."""
    n = F.col(column)
    return sizes.agg(
        F.count("*").alias("n_clusters"),
        F.avg(n).alias("mean_size"),
        F.stddev_pop(n).alias("std_size"),
        F.median(n).alias("median_size"),
    )


def size_histogram(sizes: DataFrame, column: str = "n_records") -> DataFrame:
    """(bin, n_clusters) over equal bins; the last bin includes its upper end,
    sizes outside the range are left out."""
    low, high = HIST_RANGE
    width = (high - low) / HIST_BINS
    n = F.col(column)
    slot = F.least(F.floor((n - low) / width), F.lit(HIST_BINS - 1)).cast("int")
    return sizes.filter(n.between(low, high)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n_clusters"))
