"""From scored pairs to entity ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.operators.bisect import split_clusters
from namesake.operators.components import connected_components
from namesake.operators.edges import model_edges, union_edges
from namesake.operators.guarantee import guarantee_links, guarantee_table
from namesake.operators.summary import cluster_sizes, person_ids, size_histogram, size_stats
from namesake.session import cut
from namesake.spec import LinkageSpec


def temporal_members(records: DataFrame, table: DataFrame, clusters: DataFrame, spec: LinkageSpec) -> DataFrame:
    """(record_id, cluster, seq, year, gkey) for the break test and the split."""
    base = records.select(
        F.col(spec.record_id).alias("record_id"),
        F.col(spec.edition_seq).alias("seq"),
        F.col(spec.year).cast("double").alias("year"),
    )
    return base.join(table.select("record_id", "gkey"), "record_id", "left").join(clusters, "record_id")


def resolve(records: DataFrame, spec: LinkageSpec, scored: DataFrame | None = None, variants: DataFrame | None = None, **split) -> DataFrame:
    """Entity ids of every record.

    ``scored(left_id, right_id, prob)`` are the committee's pairs; without it
    only exact-key matches link. Adds ``new_person_id``, ``sub_comm`` and
    ``new_person_id_2`` to ``(record_id, seq, year, edition)``.
    """
    table = cut(guarantee_table(records, spec, variants))
    links = guarantee_links(table, spec.max_year_diff)
    spark = records.sparkSession
    if scored is None:
        found = spark.createDataFrame([], "src long, dst long, weight double")
        everything = links
    else:
        found = cut(model_edges(scored, spec.match_threshold))
        everything = union_edges(found, links)
    ids = records.select(F.col(spec.record_id).alias("record_id"))
    clusters = cut(connected_components(everything, ids))
    members = cut(temporal_members(records, table, clusters, spec))
    paths = cut(split_clusters(members, found, spec, **split))
    base = records.select(
        F.col(spec.record_id).alias("record_id"),
        F.col(spec.edition_seq).alias("seq"),
        F.col(spec.year).alias("year"),
        F.col(spec.edition).alias("edition"),
    )
    return person_ids(base, clusters, paths)


@dataclass
class Summary:
    stats: DataFrame
    histogram: DataFrame


def summarise(resolved: DataFrame, cluster: str) -> Summary:
    """Size statistics and histogram of one id column."""
    sizes = cluster_sizes(resolved, cluster, "edition")
    return Summary(size_stats(sizes), size_histogram(sizes))


def compare(resolved: DataFrame) -> DataFrame:
    """Statistics before and after the temporal split, in records and editions."""
    rows = None
    for cluster in ("new_person_id", "new_person_id_2"):
        sizes = cluster_sizes(resolved, cluster, "edition")
        for column in ("n_records", "n_editions"):
            stats = size_stats(sizes, column).select(F.lit(cluster).alias("ids"), F.lit(column).alias("counted"), "*")
            rows = stats if rows is None else rows.unionByName(stats)
    return rows
