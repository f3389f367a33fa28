"""Edition dimension, edition sampling and edition windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edition_dimension(records: DataFrame, edition: str, record_id: str) -> DataFrame:
    """Editions numbered from 0 in the order their first record appears.

    Only one row per edition reaches the single ordered window.
    """
    firsts = records.groupBy(edition).agg(
        F.min(record_id).alias("first_record"), F.count("*").alias("n_records")
    )
    order = Window.orderBy("first_record")
    return firsts.withColumn("edition_seq", F.row_number().over(order) - 1)


def stride_sample(editions: DataFrame, wanted: int, seq: str = "edition_seq") -> DataFrame:
    """Every n-th edition, where n is the edition count over ``wanted``."""
    total = editions.agg(F.count("*").alias("total"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / wanted))
    return editions.join(F.broadcast(total), F.lit(True)).filter(F.col(seq) % step == 0).drop("total")


def window_buckets(seq: Column, window: int) -> Column:
    """Buckets of ``window`` editions that the window starting at ``seq`` meets.

    A record is stored once, under ``bucket_of``; a window reaches at most two
    buckets, so a band condition becomes an equality with two probes.
    """
    first = F.floor(seq / window)
    last = F.floor((seq + (window - 1)) / window)
    return F.sequence(first, last)


def bucket_of(seq: Column, window: int) -> Column:
    return F.floor(seq / window)


def in_window(left_seq: Column, right_seq: Column, window: int) -> Column:
    return (right_seq >= left_seq) & (right_seq < left_seq + window)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Equality join on ``keys`` within the edition window.

    Columns other than ``keys`` must differ between the sides; the editions are
    ``l_seq`` and ``r_seq``.
    """
    probes = left.withColumn("_bucket", F.explode(window_buckets(F.col("l_seq"), window)))
    stored = right.withColumn("_bucket", bucket_of(F.col("r_seq"), window))
    joined = probes.join(stored, [*keys, "_bucket"])
    return joined.filter(in_window(F.col("l_seq"), F.col("r_seq"), window)).drop("_bucket")


def window_sizes(records: DataFrame, seq: str, window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per edition (and key): how many records its window holds, itself included.

    Counts are taken per edition first, so no pair is formed.
    """
    cells = records.groupBy(*keys, F.col(seq).alias("l_seq")).agg(F.count("*").alias("n"))
    others = cells.withColumnsRenamed({"l_seq": "r_seq", "n": "r_n"})
    joined = window_join(cells, others, list(keys), window)
    return joined.groupBy(*keys, "l_seq", "n").agg(F.sum("r_n").alias("n_window"))
