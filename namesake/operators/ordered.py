"""Order-dependent operators without a window over one large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.session import cut

# Bits that monotonically_increasing_id leaves for the row within a partition.
_ROW_BITS = 33


def dense_index(
    df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Number all rows 0, 1, 2, ... by a unique order.

    Range partitioning keeps every task bounded whatever the key skew; only the
    row count of each partition meets on the driver. Only ``carry`` is kept
    where it is given, so that long columns to order by aren't written.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = placed.sortWithinPartitions(*order)
    placed = cut(placed.select(*(carry or df.columns), F.monotonically_increasing_id().alias("_row")))
    row = F.col("_row")
    counts = (
        placed.groupBy(F.shiftright(row, _ROW_BITS).alias("part"))
        .agg(F.count("*").alias("rows"))
        .orderBy("part")
        .collect()
    )
    starts, total = [], 0
    for c in counts:
        starts.append((c["part"], total))
        total += c["rows"]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    within = row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", F.shiftright(row, _ROW_BITS))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_start", "_row")
    )


def with_next(df: DataFrame, group: list[str], order: list[str], carry: list[str], prefix: str = "next_") -> DataFrame:
    """Attach columns of the following row of the same group, null on its last row.

    Rows are numbered over (group, order) and joined on consecutive numbers,
    which never repeat, so a group of any size spreads over all tasks.
    """
    ranked = dense_index(df, [*group, *order], "_idx")
    following = ranked.select(
        (F.col("_idx") - 1).alias("_idx"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        *[F.col(c).alias(f"{prefix}{c}") for c in carry],
    )
    joined = ranked.join(following, "_idx", "left")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return joined.select(
        *df.columns,
        *[F.when(same, F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in carry],
    )


def renumber(df: DataFrame, key: str, first: Column, name: str) -> DataFrame:
    """Dense numbers for ``key`` in the order of its first appearance.

    ``first`` is a column (or struct) that orders rows uniquely.
    """
    firsts = df.groupBy(key).agg(F.min(first).alias("_first"))
    numbers = dense_index(firsts, ["_first"], name).drop("_first")
    return df.join(numbers, key)


#: Rows of one block of an order; a group in several blocks carries one row for each.
BLOCK = 65_536


def running_totals(df: DataFrame, group: list[str], order: list[str], sums: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``sums`` as running totals of each group in a unique order.

    Totals run within blocks of the whole order, and a group in several blocks
    carries one row for each of them, so no task holds a group as a whole.
    """
    placed = dense_index(df, [*group, *order], "_idx").withColumn("_block", F.floor(F.col("_idx") / block))
    key = F.struct(*group)
    placed = placed.withColumn("_group", key)
    parts = placed.groupBy("_block", "_group").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_block", "_group", *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    within = Window.partitionBy("_block", "_group").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.select("*", *[F.sum(s).over(within).alias(f"_r_{s}") for s in sums])
    joined = inner.join(carried, ["_block", "_group"])
    return joined.select(
        *[c for c in df.columns if c not in sums], *[(F.col(f"_b_{s}") + F.coalesce(f"_r_{s}", F.lit(0))).alias(s) for s in sums]
    )


def run_starts(df: DataFrame, group: list[str], order: list[str], value: str, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the ``key`` of the first row of the run of equal ``value`` in which a row stands.

    Runs are looked for in the whole order of (group, order), which must be
    unique, so a group of any size spreads over all tasks.
    """
    placed = dense_index(df, [*group, *order], "_idx").withColumn("_block", F.floor(F.col("_idx") / block))
    earlier = placed.select((F.col("_idx") + 1).alias("_idx"), F.struct(*group, value).alias("_was"))
    goes_on = F.coalesce(F.struct(*group, value).eqNullSafe(F.col("_was")), F.lit(False))
    marked = placed.join(earlier, "_idx", "left").withColumn("_start", F.when(~goes_on, F.struct("_idx", F.col(key).alias("_key")))).drop("_was")
    # One row for each block.
    lasts = marked.groupBy("_block").agg(F.max("_start").alias("_last"))
    lasts = lasts.select("_block", F.max("_last").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = Window.partitionBy("_block").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("_here", F.max("_start").over(within)).join(lasts, "_block")
    return found.select(*df.columns, F.coalesce("_here", "_before")["_key"].alias(name))
