"""Exact Jaccard k-nearest join of token sets of any length.

Tokens are numbered from the rarest to the most frequent, and sets are sorted by
these numbers. Two sets that share a token have a first one in common, and what
they share lies in their suffixes from there on. So the index holds, for each
token of a right set, the suffix that begins with it. Right sets with the same
suffix and the same size are equally like any left set that meets them there:
the first k of them in each edition are enough, as a later one is outranked by k
others. A frequent token therefore has few different suffixes, however many sets
hold it, and a rare one has few sets.

The search goes through falling limits. Sets alike to a limit ``t`` share a token
among the first ``n - ceil(t n) + 1`` of either; sizes and the tokens left behind
a shared one bound the likeness. A left set that has k hits at the limit is done.
For the others the limit falls, and their k-th likeness so far keeps out what
cannot rank. The last limit is 0, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.operators.components import join_counted
from namesake.operators.editions import bucket_of, in_window, window_buckets
from namesake.operators.ordered import dense_index
from namesake.session import cut, release

LIMITS = (0.6, 0.3, 0.1, 0.0)
#: Similarities are compared at this many decimals.
DECIMALS = 9


def _numbered(sets: DataFrame, item: str, ranks: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(item, size, toks): the numbers of a set's tokens, rising; those without a number only count in the size.

    ``held(token, n)``, if known, says how many of the sets have a token.
    """
    tokens = sets.select(item, F.size("vec").alias("size"), F.explode("vec").alias("token"))
    if held is None:
        held = cut(tokens.groupBy("token").agg(F.count("*").alias("n")))
    known = held.withColumnRenamed("n", "_n").join(ranks, "token")
    found = join_counted(tokens, known, "token", "_n", tokens.count())
    return found.groupBy(item, "size").agg(F.sort_array(F.collect_list("idx")).alias("toks"))


def _suffixes(sets: DataFrame) -> DataFrame:
    """(r_item, size, place, token, suffix) for every token; ``suffix`` names the tokens from there on."""
    kind = sets.schema["r_item"].dataType.simpleString()

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            n = np.diff(toks.offsets.to_numpy())
            flat = toks.flatten().to_numpy()
            owner, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            # Sums from a place to the end of its set; the order of a set follows from its tokens.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(flat.astype(np.uint64)), dtype=np.uint64)])
            suffix = (sums[ends[owner]] - sums[np.arange(len(flat))]).view(np.int64)
            place = np.arange(len(flat)) - (ends - n)[owner]
            yield pa.RecordBatch.from_arrays(
                [batch.column("r_item").take(pa.array(owner)), batch.column("size").take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(flat), pa.array(suffix)],
                names=["r_item", "r_size", "r_place", "token", "suffix"],
            )

    return sets.select("r_item", "size", "toks").mapInArrow(run, f"r_item {kind}, r_size int, r_place int, token long, suffix long")


def _prefix(size: Column, limit: float) -> Column:
    """How many first tokens of a set two sets alike to ``limit`` must meet in."""
    return size - F.ceil(size * limit - 1e-9) + 1


def _index(sets: DataFrame, asked: DataFrame, occurs: DataFrame, k: int, window: int) -> DataFrame:
    """Suffixes of one token with the first k sets per edition that have them, for the tokens that left sets ask for.

    Places and suffixes are those within the whole sets.
    """
    rows = _suffixes(sets).join(asked, "token", "left_semi").join(occurs, "r_item")
    first = Window.partitionBy("token", "suffix", "r_size", "r_seq").orderBy("r_tie")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    return kept.withColumn("bucket", bucket_of(F.col("r_seq"), window)).groupBy("token", "bucket", "suffix", "r_size", "r_place").agg(
        F.sort_array(F.collect_list(F.struct("r_tie", "r_seq", "r_item"))).alias("entries"), F.min("r_item").alias("like")
    )


def set_join(left: DataFrame, right: DataFrame, k: int, window: int = 1, limits: Sequence[float] = LIMITS, compared: list | None = None) -> DataFrame:
    """The k right sets with the highest Jaccard index, above 0, per left set in its edition window.

    ``left(l_item, l_seq, l_vec)`` and ``right(r_item, r_seq, r_tie, r_vec)``
    with distinct tokens, one set per item and one row per item and edition. Ties
    rank by ``r_tie``. Returns (l_item, l_seq, r_item, r_seq, r_tie, sim, rank).
    ``compared``, if given, receives the sets compared for each limit.
    """
    rights = cut(right.groupBy("r_item").agg(F.first("r_vec").alias("vec")))
    lefts = cut(left.groupBy("l_item").agg(F.first("l_vec").alias("vec")))
    frequency = cut(rights.select(F.explode("vec").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    ranks = cut(dense_index(frequency, ["n", "token"]).select("token", "idx"))
    r_sets, l_sets = cut(_numbered(rights, "r_item", ranks, frequency)), cut(_numbered(lefts, "l_item", ranks))
    asked_for = cut(l_sets.select(F.explode("toks").alias("token")).distinct())
    index = cut(_index(r_sets, asked_for, right.select("r_item", "r_seq", "r_tie"), k, window))
    # What can be shared of a right set.
    r_asked = cut(r_sets.select(F.col("r_item").alias("like"), F.explode("toks").alias("token")).join(asked_for, "token", "left_semi").groupBy("like").agg(F.collect_list("token").alias("_r")))
    probes = l_sets.select("l_item", F.col("size").alias("l_size"), F.size("toks").alias("l_known"), F.posexplode("toks").alias("l_place", "token"))
    # Queries with their k-th likeness so far; those that are done are left out.
    open_ = cut(left.select("l_item", "l_seq").withColumn("floor", F.lit(0.0)))
    hits: DataFrame | None = None
    before = None
    for limit in limits:
        i, j, m, n = F.col("l_place"), F.col("r_place"), F.col("l_size"), F.col("r_size")

        def admitted(t: float) -> Column:
            return (i < _prefix(m, t)) & (j < _prefix(n, t))

        # Written, so that its size is known: where few ask, the index stays where it lies.
        asked = cut(open_.join(probes, "l_item").filter(i < _prefix(m, limit)).withColumn("bucket", F.explode(window_buckets(F.col("l_seq"), window))))
        met = asked.join(index.filter(j < _prefix(n, limit)), ["token", "bucket"])
        most = F.least(F.col("l_known") - i, n - j)
        bound = most / (m + n - most)
        met = met.filter((bound >= limit - 1e-9) & (bound >= F.col("floor") - 1e-9))
        if before is not None:
            bound_before = (bound >= before - 1e-9) & admitted(before)
            met = met.filter(~bound_before)
        met = cut(met.withColumn("entries", F.filter("entries", lambda e: in_window(F.col("l_seq"), e["r_seq"], window))).filter(F.size("entries") > 0)
                  .select("l_item", "l_seq", "l_size", "l_place", "token", "r_size", "r_place", "like", "floor", "entries"))
        pairs = met.select("l_item", "like", "l_place", "r_place", "token").distinct()
        if compared is not None:
            compared.append(pairs.count())
        sided = pairs.join(l_sets.select("l_item", F.col("toks").alias("_l")), "l_item").join(r_asked, "like")
        # Tokens behind the one they met at have higher numbers.
        shared = F.size(F.filter(F.array_intersect("_l", "_r"), lambda t: t >= F.col("token")))
        counted = sided.select("l_item", "like", "l_place", "r_place", shared.alias("shared"))
        alike = met.join(counted, ["l_item", "like", "l_place", "r_place"])
        alike = alike.withColumn("sim", F.round(F.col("shared") / (m + n - F.col("shared")), DECIMALS))
        found = alike.filter(F.col("sim") >= F.col("floor")).select("l_item", "l_seq", "sim", F.explode(F.slice("entries", 1, k)).alias("e"))
        found = found.select("l_item", "l_seq", F.col("e.r_item").alias("r_item"), F.col("e.r_seq").alias("r_seq"), F.col("e.r_tie").alias("r_tie"), "sim")
        every = found if hits is None else hits.unionByName(found)
        # A pair met at several tokens is most alike at the first that it shares.
        every = every.groupBy("l_item", "l_seq", "r_item", "r_seq", "r_tie").agg(F.max("sim").alias("sim"))
        former, hits = hits, cut(_best(every, k).drop("rank"))
        release(met)
        release(asked)
        if former is not None:
            release(former)
        worst = hits.groupBy("l_item", "l_seq").agg(F.count("*").alias("_n"), F.min("sim").alias("_least"))
        state = open_.drop("floor").join(worst, ["l_item", "l_seq"], "left")
        full = F.coalesce(F.col("_n") >= k, F.lit(False))
        left_open = cut(state.filter(~(full & (F.col("_least") >= limit))).select("l_item", "l_seq", F.when(full, F.col("_least")).otherwise(F.lit(0.0)).alias("floor")))
        release(open_)
        open_, before = left_open, limit
        if open_.isEmpty():
            break
    assert hits is not None
    return _best(hits, k).select("l_item", "l_seq", "r_item", "r_seq", "r_tie", "sim", "rank")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"), "r_tie")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
