"""Candidate pairs: the nearest records by shape and by sound in a window.

Likeness depends on the block values alone, so neighbours are searched between
distinct (value, edition) items and only then turned into records. An item
passes on its first few records by id: later ones of the same item can never
rank among the wanted number. Nothing is ever grouped by a common value as a
whole.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesake.functions.text import KEY_SEP, key_of
from namesake.operators.metric_tree import tree_join
from namesake.operators.nearest_sets import nearest_sets
from namesake.operators.suffix_sets import set_join
from namesake.session import cut
from namesake.spec import LinkageSpec


def block_keys(records: DataFrame, spec: LinkageSpec) -> DataFrame:
    """Distinct block values: (block_key, block columns)."""
    cols = list(spec.block_cols)
    key = key_of([F.col(c) for c in cols])
    return records.select(key.alias("block_key"), *cols).distinct()


def _keyed(records: DataFrame, spec: LinkageSpec) -> DataFrame:
    key = key_of([F.col(c) for c in spec.block_cols])
    gkey = F.lit("")
    if spec.guarantee_cols:
        cols = [F.col(c) for c in spec.guarantee_cols]
        gkey = F.coalesce(key_of(cols, spec.require_present), F.lit(""))
    return records.select(
        F.col(spec.record_id).alias("record_id"),
        F.col(spec.edition_seq).alias("seq"),
        key.alias("block_key"),
        gkey.alias("gkey"),
    )


def _members(keyed: DataFrame, depth: int) -> DataFrame:
    """(item, seq) -> its first ``depth`` records by id."""
    by_id = Window.partitionBy("item", "seq").orderBy("record_id")
    first = keyed.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= depth)
    return first.groupBy(F.col("item").alias("r_item"), F.col("seq").alias("r_seq")).agg(
        F.min("record_id").alias("r_tie"),
        F.sort_array(F.collect_list(F.struct("record_id", "gkey"))).alias("members"),
    )


def _one_method(left: DataFrame, right: DataFrame, features: DataFrame, spec: LinkageSpec, search) -> DataFrame:
    """Candidates of one likeness per left group (block_key, gkey, seq).

    ``left`` and ``right`` carry ``item``; ``features(item, vec)`` has its
    vector or token set.
    """
    k = spec.top_k
    # Unbuffered, at most one item per edition of the window shares the left key.
    depth = 2 * k if spec.buffered else k + spec.window
    right_items = _members(right, depth)
    if not spec.buffered:
        right_items = _members(right.withColumn("item", F.concat_ws(KEY_SEP, "item", "gkey")), depth)
        named = right.select("item", F.concat_ws(KEY_SEP, "item", "gkey").alias("r_item")).distinct()
        right_items = right_items.join(named, "r_item")
    else:
        right_items = right_items.withColumn("item", F.col("r_item"))
    right_items = cut(right_items)
    right_vecs = right_items.join(features, "item").select("r_item", "r_seq", "r_tie", F.col("vec").alias("r_vec"))
    left_vecs = left.select("item", "seq").distinct().join(features, "item").select(
        F.col("item").alias("l_item"), F.col("seq").alias("l_seq"), F.col("vec").alias("l_vec")
    )
    hits = search(cut(left_vecs), cut(right_vecs), depth)

    # Keep items that too few records outrank, then rank records. Unbuffered,
    # the items of the left key do not count among those.
    enough = depth if spec.buffered else k + spec.window * depth
    hits = hits.join(right_items.select("r_item", "r_seq", "members"), ["r_item", "r_seq"])
    by_sim = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"))
    tied = Window.partitionBy("l_item", "l_seq", "sim")
    n = F.size("members")
    upto = F.sum(n).over(by_sim.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    hits = hits.withColumn("outranked_by", upto - F.sum(n).over(tied)).filter(F.col("outranked_by") < enough)
    rows = hits.select("l_item", "l_seq", "sim", F.explode("members").alias("m"))
    rows = rows.select("l_item", "l_seq", "sim", F.col("m.record_id").alias("right_id"), F.col("m.gkey").alias("r_gkey"))
    if spec.buffered:
        order = Window.partitionBy("l_item", "l_seq").orderBy(F.desc("sim"), "right_id")
        rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= depth)

    groups = left.select("item", "block_key", "gkey", "seq").distinct().select(
        F.col("item").alias("l_item"), F.col("seq").alias("l_seq"), "block_key", "gkey"
    )
    other = rows.join(groups, ["l_item", "l_seq"]).filter((F.col("gkey") != F.col("r_gkey")) | (F.col("gkey") == ""))
    order = Window.partitionBy("block_key", "gkey", "l_seq").orderBy(F.desc("sim"), "right_id")
    ranked = other.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return ranked.select("block_key", "gkey", F.col("l_seq").alias("seq"), "right_id", "sim", F.col("n").alias("rank"))


def _by_shape(left: DataFrame, right: DataFrame, spec: LinkageSpec, vectors: DataFrame) -> DataFrame:
    own = vectors.select("block_key", F.col("block_key").alias("item"))
    return _one_method(
        left.join(own, "block_key"), right.join(own, "block_key"),
        vectors.select(F.col("block_key").alias("item"), "vec"), spec,
        lambda a, b, k: tree_join(a, b, k, spec.window),
    )


def _by_sound(left: DataFrame, right: DataFrame, spec: LinkageSpec, tokens: DataFrame, strategy: str) -> DataFrame:
    """Values with the same syllable set are one item."""
    named = tokens.select("block_key", F.array_join("tokens", KEY_SEP).alias("item"), F.col("tokens").alias("vec"))
    named = cut(named.filter(F.size("vec") > 0))
    own = named.select("block_key", "item")

    def search(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
        if strategy == "suffixes":
            return set_join(a, b, k, spec.window)
        return nearest_sets(a, b, k, spec.window, strategy)

    return _one_method(left.join(own, "block_key"), right.join(own, "block_key"), named.select("item", "vec").distinct(), spec, search)


def neighbours(records: DataFrame, spec: LinkageSpec, described: DataFrame, metric: str, strategy: str = "suffixes") -> DataFrame:
    """(left_id, right_id, sim, rank): the ``top_k`` nearest records of every
    record in its window, itself and exact-key matches included.

    ``described`` is ``(block_key, vec)`` for cosine, ``(block_key, tokens)``
    for jaccard.
    """
    plain = replace(spec, guarantee_cols=(), buffered=True)
    keyed = _keyed(plain.validate(records), plain)
    if metric == "cosine":
        ranked = _by_shape(keyed, keyed, plain, described)
    else:
        ranked = _by_sound(keyed, keyed, plain, described, strategy)
    # At most top_k entries per group.
    lists = ranked.groupBy("block_key", "seq").agg(F.collect_list(F.struct("right_id", "sim", "rank")).alias("found"))
    return keyed.join(lists, ["block_key", "seq"]).select(F.col("record_id").alias("left_id"), F.inline("found"))


def block(
    records: DataFrame,
    spec: LinkageSpec,
    vectors: DataFrame,
    tokens: DataFrame,
    left_editions: DataFrame | None = None,
    strategy: str = "suffixes",
) -> DataFrame:
    """(left_id, right_id, by_shape, by_phon) for every record.

    ``vectors(block_key, vec)`` and ``tokens(block_key, tokens)`` describe the
    block values. Exact-key matches are no candidates. ``left_editions
    (edition_seq)`` restricts the left side to those editions. ``strategy`` is
    ``suffixes``, or one of ``nearest_sets`` to compare with.
    """
    if not spec.buffered and not set(spec.block_cols) <= set(spec.guarantee_cols):
        raise ValueError("buffered=False needs the block columns among the guarantee columns")
    right = _keyed(spec.validate(records), spec)
    left = right
    if left_editions is not None:
        left = right.join(left_editions.select(F.col("edition_seq").alias("seq")), "seq", "left_semi")

    group = ["block_key", "gkey", "seq", "right_id"]
    shape = _by_shape(left, right, spec, vectors)
    phon = _by_sound(left, right, spec, tokens, strategy)
    flags = shape.select(*group, F.lit(True).alias("by_shape"), F.lit(False).alias("by_phon")).unionByName(
        phon.select(*group, F.lit(False).alias("by_shape"), F.lit(True).alias("by_phon"))
    )
    merged = flags.groupBy("block_key", "gkey", "seq", "right_id").agg(
        F.max("by_shape").alias("by_shape"), F.max("by_phon").alias("by_phon")
    )
    # At most 2 * top_k entries per group.
    lists = merged.groupBy("block_key", "gkey", "seq").agg(
        F.collect_list(F.struct("right_id", "by_shape", "by_phon")).alias("found")
    )
    # The lists of few groups would else stand in one task, which then makes all pairs.
    pairs = left.hint("merge").join(lists, ["block_key", "gkey", "seq"]).select(
        F.col("record_id").alias("left_id"), F.inline("found")
    )
    return pairs.filter(F.col("left_id") != F.col("right_id"))
