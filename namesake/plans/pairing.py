"""Candidate pairs with features, for scoring and for labelling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from namesake.operators.blocking import block
from namesake.operators.editions import stride_sample
from namesake.operators.features import pair_features
from namesake.operators.ordered import dense_index
from namesake.plans.preparation import ValueTables
from namesake.session import cut
from namesake.spec import LinkageSpec

# Window, k and edition count of the labelling pool.
POOL_WINDOW = 3
POOL_TOP_K = 10
POOL_EDITIONS = 10


def candidate_features(records: DataFrame, spec: LinkageSpec, values: ValueTables, left_editions: DataFrame | None = None) -> DataFrame:
    """Blocked pairs of the whole record table with their features."""
    pairs = block(records, spec, values.block_vectors, values.block_tokens, left_editions)
    return pair_features(pairs, records, spec, values.vectors, values.tokens)


def training_pool(records: DataFrame, editions: DataFrame, spec: LinkageSpec, values: ValueTables, n_editions: int = POOL_EDITIONS) -> DataFrame:
    """Pairs of evenly spread left editions, numbered by ``pair_id``."""
    near = replace(spec, window=POOL_WINDOW, top_k=POOL_TOP_K)
    chosen = stride_sample(editions, n_editions)
    featured = cut(candidate_features(records, near, values, chosen))
    return dense_index(featured, ["left_id", "right_id"], "pair_id")
