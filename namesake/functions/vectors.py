"""Similarity expressions on token sets and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def repr_chars(tokens: Column) -> Column:
    """Characters of the printed token list, brackets and quotes included."""
    shown = F.concat(F.lit("['"), F.array_join(tokens, "' '"), F.lit("']"))
    shown = F.when(F.size(tokens) > 0, shown).otherwise(F.lit("[]"))
    return F.array_distinct(F.split(shown, ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    # As a variable the length is worked out once, not for each dimension.
    norms = F.array(F.sqrt(dot(v, v)))
    return F.transform(norms, lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))[0]


def rows_of(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Equal-length Arrow lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


@F.arrow_udf(T.DoubleType())
def cosine_of_units(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot product of unit vectors, a batch at a time."""
    return pa.array(np.einsum("ij,ij->i", rows_of(a), rows_of(b)))


def vote_entropy(p: Column) -> Column:
    """Entropy of a vote share, with the small constant of the formula."""
    # Fixed value: added inside the logarithms.
    eps = 1e-12
    return -(p * F.log(p + eps) + (1 - p) * F.log(1 - p + eps))


def rank_features(left: Column, right: Column) -> tuple[Column, Column]:
    """Distance and minimum of two grades, where 0 reads as 10 and -1 is missing."""
    le = F.when(left == 0, 10).otherwise(left)
    ri = F.when(right == 0, 10).otherwise(right)
    diff = F.when((le != -1) & (ri != -1), F.abs(ri - le)).otherwise(F.lit(-1))
    return diff.cast("double"), F.least(le, ri).cast("double")
