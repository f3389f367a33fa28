"""Gram vectors by factorising how often grams stand near each other.

Skip-gram training approaches a factorisation of the pointwise mutual
information of neighbours. Here that matrix is counted by Spark, in as many
tasks as there are data, and factorised by subspace iteration from a hashed
start: a product of the sparse matrix with a thin one is a join and a sum, and
only matrices of ``size`` by ``size`` meet on the driver. Square roots of
matrices are the symmetric ones, so the result doesn't depend on the order in
which sums were taken, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.functions.vectors import rows_of
from namesake.session import cut, release

#: Grams this far apart count as neighbours, nearer ones more.
WINDOW = 5
#: Products with the matrix before the factor is taken.
ROUNDS = 3
#: Decimals of a vector's entries.
DECIMALS = 6
#: Matrices of partial sums are added up in so many groups before they meet.
GROUPS = 16


def neighbour_counts(symbols: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n): weighted number of times gram b stands near gram a in ``symbols(grams)``."""
    placed = symbols.select("grams", F.posexplode("grams").alias("i", "a"))
    near = F.slice("grams", F.greatest(F.col("i") - window, F.lit(0)) + 1, F.lit(2 * window + 1))
    pairs = placed.select("a", "i", F.greatest(F.col("i") - window, F.lit(0)).alias("_from"), F.posexplode(near).alias("_k", "b"))
    gap = F.abs(F.col("_from") + F.col("_k") - F.col("i"))
    pairs = pairs.filter((gap > 0) & (gap <= window)).select("a", "b", (F.lit(window + 1) - gap).cast("long").alias("n"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(a, b, w): positive pointwise mutual information of neighbours."""
    margin = cut(counts.groupBy("a").agg(F.sum("n").alias("n_a")))
    total = margin.agg(F.sum("n_a")).first()[0] or 1
    both = counts.join(margin, "a").join(margin.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b")
    w = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b")))
    return both.select("a", "b", w.alias("w")).filter("w > 0")


def _times(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """The matrix times ``x(gram, vec)``."""
    joined = matrix.join(x.select(F.col("gram").alias("b"), "vec"), "b")
    summed = joined.groupBy(F.col("a").alias("gram")).agg(Summarizer.sum(array_to_vector("vec"), F.col("w")).alias("_sum"))
    return summed.select("gram", vector_to_array("_sum").alias("vec"))


def _gram_matrix(table: DataFrame, left: str, right: str, size: int) -> np.ndarray:
    """Sum over rows of the outer product of two vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros((size, size)), 0
        for batch in batches:
            if batch.num_rows:
                total += rows_of(batch.column("l")).T @ rows_of(batch.column("r"))
                key += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.reshape(-1)])], names=["key", "part"])

    def add(parts: pa.Table) -> pa.Table:
        return pa.table([pa.array([rows_of(parts["part"]).sum(axis=0)])], names=["part"])

    parts = table.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(partial, "key long, part array<double>")
    met = parts.groupBy(F.pmod(F.xxhash64("key"), F.lit(GROUPS))).applyInArrow(add, "part array<double>").collect()
    return np.sum([np.array(r["part"]) for r in met], axis=0).reshape(size, size) if met else np.zeros((size, size))


def _mapped(table: DataFrame, by: np.ndarray) -> DataFrame:
    """``table(gram, vec)`` with each vector times a small matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch.column("vec")) @ by
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("gram"), flat], names=["gram", "vec"])

    return table.select("gram", "vec").mapInArrow(run, "gram string, vec array<double>")


def _power(matrix: np.ndarray, exponent: float) -> np.ndarray:
    """A power of the positive part of a symmetric matrix."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    kept = values > max(values.max(initial=0.0), 0.0) * 1e-10
    return (vectors[:, kept] * values[kept] ** exponent) @ vectors[:, kept].T


def factor_gram_vectors(symbols: DataFrame, size: int = 100, seed: int = 42, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(gram, vec) for every gram of ``symbols(grams)``; grams without a neighbour have a zero vector."""
    matrix = cut(mutual_information(neighbour_counts(symbols, window)))
    grams = cut(symbols.select(F.explode("grams").alias("gram")).distinct())
    signs = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda d: F.when(F.xxhash64("gram", d, F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0))
    x = grams.select("gram", signs.alias("vec"))
    for _ in range(rounds):
        y = cut(_times(matrix, x))
        x = _mapped(y, _power(_gram_matrix(y, "vec", "vec", size), -0.5))
    basis = cut(x)
    product = _times(matrix, basis).withColumnRenamed("vec", "_image")
    small = _gram_matrix(basis.join(product, "gram"), "vec", "_image", size)
    vectors = _mapped(basis, _power(small, 0.5))
    rounded = F.transform("vec", lambda v: F.round(v, DECIMALS) + F.lit(0.0))
    zero = F.array_repeat(F.lit(0.0), size)
    found = cut(grams.join(vectors.select("gram", rounded.alias("vec")), "gram", "left").select("gram", F.coalesce("vec", zero).alias("vec")))
    for table in (matrix, basis):
        release(table)
    return found
