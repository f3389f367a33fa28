"""Gram vectors and their nested means."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.functions import text
from namesake.functions.vectors import unit


def mean_vector(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Element-wise mean per group, combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vec)))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(vec))


def train_gram_vectors(
    symbols: DataFrame, size: int = 100, seed: int = 42, min_count: int = 1, iterations: int = 1, partitions: int = 1
) -> DataFrame:
    """Skip-gram vectors of grams, learnt from symbols as sentences."""
    model = Word2Vec(
        vectorSize=size,
        minCount=min_count,
        seed=seed,
        maxIter=iterations,
        numPartitions=partitions,
        inputCol="grams",
        outputCol="_mean",
    ).fit(symbols.select("grams"))
    return model.getVectors().select(
        F.col("word").alias("gram"), vector_to_array("vector").alias("vec")
    )


def symbol_vectors(symbols: DataFrame, gram_vectors: DataFrame) -> DataFrame:
    """(symbol, grams) -> (symbol, vec): mean over its grams.

    A gram outside the vocabulary takes the vocabulary mean, a single vector.
    """
    mean = gram_vectors.agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("oov")
    )
    grams = symbols.select("symbol", F.explode("grams").alias("gram"))
    found = (
        grams.join(gram_vectors.select("gram", "vec"), "gram", "left")
        .join(F.broadcast(mean), F.lit(True))
        .select("symbol", F.coalesce("vec", "oov").alias("vec"))
    )
    return mean_vector(found, ["symbol"], "vec")


def value_vectors(values: DataFrame, symbol_vecs: DataFrame) -> DataFrame:
    """(value) -> (value, vec): unit vector of the mean over its symbols.

    Symbols weigh equally, however many grams each has.
    """
    placed = values.select("value", F.explode(text.symbols(F.col("value"))).alias("symbol"))
    means = mean_vector(placed.join(symbol_vecs, "symbol"), ["value"], "vec")
    return means.select("value", unit(F.col("vec")).alias("vec"))


def block_vectors(blocks: DataFrame, cols: tuple[str, ...], symbol_vecs: DataFrame) -> DataFrame:
    """(block_key, cols) -> (block_key, vec): mean over the symbols of all columns."""
    all_symbols = F.concat(*[text.symbols(F.col(c)) for c in cols])
    placed = blocks.select("block_key", F.explode(all_symbols).alias("symbol"))
    means = mean_vector(placed.join(symbol_vecs, "symbol"), ["block_key"], "vec")
    return means.select("block_key", unit(F.col("vec")).alias("vec"))


def block_tokens(blocks: DataFrame, cols: tuple[str, ...], tokens: DataFrame) -> DataFrame:
    """(block_key, cols) -> (block_key, tokens): syllable set of all columns."""
    placed = blocks.select("block_key", F.explode(F.array(*[F.col(c) for c in cols])).alias("value"))
    found = placed.join(tokens.select("value", "phon"), "value").select(
        "block_key", F.explode("phon").alias("token")
    )
    return found.groupBy("block_key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
