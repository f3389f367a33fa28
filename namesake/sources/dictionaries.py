"""User-supplied character tables and gram vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_char_table(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Lines of ``character value`` separated by one space; later fields are ignored."""
    lines = spark.read.text(path)
    parts = F.split("value", " ")
    return lines.select(
        F.element_at(parts, 1).alias("char"),
        F.trim(F.try_element_at(parts, F.lit(2))).alias(value),
    ).filter(F.col(value).isNotNull() & (F.col("char") != ""))


def read_strokes(spark: SparkSession, path: str) -> DataFrame:
    return read_char_table(spark, path, "strokes")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return read_char_table(spark, path, "standard")


def read_phonetic(spark: SparkSession, path: str) -> DataFrame:
    return read_char_table(spark, path, "syllable")


def read_gram_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of (gram, vec)."""
    return spark.read.parquet(path).select("gram", F.col("vec").cast("array<double>").alias("vec"))


def write_gram_vectors(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vectors.select("gram", F.col("vec").cast("array<float>").alias("vec")).write.mode(mode).parquet(path)
