"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.session import scratch

# ASCII white space that separates words, as a regular expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder in a form half the size of ``cut``'s, for tables of long strings."""
    spark = df.sparkSession
    path = scratch(spark, "written")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, folded; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows whose lengths sum to about ``most``; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
