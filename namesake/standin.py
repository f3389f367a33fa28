"""A record table over the driver's ``part`` table, with rule-made dictionaries.

Words of the name stand for surname and given name, brand and type for origin
and posts, and the size for the edition and its year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.operators.tokens import symbol_tokens
from namesake.spec import LinkageSpec

# Parameters of the stand-in task.
SPEC = LinkageSpec(window=3, top_k=5)
# Exact key by name and brand; with the type too, small tables hold no match.
NAME_BRAND = LinkageSpec(window=3, top_k=5, guarantee_cols=("xing", "ming", "ren_xian"))
GRAM_DIMS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        F.col("p_partkey").alias("record_id"),
        F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("edition"),
        F.col("p_size").alias("edition_seq"),
        (F.lit(1800.0) + F.col("p_size")).alias("year"),
        words[0].alias("xing"),
        words[1].alias("ming"),
        F.lit("?").alias("zihao"),
        F.col("p_type").alias("diqu"),
        F.col("p_brand").alias("jigou_1"),
        F.when(F.col("p_type") == "SMALL", F.lit("? ?")).otherwise(F.col("p_type")).alias("jigou_2"),
        F.lower("p_type").alias("guanzhi_1"),
        F.col("p_brand").alias("ren_xian"),
        F.col("p_type").alias("ren_sheng"),
        F.when(F.col("p_brand").endswith("5"), F.lit("?")).otherwise(words[0]).alias("chushen_1"),
    )


def gram_vectors(values: DataFrame) -> DataFrame:
    """A vector per gram of the values, by a rule on its three characters."""
    grams = symbol_tokens(values).select(F.explode("grams").alias("gram")).distinct()

    def code(i: int):
        return F.ascii(F.substring("gram", i, 1))

    dims = [
        ((code(1) * (j + 3) + code(2) * (2 * j * j + 7) + code(3) * (5 * j + 1)) % 97) / 97.0 - 0.5 for j in range(GRAM_DIMS)
    ]
    return grams.select("gram", F.array(*dims).alias("vec"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct characters of the part names and brands."""
    part = table(spark, sf_dir, "part")
    texts = part.select(F.explode(F.array("p_name", "p_brand")).alias("t")).distinct()
    return texts.select(F.explode(F.split("t", "")).alias("char")).distinct().filter("char <> ''")


def dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stroke, variant and syllable tables, by a rule on the character code.

    Every eleventh character has no strokes; vowels are variants of 'e'.
    """
    chars = letters(spark, sf_dir)
    n = F.ascii("char")
    strokes = chars.filter(n % 11 != 0).select(
        "char",
        F.concat(F.substr(F.lit("ABCDE"), n % 5 + 1, F.lit(1)), F.substr(F.lit("VWXYZ"), n % 7 % 5 + 1, F.lit(1))).alias("strokes"),
    )
    variants = chars.filter(F.col("char").isin("a", "i", "o", "u")).select("char", F.lit("e").alias("standard"))
    phonetic = chars.filter(n >= 97).select("char", F.concat(F.lit("s"), (n % 6).cast("string")).alias("syllable"))
    return strokes, variants, phonetic
