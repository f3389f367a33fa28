"""Shape n-grams and phonetic tokens of distinct attribute values.

Work is done once per distinct value, symbol and character. A record table
holds each value many times over, so this side stays far smaller than it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.functions import text


def distinct_values(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """All values of several columns, each once."""
    return df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("value")).distinct()


def convert_variants(values: DataFrame, variants: DataFrame) -> DataFrame:
    """(value) -> (value, standard): every character by its standard form.

    Characters without an entry stay. Small one-to-one maps known beforehand
    are better served by ``F.translate``.
    """
    letters = values.select("value", F.posexplode(text.chars(F.col("value"))).alias("pos", "char"))
    mapped = letters.join(variants, "char", "left").select(
        "value", F.struct("pos", F.coalesce("standard", "char").alias("c")).alias("p")
    )
    joined = mapped.groupBy("value").agg(F.sort_array(F.collect_list("p")).alias("p"))
    joined = joined.select("value", F.array_join(F.transform("p", lambda x: x["c"]), "").alias("standard"))
    return values.join(joined, "value", "left").select(
        "value", F.coalesce("standard", "value").alias("standard")
    )


def convert_columns(df: DataFrame, cols: tuple[str, ...], variants: DataFrame, suffix: str) -> DataFrame:
    """Add ``{col}{suffix}`` columns with standard characters."""
    lookup = convert_variants(distinct_values(df, cols), variants)

    def attach(acc: DataFrame, c: str) -> DataFrame:
        named = lookup.select(F.col("value").alias(c), F.col("standard").alias(f"{c}{suffix}"))
        return acc.join(named, c, "left")

    return reduce(attach, cols, df)


def char_units(
    letters: DataFrame,
    strokes: DataFrame | None = None,
    variants: DataFrame | None = None,
    phonetic: DataFrame | None = None,
) -> DataFrame:
    """(char) -> (char, units, phon): stroke units of a character and of its
    standard form, and its syllable.

    Without a stroke table a character is its own stroke; without a phonetic
    entry it is its own syllable.
    """
    df = letters
    if variants is not None:
        df = df.join(variants.select("char", "standard"), "char", "left")
        df = df.withColumn("standard", F.coalesce("standard", "char"))
    else:
        df = df.withColumn("standard", F.col("char"))
    unknown = F.array(F.lit("?"))
    if strokes is not None:
        own = strokes.select("char", text.chars(F.col("strokes")).alias("own"))
        std = own.withColumnsRenamed({"char": "standard", "own": "std"})
        df = df.join(own, "char", "left").join(std, "standard", "left")
        df = df.withColumn("own", F.coalesce("own", unknown)).withColumn("std", F.coalesce("std", unknown))
    else:
        df = df.withColumn("own", F.array("char")).withColumn("std", F.array("standard"))
    if phonetic is not None:
        df = df.join(phonetic.select("char", "syllable"), "char", "left")
        syllable = F.coalesce("syllable", "char")
    else:
        syllable = F.col("char")
    blank = F.col("char").isin(*text.UNKNOWN_CHARS)
    return df.select(
        "char",
        F.when(blank, unknown).otherwise(F.concat("own", "std")).alias("units"),
        F.when(blank, F.lit("?")).otherwise(syllable).alias("phon"),
    )


def symbol_tokens(
    values: DataFrame,
    strokes: DataFrame | None = None,
    variants: DataFrame | None = None,
    phonetic: DataFrame | None = None,
    n: int = 3,
) -> DataFrame:
    """(value) -> (symbol, grams, phon) for every distinct symbol of the values."""
    symbols = values.select(F.explode(text.symbols(F.col("value"))).alias("symbol")).distinct()
    letters = symbols.select("symbol", F.posexplode_outer(text.chars(F.col("symbol"))).alias("pos", "char"))
    units = char_units(
        letters.filter(F.col("char").isNotNull()).select("char").distinct(), strokes, variants, phonetic
    )
    parts = letters.join(units, "char", "left").groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("pos", "units", "phon"))).alias("p")
    )
    edge = F.array(F.lit(text.BOUNDARY))
    empty = F.array(F.lit("?"), F.lit("?"))
    inner = F.when(F.col("symbol") == "", empty).otherwise(F.flatten(F.transform("p", lambda x: x["units"])))
    return parts.select(
        "symbol",
        text.ngrams(F.concat(edge, inner, edge), n).alias("grams"),
        F.when(F.col("symbol") == "", F.array().cast("array<string>"))
        .otherwise(F.transform("p", lambda x: x["phon"]))
        .alias("phon"),
    )


def value_tokens(values: DataFrame, symbols: DataFrame) -> DataFrame:
    """(value) -> (value, shape, phon): grams per symbol, syllables in order."""
    placed = values.select("value", F.posexplode(text.symbols(F.col("value"))).alias("pos", "symbol"))
    parts = placed.join(symbols, "symbol").groupBy("value").agg(
        F.sort_array(F.collect_list(F.struct("pos", "grams", "phon"))).alias("p")
    )
    found = parts.select(
        "value",
        F.transform("p", lambda x: x["grams"]).alias("shape"),
        F.flatten(F.transform("p", lambda x: x["phon"])).alias("phon"),
    )
    none = values.join(found, "value", "left")
    return none.select(
        "value",
        F.coalesce("shape", F.array().cast("array<array<string>>")).alias("shape"),
        F.coalesce("phon", F.array().cast("array<string>")).alias("phon"),
    )


def attach_tokens(records: DataFrame, tokens: DataFrame, cols: tuple[str, ...], record_id: str) -> DataFrame:
    """Record table with ``{col}_stroke`` and ``{col}_pinyin`` columns.

    Each column looks its values up by itself. Folding (record, column) rows
    back together would sort every record with its token arrays.
    """
    def attach(acc: DataFrame, c: str) -> DataFrame:
        named = tokens.select(F.col("value").alias(c), F.col("shape").alias(f"{c}_stroke"), F.col("phon").alias(f"{c}_pinyin"))
        return acc.join(named, c, "left")

    others = [c for c in records.columns if c != record_id]
    return reduce(attach, cols, records).select(record_id, *others, *[f"{c}_stroke" for c in cols], *[f"{c}_pinyin" for c in cols])


def flat_shape(shape):
    """Grams of all symbols of a value in one array."""
    return F.flatten(shape)
