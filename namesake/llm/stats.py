"""Statistics of texts as column expressions: one value or more for each row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import SPACE_CLASS, WORD

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words_of(text: Column) -> Column:
    """Words in text order."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return (F.char_length(text) - F.regexp_count(text, F.lit(f"[{SPACE_CLASS}]"))).cast("long")


def filled_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))


def repeats(values: Column) -> Column:
    """Entries of an array that equal an earlier entry."""
    return (F.size(values) - F.size(F.array_distinct(values))).cast("long")


def with_repeated_window_words(df: DataFrame, words: str, name: str, window: int = 3) -> DataFrame:
    """Adds the number of words that lie in a window of words found twice or more in its text.

    Windows are told apart by 64-bit hashes. Texts without a repeat are settled
    by counting distinct hashes. For the others (hash, place) is sorted, equal
    neighbours are repeats, and their places in order give the words covered:
    n log n work for any text.
    """
    w = F.col(words)
    place = F.sequence(F.lit(0), F.size(w) - window)
    windows = F.transform(place, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    df = df.withColumn("_windows", F.when(F.size(w) >= window, windows).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(pairs)))
    s = F.col("_sorted")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))
    df = df.withColumn("_places", F.when(F.col("_repeats"), places))
    p = F.col("_places")
    new = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
    covered = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    return df.withColumn(name, F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long")).drop("_windows", "_repeats", "_sorted", "_places")
