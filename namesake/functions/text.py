"""Text expressions: symbols, n-grams, missing values, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The missing marker, its pattern, and the characters read as
# "unknown" inside a value.
MISSING = "?"
MISSING_PATTERN = r"^(\?\s?)+$"
UNKNOWN_CHARS = ("？", "?", " ")
OPEN_BRACKET, CLOSE_BRACKET, JOINER = "（", "）", "+"
BOUNDARY = "*"

# Joins the parts of a key; a control character cannot occur in a value.
KEY_SEP = "\u0001"


def fill_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def unfill_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(MISSING))


def is_missing(c: Column) -> Column:
    """True for a null or for a value made only of missing markers."""
    return c.isNull() | c.rlike(MISSING_PATTERN)


def chars(c: Column) -> Column:
    """Characters of a string; the empty string has none."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def symbols(c: Column) -> Column:
    """Characters, with the first bracketed group read as one symbol."""
    start = F.instr(c, OPEN_BRACKET)
    end = F.instr(c, CLOSE_BRACKET)
    inner = F.substr(c, start + 1, F.greatest(end - start - 1, F.lit(0)))
    group = F.translate(inner, JOINER, "")
    composed = F.concat(
        chars(F.substr(c, F.lit(1), start - 1)),
        F.array(group),
        chars(F.substr(c, end + 1)),
    )
    return F.when((start > 0) & (end > 0), composed).otherwise(chars(c))


def symbol_value(symbol: Column) -> Column:
    """The value text whose only symbol is ``symbol``."""
    wrapped = F.concat(F.lit(OPEN_BRACKET), symbol, F.lit(CLOSE_BRACKET))
    return F.when(F.length(symbol) == 1, symbol).otherwise(wrapped)


def ngrams(seq: Column, n: int = 3) -> Column:
    """Runs of ``n`` neighbours of an array, each joined to one string."""
    size = F.size(seq)
    grams = F.transform(
        F.sequence(F.lit(1), size - (n - 1)),
        lambda i: F.array_join(F.slice(seq, i, n), ""),
    )
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def key_of(cols: list[Column], require_present: bool = False) -> Column:
    """One equality key of several attributes.

    A missing attribute equals a missing attribute, unless ``require_present``
    makes the key null, which equals nothing.
    """
    key = F.concat_ws(KEY_SEP, *[fill_missing(c) for c in cols])
    if not require_present:
        return key
    gone = is_missing(cols[0])
    for c in cols[1:]:
        gone = gone | is_missing(c)
    return F.when(~gone, key)


def fractional_year(year: Column, season: Column) -> Column:
    return year.cast("int") + (season.cast("int") - 1) / 4


def edition_key(*parts: Column) -> Column:
    """Concatenation that is null when a part is null."""
    return F.concat(*[p.cast("string") for p in parts])


def pair_cell(left: Column, right: Column) -> Column:
    """Display cell of one attribute for both records of a pair."""
    return F.concat(left, F.lit(" |\n "), right)


def cluster_key(cluster: Column, sub: Column) -> Column:
    cluster = cluster.cast("string")
    joined = F.concat_ws("_", cluster, sub.cast("string"))
    return F.when(sub.isNotNull(), joined).otherwise(cluster)
