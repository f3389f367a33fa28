"""Similarity features of candidate pairs.

Shape and sound likeness of an attribute depend on its two values only. Equal
values need no lookup, and the unequal ones are scored once per distinct pair
of values, whichever attribute and however many record pairs they come from.
Vectors are never attached to record pairs. Scores of few value pairs are sent to
the record pairs; those of many meet them in a join by value.

Joins with records are sorted on both sides: as files, columns of few values are
so small that the planner would send all records to every task, and the pairs
made from a few lists would stay in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.functions import text
from namesake.functions.vectors import cosine_of_units, jaccard, rank_features, repr_chars
from namesake.operators.tokens import distinct_values
from namesake.session import cut
from namesake.spec import LinkageSpec

# Name symbols compared one by one.
NAME_SYMBOLS = 2
#: Scores of value pairs that are sent to all tasks, at most, in bytes: letters and 64 a row.
SENT = 4 << 20


def _name_symbol(name, i: int):
    return F.try_element_at(text.symbols(name), F.lit(i))


def feature_values(records: DataFrame, spec: LinkageSpec) -> DataFrame:
    """All values the features look at: attributes and single name symbols."""
    values = distinct_values(records, spec.match_cols)
    names = records.select(F.col(spec.name_col).alias("name")).distinct()
    singles = names.select(
        F.explode(F.array(*[text.symbol_value(_name_symbol(F.col("name"), i + 1)) for i in range(NAME_SYMBOLS)])).alias("value")
    ).filter(F.col("value").isNotNull())
    return values.unionByName(singles).distinct()


def _attributes(records: DataFrame, spec: LinkageSpec, side: str, n: int) -> DataFrame:
    rank = [F.col(spec.rank_col).alias(f"{n}_{spec.rank_col}")] if spec.rank_col else []
    return records.select(
        F.col(spec.record_id).alias(f"{side}_id"),
        F.col(spec.year).cast("double").alias(f"{n}_year"),
        *[F.col(c).alias(f"{n}_{c}") for c in spec.match_cols],
        *rank,
        *[F.col(f"_slot_{name}").alias(f"_{n}_{name}") for name in _slots(spec)],
    )


def _slots(spec: LinkageSpec) -> list[str]:
    """What is compared: the attributes, then the name symbols."""
    return [*spec.match_cols, *[f"sim{i}" for i in range(1, NAME_SYMBOLS + 1)]]


def _with_slots(records: DataFrame, spec: LinkageSpec) -> DataFrame:
    """``records`` with the value of each slot, null where it cannot be compared."""
    values = [F.when(~text.is_missing(F.col(c)), F.col(c)).alias(f"_slot_{c}") for c in spec.match_cols]
    for i in range(1, NAME_SYMBOLS + 1):
        symbol = _name_symbol(F.col(spec.name_col), i)
        values.append(F.when(~symbol.isin(*text.UNKNOWN_CHARS), text.symbol_value(symbol)).alias(f"_slot_sim{i}"))
    rank = [spec.rank_col] if spec.rank_col else []
    kept = dict.fromkeys([spec.record_id, spec.year, *spec.match_cols, *rank])
    return records.select(*kept, *values)


def value_pair_scores(pairs: DataFrame, vectors: DataFrame, tokens: DataFrame, mode: str = "tokens") -> DataFrame:
    """(a, b) -> (a, b, shape, phon): cosine and Jaccard of two values."""
    def side(name: str) -> DataFrame:
        described = vectors.join(tokens, "value").select("value", "vec", "phon")
        return described.withColumnsRenamed({"value": name, "vec": f"{name}_vec", "phon": f"{name}_phon"})

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    set_a, set_b = F.col("a_phon"), F.col("b_phon")
    if mode == "char_repr":
        set_a, set_b = repr_chars(set_a), repr_chars(set_b)
    return both.select("a", "b", cosine_of_units("a_vec", "b_vec").alias("shape"), jaccard(set_a, set_b).alias("phon"))


def _few(scores: DataFrame) -> bool:
    size = scores.agg(F.sum(F.octet_length("a") + F.octet_length("b") + 64)).first()[0]
    return (size or 0) <= SENT


def _sent_scores(wide: DataFrame, scores: DataFrame, slots: list, attributes: int) -> DataFrame:
    """``wide`` with the scores of each slot's two values."""
    for i, (name, a, b) in enumerate(slots):
        found = [F.col("shape").alias(f"_{name}_shape"), *([F.col("phon").alias(f"_{name}_phon")] if i < attributes else [])]
        side = scores.select(F.col("a").alias("_a"), F.col("b").alias("_b"), *found)
        wide = wide.join(F.broadcast(side), (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left").drop("_a", "_b")
    return wide


def _joined_scores(wide: DataFrame, cells: DataFrame, scores: DataFrame, slots: list, attributes: int) -> DataFrame:
    """The same by one join of all cells and one grouping by pair."""
    found = cells.join(scores, ["a", "b"]).groupBy("left_id", "right_id").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("shape"))).alias(f"_{name}_shape") for i, (name, *_) in enumerate(slots)],
        *[F.max(F.when(F.col("slot") == i, F.col("phon"))).alias(f"_{name}_phon") for i, (name, *_) in enumerate(slots[:attributes])],
    )
    return wide.join(found, ["left_id", "right_id"], "left")


def pair_features(pairs: DataFrame, records: DataFrame, spec: LinkageSpec, vectors: DataFrame, tokens: DataFrame) -> DataFrame:
    """Attribute values and similarity features of ``pairs(left_id, right_id, ...)``.

    ``vectors(value, vec)`` are unit vectors and ``tokens(value, phon)`` the
    syllables of ``feature_values``. Missing similarities are -1.
    """
    # Patterns and symbols are looked at once for each record, not for each pair.
    known = cut(_with_slots(records, spec))
    left, right = (_attributes(known, spec, side, n).hint("merge") for side, n in (("left", 1), ("right", 2)))
    wide = cut(pairs.join(left, "left_id").join(right, "right_id"))
    shown = [c for c in wide.columns if not c.startswith(("_1_", "_2_"))]
    slots = [(name, F.col(f"_1_{name}"), F.col(f"_2_{name}")) for name in _slots(spec)]
    asked = [
        F.when(a != b, F.struct(F.lit(i).alias("slot"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
        for i, (_, a, b) in enumerate(slots)
    ]
    cells = wide.select("left_id", "right_id", F.explode(F.array(*asked)).alias("s")).filter("s is not null").select("left_id", "right_id", "s.*")
    scores = cut(value_pair_scores(cells.select("a", "b").distinct(), vectors, tokens, spec.phonetic_mode))
    if _few(scores):
        full = _sent_scores(wide, scores, slots, len(spec.match_cols))
    else:
        full = _joined_scores(wide, cells, scores, slots, len(spec.match_cols))

    def scored(a, b, looked_up: str):
        same = F.when(a == "", F.lit(0.0)).otherwise(F.lit(1.0))
        likeness = F.when(a == b, same).otherwise(F.coalesce(F.col(looked_up), F.lit(0.0)))
        return F.when(a.isNull() | b.isNull(), F.lit(-1.0)).otherwise(likeness)

    attrs = slots[: len(spec.match_cols)]
    features = [scored(a, b, f"_{c}_shape").alias(f"{c}_stroke") for c, a, b in attrs]
    features += [scored(a, b, f"_{c}_phon").alias(f"{c}_pinyin") for c, a, b in attrs]
    if spec.rank_col:
        diff, lower = rank_features(F.col(f"1_{spec.rank_col}"), F.col(f"2_{spec.rank_col}"))
        features += [diff.alias(f"{spec.rank_col}_diff"), lower.alias(f"{spec.rank_col}_lower")]
    n1, n2 = F.col(f"1_{spec.name_col}"), F.col(f"2_{spec.name_col}")
    features.append(F.abs(F.length(n1) - F.length(n2)).cast("double").alias(f"{spec.name_col}_cnt_diff"))
    features += [
        scored(a, b, f"_{name}_shape").alias(f"{spec.name_col}_{name}") for name, a, b in slots[len(attrs):]
    ]
    features.append(F.coalesce(F.col("1_year") == F.col("2_year"), F.lit(False)).cast("double").alias("same_year"))
    return full.select(*shown, *features)
