"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words: shares of a budget by weight, none
above ``most_repeats`` times what the source holds. A source's documents stand
in a hashed order; the words taken are the first ``target`` words of that order,
read round and round. The weight schedule says how a source's demand is spread
over training time: its integral is the cumulative demand, and the inverse of
that integral gives the position in [0, 1] at which a document is due.

Only DataFrame functions are used. A source is never handled as one group: the
hashed order is cut into buckets of equal hash ranges, bucket sums give each
bucket's start, and sums within a bucket do the rest.

``plan`` says what is taken and when, from sizes alone. ``deliver`` reads it out:
texts go once to the slot of training time in which their bucket is due, and are
placed, cut at the last word taken and sorted there. ``mix`` does both, and tells
the words taken from the texts delivered.

Defined results: null text has size 0; null source is a source of its own, last
in order; documents of size 0 take 0 words and have no position; rows with equal
ids and sizes are interchangeable; an empty table gives an empty result. Columns
beside those named are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesake.llm.common import SPACE_CLASS, WORD, text_of
from namesake.session import cut

# Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Budget as a fraction of all sizes, as numerator and denominator.
BUDGET = (3, 2)
MOST_REPEATS = 2
#: Relative weight of a source over training time, by place in WEIGHTS: (time, level) knots,
#: linear between them. The first fades out, the last fades in.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Hex digits of the hash that name a bucket: 4,096 buckets per source.
BUCKET_DIGITS = 3
#: Equal parts of training time; texts of a bucket that lies across two go to both, and one of them keeps each.
SLOTS = 256
#: Rows of buckets and slots that travel to the texts, some 200 bytes each; more of them (of very many sources) meet the texts in a shuffled join.
SENT_ROWS = 300_000


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight_no, target) from (source, source_size).

    Raising one level until the budget is met equals resharing the excess of
    full sources by weight: a source gets ``weight * level`` or its cap. All
    sums are of integers; the level is one quotient of them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    no = (F.row_number().over(order) - 1) % len(weights)
    table = sizes.withColumn("weight_no", no)
    table = table.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.col("weight_no") + 1))
    cap = F.col("source_size") * most_repeats
    # Sources fill in the order of cap / weight; the level is that of the first which does not fill.
    filled = Window.orderBy(cap / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    table = (
        table.withColumn("_cap", cap)
        .withColumn("_caps", F.sum("_cap").over(filled) - F.col("_cap"))
        .withColumn("_rest", F.sum("_w").over(whole) - F.sum("_w").over(filled) + F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(whole))
    )
    level = (F.col("_all") * budget[0] - F.col("_caps") * budget[1]).cast("double") / (F.col("_rest") * budget[1])
    table = table.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_caps", "_level"))
    table = table.withColumn("_first", F.min(fits).over(whole)["_level"])
    target = F.when(F.col("_first").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_first") * F.col("_w"))
    )
    return table.select("source", "source_size", "weight_no", target.alias("target"))


def _inverse(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of the schedule's integral has passed."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, passed, result = sum(area), 0.0, None
    for (t0, w0), (t1, w1), part in zip(knots, knots[1:], area):
        need = share * total - passed
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = need, in the form that also holds for a flat piece.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need))
        at = F.lit(t0) + F.lit(2.0) * need / F.greatest(root + w0, F.lit(1e-12))
        passed += part
        result = F.when(share * total <= passed, at) if result is None else result.when(share * total <= passed, at)
    return F.least(F.lit(float(knots[-1][0])), result.otherwise(F.lit(float(knots[-1][0]))))


def training_position(share: Column, weight_no: Column, schedules=SCHEDULES) -> Column:
    out = None
    for k, knots in enumerate(schedules):
        at = _inverse(share, knots)
        out = F.when(weight_no == k, at) if out is None else out.when(weight_no == k, at)
    return out


def _hashed(docs: DataFrame) -> list[Column]:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return [F.col("doc_id").alias("_id"), F.col("source"), order.alias("_order"), F.substring(order, 1, BUCKET_DIGITS).alias("_bucket")]


def _reading(r: int | Column, size: Column, start: Column) -> Column:
    """Words taken in reading ``r`` of what has ``size`` words and stands at ``start`` in its source."""
    return F.greatest(F.lit(0), F.least(size, F.floor("target").cast("long") - start - F.col("source_size") * r)).cast("long")


def _due(r: int | Column, start: Column, words: Column, schedules) -> Column:
    return training_position((start + F.col("source_size") * r + words) / F.col("target"), F.col("weight_no"), schedules)


def plan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights=WEIGHTS, budget=BUDGET, most_repeats: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """Words to take of every document, and when they are due.

    Returns ``keep`` and source, size, source_size, target, taken, first_taken
    (words of the first reading), positions: one per reading in which words
    are taken, and _start: the words before it in its source. ``docs`` needs
    doc_id, source and text.
    """
    return _planned(docs, keep, weights, budget, most_repeats, schedules)[0]


def _planned(docs: DataFrame, keep: Sequence[str], weights, budget, most_repeats: int, schedules) -> tuple[DataFrame, DataFrame]:
    """(the plan, its buckets with their starts and targets)."""
    names = [f"_k{i}" for i in range(len(keep))]
    sized = cut(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], word_count().alias("size"), F.xxhash64(text_of()).alias("_text"), *_hashed(docs)))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, budget, most_repeats)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = buckets.withColumn("_base", F.sum("_sum").over(before) - F.col("_sum"))
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "weight_no", "target")
    placed = sized.withColumn("_to", F.sum("size").over(_inside("source", "_bucket")))
    placed = placed.alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._bucket") == F.col("s._bucket"))
    ).select("d.*", "_base", "source_size", "weight_no", "target")
    start = F.col("_base") + F.col("_to") - F.col("size")
    takes = [_reading(r, F.col("size"), start) for r in range(most_repeats)]
    taken = takes[0]
    for t in takes[1:]:
        taken = taken + t
    due = F.array(*[F.when(t > 0, _due(r, start, t / 2, schedules)) for r, t in enumerate(takes)])
    planned = placed.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        "source", "size", "source_size", "target", taken.alias("taken"), takes[0].alias("first_taken"),
        F.filter(due, lambda x: x.isNotNull()).alias("positions"), start.alias("_start"),
    )
    return planned, starts


def _inside(*bucket: str):
    """The rows of a bucket up to the current one; of equal ids and sizes the text's hash decides, so that every reading meets the same order."""
    return Window.partitionBy(*bucket).orderBy("_order", "_id", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _slot(due: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), F.floor(due * SLOTS))).cast("int")


def _delivered(docs: DataFrame, starts: DataFrame, most_repeats: int, schedules) -> DataFrame:
    """(doc_id, source, start, reading, words, due, text): each reading's text, range-sorted by due."""
    r, words = F.col("_reading"), F.col("_words")
    spans = starts.withColumn("_reading", F.explode(F.array(*[F.lit(i) for i in range(most_repeats)])))
    spans = spans.withColumn("_words", _reading(r, F.col("_sum"), F.col("_base"))).filter("_words > 0")
    # Whatever is taken of a bucket is due between its first and last word.
    first, last = (_slot(_due(r, F.col("_base"), w, schedules) + e) for w, e in ((F.lit(0), -1e-9), (words, 1e-9)))
    homes = cut(spans.withColumn("_slot", F.explode(F.sequence(first, last))).drop("_words", "_sum"))
    rows = docs.select(*_hashed(docs), text_of().alias("text"))
    # At most a row for each bucket and reading, and some more for slots' ends.
    near = F.broadcast(homes) if homes.count() <= SENT_ROWS else homes
    sent = rows.alias("d").join(
        near.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d._bucket") == F.col("h._bucket"))
    ).select("d.*", "_reading", "_slot", "_base", "source_size", "weight_no", "target")
    here = sent.repartitionByRange("_slot").withColumns({"size": word_count(), "_text": F.xxhash64("text")})
    start = F.col("_base") + F.sum("size").over(_inside("_slot", "source", "_bucket", "_reading")) - F.col("size")
    here = here.withColumn("start", start).withColumn("_words", _reading(r, F.col("size"), F.col("start")))
    here = here.withColumn("due", _due(r, F.col("start"), words / 2, schedules)).filter((words > 0) & (_slot(F.col("due")) == F.col("_slot")))
    # Only the last reading of a source ends within a text.
    shorter = F.when(words < F.col("size"), first_words(F.col("text"), words.cast("int")))
    here = here.withColumn("_shorter", shorter)
    here = here.select(
        F.col("_id").alias("doc_id"), "source", "start", r.alias("reading"),
        F.when(F.col("_shorter").isNull(), F.col("size")).otherwise(word_count("_shorter")).alias("words"), "due", F.coalesce("_shorter", "text").alias("text"),
    )
    return here.sortWithinPartitions("due", "source", "start")


def deliver(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most_repeats: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, start, reading, words, due, text) of every reading, range-sorted by when it is due.

    ``start`` tells the documents of a source apart: the words before one in its
    order. A reading that ends within a text has that text up to its last word.
    """
    return _delivered(docs, _planned(docs, ("doc_id",), weights, budget, most_repeats, schedules)[1], most_repeats, schedules)


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights=WEIGHTS, budget=BUDGET, most_repeats: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """Words taken of every document, and when they were due, from the texts that ``deliver`` reads out.

    Returns ``keep`` and source, size, source_size, target, taken, first_taken
    (words of the first reading) and positions: one per reading in which words
    are taken. ``docs`` needs doc_id, source and text.
    """
    planned, starts = _planned(docs, keep, weights, budget, most_repeats, schedules)
    read = _delivered(docs, starts, most_repeats, schedules).groupBy("source", "start").agg(
        F.sum("words").alias("_taken"), F.sum(F.when(F.col("reading") == 0, F.col("words"))).alias("_first"),
        F.sort_array(F.collect_list(F.struct("reading", "due")))["due"].alias("_positions"),
    )
    # A document without words takes none and may stand where another starts.
    both = planned.alias("p").join(
        read.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p._start") == F.col("r.start")) & (F.col("p.size") > 0), "left"
    )
    return both.select(
        *[F.col(f"p.`{c}`").alias(c) for c in keep], "p.source", "p.size", "p.source_size", "p.target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("_first", F.lit(0)).cast("long").alias("first_taken"), F.coalesce("_positions", F.array().cast("array<double>")).alias("positions"),
    )


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, white space before it included."""
    space = rf"[{SPACE_CLASS}]"
    # Each part but the last ends with a word.
    return F.array_join(F.slice(F.split(text, rf"(?<=[^{SPACE_CLASS}])(?={space})"), F.lit(1), n), "")


def training_order(docs: DataFrame, cut_last: bool = False, **options) -> DataFrame:
    """``docs`` as often as the mix reads them, range-sorted by training position.

    All readings of a document are whole but its last. With ``cut_last`` that one
    ends at the last word taken, and n_chars, if there is such a column, follows;
    so the result holds exactly the words that ``mix`` takes. Otherwise a reading
    of less than half of a document is left out, and of more is whole: at most
    one document per source and reading is rounded.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # Texts are written once, within their rows.
    numbered = cut(docs.select(row, F.monotonically_increasing_id().alias("_uid")))
    mixed = plan(numbered.select("_uid", *[F.col("_row")[c].alias(c) for c in ("doc_id", "source", "text")]), keep=("_uid",), **options)
    if not cut_last:
        readings = F.round(F.try_divide("taken", "size")).cast("int")
        due = mixed.select("_uid", F.explode(F.slice("positions", F.lit(1), F.greatest(F.lit(0), F.least(readings, F.size("positions"))))).alias("_due"))
        placed = numbered.select("_uid", "_row").join(due, "_uid")
        return placed.repartitionByRange("_due", "_uid").sortWithinPartitions("_due", "_uid").select("_row.*")
    due = mixed.select("_uid", "size", "taken", F.size("positions").alias("_n"), F.posexplode("positions").alias("_at", "_due"))
    words = F.when(F.col("_at") < F.col("_n") - 1, F.col("size")).otherwise(F.col("taken") - F.col("size") * (F.col("_n") - 1))
    due = due.select("_uid", "_due", F.when(words < F.col("size"), words.cast("int")).alias("_words"))
    placed = numbered.select("_uid", "_row").join(due, "_uid")
    shorter = first_words(F.col("_row")["text"], F.col("_words"))
    row = F.col("_row").withField("text", shorter)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(shorter).cast(docs.schema["n_chars"].dataType))
    placed = placed.withColumn("_row", F.when(F.col("_words").isNull(), F.col("_row")).otherwise(row))
    return placed.repartitionByRange("_due", "_uid").sortWithinPartitions("_due", "_uid").select("_row.*")
