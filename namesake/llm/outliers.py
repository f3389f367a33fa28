"""Quality rules: fixed limits, and robust multivariate outliers by language and source.

Ratios of the text are transformed to a vector. For each language and source
the minimum-covariance-determinant estimate of its centre and spread is sought:
from medians and absolute deviations on, the closest three quarters of the
documents give the next estimate, until no determinant falls any further.
A document far from its group's centre in Mahalanobis distance is rejected.

Only DataFrame functions are used. A step is one aggregation of a narrow table
that combines before it shuffles, whatever the size of a group; distances come
from the Cholesky factor of the covariance, written as columns. Every variance
has a floor added, so that a statistic which most documents share (no symbols at
all) doesn't make a group infinitely strict.

Groups of fewer than MIN_ROWS documents are pooled by language, and small
languages together; a pool that is still below has no estimate and rejects
nothing. Null languages and sources are groups of their own.

Defined results: null and empty texts have no words and fail the limits; texts
of any length are measured whole; repeated rows and null ids are judged one by
one; an empty table gives an empty result. Columns beside doc_id, text, lang and
source are only carried when ``keep`` names them, under names of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm import stats
from namesake.llm.common import text_of
from namesake.operators.components import join_counted
from namesake.session import cut, release

#: Tables of one row for each group are broadcast up to this number of rows, of some thirty numbers each.
FEW_GROUPS = 50_000
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Share of a group that the determinant is taken over.
INNER = 0.75
MIN_ROWS = 100
#: Squared distance beyond which a document is rejected: the 0.999 quantile of chi-square, 4 degrees of freedom.
MOST_DISTANCE = 18.47
#: Least scale of each part of the vector, in its own unit. In a group without repetition the last two reject
#: by themselves from 19% of duplicate lines and from 18% of repeated words on.
FLOORS = (0.08, 0.35, 0.1, 0.1)
#: The covariance of the inner three quarters of a normal sample is smaller than that of the whole by this factor (4 dimensions).
CONSISTENCY = 1.87
#: A fall of the log determinant below this ends the steps.
SETTLED = 1e-3
DIMS = len(FLOORS)
VECTOR = [f"_x{i}" for i in range(DIMS)]


def attach(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with their group's row of a written table, without moving a hot group into one task."""
    if table.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(table), "_group", how)
    sizes = rows.groupBy("_group").agg(F.count("*").alias("_n")).join(table, "_group", how)
    return join_counted(rows, sizes, "_group", "_n", rows.count())


def measured(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` as _k0, ..., language and source, the counts, base_failed and the vector."""
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("lang").alias("_lang"), F.col("source").alias("_source"), text_of().alias("_text"))
    t = F.col("_text")
    df = df.withColumn("_words", stats.words_of(t))
    df = stats.with_repeated_window_words(df, "_words", "n_repeat_words")
    df = df.withColumn("_lines", stats.filled_lines(t)).select(
        *names, "_lang", "_source",
        F.size("_words").cast("long").alias("n_words"),
        stats.word_chars(t).alias("word_chars"),
        stats.count_of(t, f"[{stats.SYMBOLS}]").alias("n_symbols"),
        stats.repeats(F.col("_lines")).alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").alias("_n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    words = F.greatest("n_words", F.lit(1))
    vector = (
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(F.col("n_symbols") * 10 / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))),
        F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    )
    return df.withColumn("base_failed", failed).withColumns(dict(zip(VECTOR, vector))).drop("_n_lines")


def grouped(table: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds _group: the language and source, or the pool that stands in for it."""
    sound = table.filter(~F.col("base_failed"))
    name = F.to_json(F.array(F.coalesce("_lang", F.lit("\x00")), F.coalesce("_source", F.lit("\x00"))))
    pairs = sound.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    large = F.col("n") >= min_rows
    langs = pairs.filter(~large).groupBy("_lang").agg(F.sum("n").alias("m"))
    both = pairs.alias("p").join(langs.alias("l"), F.col("p._lang").eqNullSafe(F.col("l._lang")), "left").select("p.*", "m")
    pool = F.when(large, name).when(F.col("m") >= min_rows, F.to_json(F.array(F.coalesce("_lang", F.lit("\x00")))))
    chosen = cut(both.select("_lang", "_source", F.coalesce(pool, F.lit("*")).alias("_group")))
    small = F.broadcast(chosen) if chosen.count() <= FEW_GROUPS else chosen
    return (
        table.alias("t")
        .join(small.alias("g"), F.col("t._lang").eqNullSafe(F.col("g._lang")) & F.col("t._source").eqNullSafe(F.col("g._source")), "left")
        .select("t.*", F.coalesce("_group", F.lit("*")).alias("_group"))
    )


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance, and the log determinant."""
    for j in range(DIMS):
        inner = F.col(f"c{j}{j}")
        for k in range(j):
            inner = inner - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        estimates = estimates.withColumn(f"l{j}{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))))
        for i in range(j + 1, DIMS):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    logs = [F.log(f"l{j}{j}") * 2 for j in range(DIMS)]
    return estimates.withColumn("logdet", sum(logs[1:], logs[0]))


def _with_distance(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds _d: the squared Mahalanobis distance from the row's group (null without an estimate)."""
    df = attach(df, estimates, "left")
    for i in range(DIMS):
        z: Column = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", z / F.col(f"l{i}{i}"))
    squares = [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(DIMS)]
    return df.withColumn("_d", sum(squares[1:], squares[0]))


def _estimate(rows: DataFrame, floors: Sequence[float], consistency: float) -> DataFrame:
    """Mean and covariance of each group's rows."""
    sums = [F.avg(VECTOR[i]).alias(f"m{i}") for i in range(DIMS)]
    products = [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"v{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    table = rows.groupBy("_group").agg(*sums, *products, F.count("*").alias("inner_rows"))
    made = [
        (F.col(f"v{i}{j}") * consistency + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(DIMS) for j in range(i + 1)
    ]
    return _factor(table.select("_group", "inner_rows", *[f"m{i}" for i in range(DIMS)], *made))


def robust_estimates(rows: DataFrame, floors: Sequence[float] = FLOORS, inner: float = INNER, min_rows: int = MIN_ROWS) -> DataFrame:
    """Minimum-covariance-determinant estimate of each _group of ``rows`` (a written table)."""
    medians = rows.groupBy("_group").agg(
        F.count("*").alias("rows"), *[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    ).filter(F.col("rows") >= min_rows)
    medians = cut(medians)
    spread = attach(rows, medians).groupBy("_group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000).alias(f"a{i}") for i, x in enumerate(VECTOR)],
    )
    start = [
        (F.pow(F.col(f"a{i}") * 1.4826, 2) + floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}")
        for i in range(DIMS) for j in range(i + 1)
    ]
    current = cut(_factor(spread.select("_group", F.lit(0).cast("long").alias("inner_rows"), *[f"m{i}" for i in range(DIMS)], *start)))
    first = True
    while True:
        near = _with_distance(rows, current)
        limits = cut(near.groupBy("_group").agg(F.percentile_approx("_d", inner, 10000).alias("_limit")).filter(F.col("_limit").isNotNull()))
        closest = attach(near.select("_group", *VECTOR, "_d"), limits).filter(F.col("_d") <= F.col("_limit"))
        following = cut(_estimate(closest, floors, CONSISTENCY))
        fall = following.alias("a").join(current.alias("b"), "_group").agg(F.max(F.col("b.logdet") - F.col("a.logdet"))).first()[0]
        if not first and (fall is None or fall < SETTLED):
            release(following)
            return current
        former, current, first = current, following, False
        release(former)


def judge(docs: DataFrame, keep: Sequence[str] = ("doc_id",), floors: Sequence[float] = FLOORS, inner: float = INNER, min_rows: int = MIN_ROWS, most_distance: float = MOST_DISTANCE) -> DataFrame:
    """``keep``, the counts, base_failed, distance (squared, of documents within the limits) and kept."""
    names = [f"_k{i}" for i in range(len(keep))]
    table = grouped(cut(measured(docs, keep)), min_rows)
    rows = cut(table.filter(~F.col("base_failed")).select("_group", *VECTOR))
    judged = _with_distance(table, robust_estimates(rows, floors, inner, min_rows))
    far = F.coalesce(F.col("_d") > most_distance, F.lit(False))
    return judged.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("_d")).alias("distance"),
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    return judge(packed, keep=("_row",), **options).filter("kept").select("_row.*")
