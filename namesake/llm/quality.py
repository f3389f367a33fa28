"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows. Every path from a root to a node is a
rule: a conjunction of limits on statistics. A logistic model with an L1 penalty
gives each rule a weight and most of them none. The rules that remain are
compiled into one column expression, so scoring is a projection in the scan.

At most MAX_LABELLED labelled rows are used for fitting, those of the smallest
hash of their id; this is the only bound, and a parameter.

Defined results: null and empty texts have statistics of no words and a score
like any other; long texts are measured whole; rows are scored one by one, so
repeated rows and null ids stay. Without labelled rows every score is 0.5, with
labels of one kind only it is the smoothed share of that kind. An empty table
gives an empty result. doc_id and text are read, never lang or source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm import stats
from namesake.llm.common import crc_fold, text_of
from namesake.session import cut

MAX_LABELLED = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.002
THRESHOLD = 0.3
#: Rows of a fold are held out of learning.
FOLDS, HELD_OUT = 5, 0

STATISTICS = (
    "log_words", "word_length", "symbol_rate", "bang_rate", "point_rate", "upper_rate", "digit_rate", "letter_rate",
    "distinct_rate", "line_rate", "dup_line_rate",
)


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """Adds the statistics of a text column that holds no null."""
    t = F.col(text)
    df = df.withColumn("_words", stats.words_of(t)).withColumn("_lines", stats.filled_lines(t))
    words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    chars = F.greatest(stats.word_chars(t), F.lit(1)).cast("double")
    made = {
        "log_words": F.log1p(F.size("_words")),
        "word_length": stats.word_chars(t) / words,
        "symbol_rate": stats.count_of(t, f"[{stats.SYMBOLS}]") / words,
        "bang_rate": stats.count_of(t, "[!?]") / words,
        "point_rate": stats.count_of(t, "[.,;:]") / words,
        "upper_rate": stats.count_of(t, r"\p{Lu}") / chars,
        "digit_rate": stats.count_of(t, r"\p{N}") / chars,
        "letter_rate": stats.count_of(t, r"\p{L}") / chars,
        "distinct_rate": F.size(F.array_distinct("_words")) / words,
        "line_rate": F.size("_lines") / words,
        "dup_line_rate": stats.repeats(F.col("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
    }
    return df.withColumns(made).drop("_words", "_lines")


#: Limits of one rule: (statistic, upper limit or not, value); x <= value or x > value.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules; the score is the logistic function of their sum."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total: Column = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = None
    for name, upper, value in rule:
        limit = F.col(name) <= value if upper else F.col(name) > value
        out = limit if out is None else out & limit
    return out


def tidy(limits: Sequence[tuple[str, bool, float]]) -> Rule:
    """A path's limits with only the tightest of each statistic and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, upper, value in limits:
        old = best.get((name, upper))
        best[name, upper] = value if old is None else min(old, value) if upper else max(old, value)
    return tuple(sorted((n, u, v) for (n, u), v in best.items()))


def tree_rules(model, names: Sequence[str]) -> list[Rule]:
    """The paths to all nodes of a forest but its roots, each once."""
    found: dict[Rule, None] = {}

    def walk(node, limits):
        if limits:
            found.setdefault(tidy(limits))
        if node.numDescendants() > 0:
            split = node.split()
            name, value = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*limits, (name, True, value)])
            walk(node.rightChild(), [*limits, (name, False, value)])

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), [])
    # A rule and its complement say the same: of a root's two children one is enough.
    return [r for r in found if not (len(r) == 1 and r[0][1] is False and ((r[0][0], True, r[0][2]),) in found)]


def fit_rules(table: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fits rules to a written table of statistics and ``label`` (0 or 1)."""
    counts = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        share = (good + 1) / (good + bad + 2)
        return RuleModel(float(_logit(share)), {})
    assemble = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(table).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=11)
    rules = tree_rules(forest.fit(assemble), STATISTICS)
    if not rules:
        return RuleModel(float(_logit((good + 1) / (good + bad + 2))), {})
    marks = [holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    marked = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(table.select(*marks, "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(marked.select("features", "label"))
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients) if w}
    return RuleModel(float(lasso.intercept), weights)


def _logit(share: float) -> float:
    from math import log

    return log(share / (1 - share))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> RuleModel:
    """Learns quality from labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(FOLDS) != HELD_OUT))
    chosen = usable.select("doc_id", F.col("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    # At most ``most`` rows of two numbers.
    rows = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "_text")
    # The scan keeps its own tasks; only the written statistics, ``most`` rows but for repeated ids, are put in order.
    measured = cut(with_statistics(rows, "_text").select("doc_id", *STATISTICS, "label"))
    return fit_rules(cut(measured.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "label", *STATISTICS)))


def score(docs: DataFrame, model: RuleModel, keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, held_out, score and predicted for every row of ``docs``."""
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], crc_fold(FOLDS).alias("_fold"), text_of().alias("_text"))
    df = with_statistics(df, "_text").withColumn("score", model.score())
    return df.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)],
        (F.col("_fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good, with their own columns."""
    model = train(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    # A row number beside the score keeps the filter above it: moved below, it would work each statistic out once per rule.
    scored = score(packed, model, keep=("_row",), threshold=threshold).withColumn("_at", F.monotonically_increasing_id())
    return scored.filter((F.col("predicted") == 1) & (F.col("_at") >= 0)).select("_row.*")
