"""A committee of boosted-tree classifiers that votes."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.operators.sampling import bootstrap_counts
from namesake.session import cut


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters of one member."""

    maxIter: int = 180
    stepSize: float = 0.1
    maxDepth: int = 4
    subsamplingRate: float = 0.7
    featureSubsetStrategy: str = "0.8"
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0


# Parameters of a labelling round and of the final committee.
ROUND_PARAMS = TreeParams()
FINAL_PARAMS = TreeParams(featureSubsetStrategy="all", minInstancesPerNode=2, minInfoGain=1e-4)
COMMITTEE_SIZE = 25


def class_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row (n_pos, n_neg, pos_weight) with pos_weight = negatives / positives."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count("*") - pos
    return labelled.agg(
        pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.greatest(pos, F.lit(1))).alias("pos_weight")
    )


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns as one vector; -1 stays an ordinary low value."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def train_committee(
    labelled: DataFrame,
    features: list[str],
    params: TreeParams = ROUND_PARAMS,
    size: int = COMMITTEE_SIZE,
    seed: int = 42,
    key: str = "pair_id",
    parallelism: int = 4,
) -> list[GBTClassificationModel]:
    """Members fitted on bootstrap samples of ``labelled(key, label, features)``.

    A draw count times the class weight enters as the row weight, so all
    members share one table. They are independent and fitted side by side.
    """
    ratio = class_counts(labelled).first()["pos_weight"]
    times = bootstrap_counts(labelled, key, size, seed)
    drawn = times.groupBy(key).agg(
        *[F.sum(F.when(F.col("member") == b, F.col("times"))).alias(f"times_{b}") for b in range(size)]
    )
    rows = cut(labelled.select(key, F.col("label").cast("double").alias("label"), *features).join(drawn, key))
    balance = F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0))

    def fit(b: int) -> GBTClassificationModel:
        weight = (F.col(f"times_{b}") * balance).alias("weight")
        sample = assemble(rows.filter(F.col(f"times_{b}") > 0).select("label", weight, *features), features)
        return GBTClassifier(seed=seed + b, weightCol="weight", **asdict(params)).fit(sample)

    target = inheritable_thread_target(labelled.sparkSession)(fit)
    with ThreadPool(parallelism) as pool:
        return pool.map(target, range(size))


def vote_share(votes: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [v.cast("double") for v in votes]) / len(votes)


def score_committee(
    pairs: DataFrame, models: list[GBTClassificationModel], features: list[str], threshold: float = 0.5, members: bool = False
) -> DataFrame:
    """Add ``prob`` (share of positive votes) and ``predicted`` (prob >= threshold).

    ``members`` adds the probability each member gives, as ``member_probas``.
    """
    kept = pairs.columns
    scored = assemble(pairs, features)
    for b, model in enumerate(models):
        voter = model.copy().setPredictionCol(f"_vote_{b}").setRawPredictionCol("")
        voter.setProbabilityCol(f"_proba_{b}" if members else "")
        scored = voter.transform(scored)
    out = scored.withColumn("prob", vote_share([F.col(f"_vote_{b}") for b in range(len(models))]))
    extra = []
    if members:
        extra = [F.array(*[vector_to_array(f"_proba_{b}")[1] for b in range(len(models))]).alias("member_probas")]
    return out.select(*kept, "prob", (F.col("prob") >= threshold).cast("int").alias("predicted"), *extra)


def save_committee(models: list[GBTClassificationModel], path: str) -> None:
    for b, model in enumerate(models):
        model.write().overwrite().save(f"{path}/member={b}")


def load_committee(spark: SparkSession, path: str, size: int = COMMITTEE_SIZE) -> list[GBTClassificationModel]:
    return [GBTClassificationModel.load(f"{path}/member={b}") for b in range(size)]
