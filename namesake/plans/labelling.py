"""Label rounds with a person in between; all state lives in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.operators import committee, sampling
from namesake.session import cut
from namesake.sources.labels import label_cells, read_labels, write_to_label

# Rows of the first round, of a later round, and of its pool.
FIRST_ROUND = 100
ROUND_SIZE = 100
POOL_SIZE = 5000


def first_round(pool: DataFrame, n: int = FIRST_ROUND, seed: int = 42) -> DataFrame:
    """A random sample of the pool to label first."""
    return sampling.random_sample(pool, "pair_id", n, seed)


def training_rows(pool: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """Labelled pairs with their features, joined by pair id."""
    known = labels.filter(F.col("label").isNotNull()).select("pair_id", "label")
    return pool.select("pair_id", *features).join(known, "pair_id")


def next_round(
    pool: DataFrame,
    labels: DataFrame,
    features: list[str],
    round_num: int,
    n: int = ROUND_SIZE,
    pool_size: int = POOL_SIZE,
    size: int = committee.COMMITTEE_SIZE,
    params: committee.TreeParams = committee.ROUND_PARAMS,
) -> DataFrame:
    """Pairs to label next: undecided by the committee, and diverse.

    Adds ``predicted`` (vote share) and ``uncertainty`` to the pool columns.
    """
    seed = 42 + round_num
    models = committee.train_committee(training_rows(pool, labels, features), features, params, size, seed)
    scored = committee.score_committee(pool.select("pair_id", *features), models, features)
    scored = scored.select("pair_id", F.col("prob").alias("predicted"))
    uncertain = cut(sampling.uncertain_pool(scored, labels, pool_size))
    candidates = cut(uncertain.join(pool, "pair_id"))
    chosen = sampling.diverse_sample(candidates, features, n, seed=42)
    return candidates.join(chosen, "pair_id")


class LabelRounds:
    """Rounds kept under one folder; every call can be repeated after a crash.

    ``to_label/round=n`` is what a person gets, ``labelled/round=n`` what they
    return, ``labels`` the labels absorbed so far.
    """

    def __init__(self, spark: SparkSession, folder: str, pool: DataFrame, features: list[str]):
        self.spark, self.folder, self.pool, self.features = spark, folder.rstrip("/"), pool, features

    def to_label(self, n: int) -> str:
        return f"{self.folder}/to_label/round={n}"

    def labelled(self, n: int) -> str:
        return f"{self.folder}/labelled/round={n}"

    def labels(self, up_to: int) -> DataFrame:
        """Labels of the rounds 0 to ``up_to``; of a pair labelled twice, the later one."""
        rounds = [
            self.spark.read.parquet(f"{self.folder}/labels/round={n}").select("pair_id", "label", F.lit(n).alias("_round"))
            for n in range(up_to + 1)
        ]
        given = reduce(DataFrame.unionByName, rounds).filter(F.col("label").isNotNull())
        return given.groupBy("pair_id").agg(F.max(F.struct("_round", "label"))["label"].alias("label"))

    def start_round(self, round_num: int, **options) -> DataFrame:
        """Choose the pairs of a round and export their cells."""
        if round_num == 0:
            rows = first_round(self.pool, **options)
        else:
            rows = next_round(self.pool, self.labels(round_num - 1), self.features, round_num, **options)
        rows = cut(rows)
        write_to_label(label_cells(rows), self.to_label(round_num), mode="overwrite")
        return rows

    def finish_round(self, n: int) -> DataFrame:
        """Absorb the labels a person returned for round ``n``."""
        got = read_labels(self.spark, self.labelled(n), with_scores=n > 0)
        got.select("pair_id", "label").write.mode("overwrite").parquet(f"{self.folder}/labels/round={n}")
        return self.labels(n)

    def fit_final(
        self,
        last: int,
        size: int = committee.COMMITTEE_SIZE,
        params: committee.TreeParams = committee.FINAL_PARAMS,
        seed: int = 42,
    ) -> list:
        """Train on all labels and save the committee."""
        rows = training_rows(self.pool, self.labels(last), self.features)
        models = committee.train_committee(rows, self.features, params, size, seed)
        committee.save_committee(models, f"{self.folder}/committee")
        return models
