"""Samples, committees, label rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.operators import committee, sampling
from namesake.plans.labelling import LabelRounds, next_round
from namesake.session import cut
from namesake.sources import labels as label_files

FEATURES = ["a", "b"]
SMALL = committee.TreeParams(maxIter=3)


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((120, 2)))]
    df = spark.createDataFrame(rows, "pair_id long, a double, b double")
    attrs = ["year"] + sorted({c for cols in label_files.CELLS.values() for c in cols})
    for side in (1, 2):
        for c in attrs:
            df = df.withColumn(f"{side}_{c}", F.lit(1850.25) if c == "year" else F.concat(F.lit(f'{c}"{side} '), F.col("pair_id").cast("string")))
    return cut(df)


def truth(df):
    return df.withColumn("label", (F.col("a") + F.col("b") > 1).cast("int"))


def test_random_sample(spark, pool):
    a = sampling.random_sample(pool.repartition(7), "pair_id", 30).select("pair_id").collect()
    b = sampling.random_sample(pool.repartition(2), "pair_id", 30).select("pair_id").collect()
    assert sorted(a) == sorted(b) and len({r[0] for r in a}) == 30


def test_bootstrap_draws_n_rows(spark, pool):
    drawn = sampling.bootstrap_counts(pool, "pair_id", 4).collect()
    per_member = {}
    for r in drawn:
        per_member[r["member"]] = per_member.get(r["member"], 0) + r["times"]
    assert per_member == {m: 120 for m in range(4)}
    distinct = len([r for r in drawn if r["member"] == 0]) / 120
    assert 0.5 < distinct < 0.75


def test_standardise(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "x double, y double")
    assert [tuple(r) for r in sampling.standardise(df, ["x", "y"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_k_centre_against_greedy(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((60, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "pair_id long, vec array<double>")
    first = spark.createDataFrame([(5,), (9,)], "pair_id long")
    got = [r[0] for r in sampling.k_centre_fill(df, first, 14).collect()]
    chosen = [5, 9]
    while len(chosen) < 14:
        gaps = np.min([np.linalg.norm(pts - pts[c], axis=1) for c in chosen], axis=0)
        gaps[chosen] = -1
        chosen.append(int(np.argmax(gaps)))
    assert sorted(got) == sorted(chosen)


def test_k_centre_without_start(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in (0, 1, 2, 10)], "pair_id long, vec array<double>")
    none = spark.createDataFrame([], "pair_id long")
    assert [r[0] for r in sampling.k_centre_fill(df, none, 2).collect()] == [10, 0]


def test_diverse_sample(spark, pool):
    got = [r[0] for r in sampling.diverse_sample(pool.select("pair_id", *FEATURES), FEATURES, 15, clusters=6).collect()]
    assert len(got) == len(set(got)) == 15
    assert sampling.diverse_sample(pool, FEATURES, 500).count() == 120


def test_uncertain_pool(spark):
    scored = spark.createDataFrame([(1, 0.5), (2, 0.48), (3, 0.52), (4, 1.0), (5, 0.5)], "pair_id long, predicted double")
    labelled = spark.createDataFrame([(5,)], "pair_id long")
    assert [r["pair_id"] for r in sampling.uncertain_pool(scored, labelled, 3).collect()] == [1, 2, 3]


def test_class_counts(spark):
    df = spark.createDataFrame([(1,)] * 243 + [(0,)] * 457, "label int")
    r = committee.class_counts(df).first()
    assert (r["n_pos"], r["n_neg"]) == (243, 457) and math.isclose(r["pos_weight"], 457 / 243)


def test_committee_round_trip(spark, pool, tmp_path):
    rows = truth(pool).select("pair_id", "label", *FEATURES)
    models = committee.train_committee(rows, FEATURES, SMALL, size=3)
    scored = committee.score_committee(pool, models, FEATURES, members=True).collect()
    for r in scored:
        votes = [p >= 0.5 for p in r["member_probas"]]
        assert math.isclose(r["prob"], sum(votes) / 3) and r["predicted"] == int(r["prob"] >= 0.5)
    committee.save_committee(models, str(tmp_path / "c"))
    again = committee.load_committee(spark, str(tmp_path / "c"), 3)
    reloaded = {r["pair_id"]: r["prob"] for r in committee.score_committee(pool, again, FEATURES).collect()}
    assert reloaded == {r["pair_id"]: r["prob"] for r in scored}


def answer(rounds, pool, n):
    """A person fills in the label column of round n."""
    schema = label_files.label_schema(n > 0)
    read = rounds.spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    got = read.csv(rounds.to_label(n))
    known = truth(pool).select(F.col("pair_id").alias("index"), "label")
    filled = got.join(known, "index").withColumn("oracle", F.col("label")).select(*schema.names)
    filled.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(rounds.labelled(n))
    return got


def test_label_rounds(spark, pool, tmp_path):
    rounds = LabelRounds(spark, str(tmp_path), pool, FEATURES)
    first = rounds.start_round(0, n=40)
    shown = answer(rounds, pool, 0)
    assert shown.count() == first.count() == 40
    cell = shown.filter(F.col("index") == first.first()["pair_id"]).first()["jigou"]
    i = first.first()["pair_id"]
    assert cell == f'jigou_1"1 {i} jigou_2"1 {i} |\n jigou_1"2 {i} jigou_2"2 {i}'
    assert rounds.finish_round(0).count() == 40
    second = rounds.start_round(1, n=10, pool_size=30, size=3, params=SMALL)
    ids = {r["pair_id"] for r in second.collect()}
    assert len(ids) == 10 and not ids & {r["pair_id"] for r in first.collect()}
    answer(rounds, pool, 1)
    assert rounds.finish_round(1).count() == 50
    # Repeating a step changes nothing.
    assert rounds.finish_round(1).count() == 50
    models = rounds.fit_final(1, size=2, params=SMALL)
    assert len(models) == 2 and len(committee.load_committee(spark, f"{tmp_path}/committee", 2)) == 2


def test_k_centre_picks_several_a_job(spark):
    """Bounds decide when points must be measured again; ties and few points at hand change nothing."""
    rng = np.random.default_rng(6)
    pts = np.round(rng.random((80, 2)) * 4) / 4
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "pair_id long, vec array<double>")
    first = spark.createDataFrame([(3,)], "pair_id long")
    chosen = [3]
    while len(chosen) < 12:
        gaps = np.round(np.min([np.linalg.norm(pts - pts[c], axis=1) for c in chosen], axis=0), 9)
        gaps[chosen] = -1
        chosen.append(int(np.argmax(gaps)))
    for at_once in (2, 7, 100):
        assert [r[0] for r in sampling.k_centre_fill(df, first, 12, at_once=at_once).collect()] == chosen
