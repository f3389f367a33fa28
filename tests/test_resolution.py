"""Files and the whole task on planted duplicates."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesake.operators import committee, summary
from namesake.plans import pairing, resolution
from namesake.plans.preparation import describe_values
from namesake.session import cut
from namesake.sources import dictionaries, records as files
from namesake.spec import LinkageSpec

SPEC = LinkageSpec(window=4, top_k=4)


@pytest.fixture(scope="module")
def planted(spark):
    """People who appear in several editions, now and then with a changed value."""
    rng = random.Random(11)
    people = []
    for p in range(25):
        name = ("".join(rng.sample("wanglizhou", 3)), "".join(rng.sample("mingdeyupqr", 5)))
        people.append((*name, f"town{p % 9}", f"prov{p % 4}"))
    rows, truth = [], {}
    for seq in range(8):
        for p, (x, m, town, prov) in enumerate(people):
            if rng.random() < 0.7:
                i = len(rows)
                truth[i] = p
                shown = "?" if rng.random() < 0.15 else town
                rows.append((i, 1850 + seq // 4, seq % 4 + 1, f"e{seq}", "1850", "s", x, m, shown, prov))
    raw = spark.createDataFrame(
        [(r[0], str(r[1]), str(r[2]), None, None, *r[3:6], "d", None, None, "g", r[6], r[7], None, r[9], r[8], "c") for r in rows],
        "record_id long, " + ", ".join(f"`{c}` string" for c in files.RAW_COLUMNS),
    )
    return raw, truth


def test_sources(spark, planted, tmp_path):
    raw, truth = planted
    converted = files.convert_raw(raw)
    files.write_csv(converted, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.schema == files.CONVERTED_SCHEMA and sorted(back.collect()) == sorted(converted.collect())
    with_gap = back.unionByName(back.limit(1).withColumn("xing", F.lit(None).cast("string")).withColumn("record_id", F.lit(10**9)))
    recs, editions = files.prepare_records(with_gap, SPEC.match_cols, "xing")
    assert recs.count() == len(truth) and recs.filter("zihao = '?'").count() == len(truth)
    assert [r["edition_seq"] for r in editions.orderBy("first_record").collect()] == list(range(8))
    out = str(tmp_path / "records")
    files.write_records(recs, out)
    one = files.read_edition(spark, out, "e3" + "1850s")
    assert one.count() == recs.filter("edition_seq = 3").count()
    plan = one.select("record_id")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*e31850s", plan) and "ReadSchema: struct<record_id:bigint>" in plan
    window = files.read_edition_window(spark, out, 2, 3)
    assert {r[0] for r in window.select("edition_seq").distinct().collect()} == {2, 3, 4}
    assert sum(r["n_records"] for r in files.edition_counts(files.read_records(spark, out)).collect()) == len(truth)
    files.write_json(recs.select("record_id", "xing"), str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), recs.select("record_id", "xing").schema).count() == len(truth)
    files.write_table(editions, str(tmp_path / "editions"))
    assert files.read_table(spark, str(tmp_path / "editions")).count() == 8


def test_csv_by_heading(spark, tmp_path):
    """Columns in another order, quotes and commas in cells, a missing column, several files and blocks."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])
    rows = [(i, f'j "one", {i}' if i % 3 else None, i / 4) for i in range(3000)]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "csv")
    files.write_csv(df.select("c", "b", "a").coalesce(1).sortWithinPartitions("a"), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        back = files.read_csv(spark, path, schema, row_number="n")
        assert back.rdd.getNumPartitions() > 1
        assert [tuple(r) for r in back.orderBy("n").select("n", "a", "b", "c").collect()] == [(i, *r) for i, r in enumerate(rows)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="no column x"):
        files.read_csv(spark, path, T.StructType([T.StructField("x", T.StringType())]))
    named = files.read_csv(spark, path, T.StructType([T.StructField("x", T.StringType())]), names={"x": "b"})
    assert named.filter("x is null").count() == 1000


def test_year_and_edition(spark, planted):
    r = files.convert_raw(planted[0]).orderBy("record_id").first()
    assert r["year"] == 1850.0 and r["edition"] == "e01850s"


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("木 1234\n子 521 x\n\nbad\n", encoding="utf-8")
    got = {tuple(r) for r in dictionaries.read_strokes(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {("木", "1234"), ("子", "521")}
    vecs = spark.createDataFrame([("abc", [1.0, 2.0])], "gram string, vec array<double>")
    dictionaries.write_gram_vectors(vecs, str(tmp_path / "v"))
    assert dictionaries.read_gram_vectors(spark, str(tmp_path / "v")).first()["vec"] == [1.0, 2.0]


def test_validate(spark):
    with pytest.raises(ValueError):
        SPEC.validate(spark.range(1))
    with pytest.raises(ValueError):
        LinkageSpec(block_cols=("nope",))


def test_planted_people_are_found(spark, planted):
    raw, truth = planted
    recs, _ = files.prepare_records(files.convert_raw(raw), SPEC.match_cols, "xing")
    recs = cut(recs)
    values = describe_values(recs, SPEC, vector_size=16)
    featured = cut(pairing.candidate_features(recs, SPEC, values))
    assert featured.filter("left_id = right_id").isEmpty()
    rows = featured.withColumn("pair_id", F.xxhash64("left_id", "right_id"))
    names = spark.createDataFrame(list(truth.items()), "id long, person long")
    labelled = rows.join(names.toDF("left_id", "p"), "left_id").join(names.toDF("right_id", "q"), "right_id")
    labelled = cut(labelled.withColumn("label", (F.col("p") == F.col("q")).cast("int")))
    models = committee.train_committee(labelled.filter("left_id % 2 = 0"), SPEC.feature_names, committee.TreeParams(maxIter=4), 3)
    scored = committee.score_committee(rows, models, SPEC.feature_names)
    found = resolution.resolve(recs, SPEC, scored, restarts=2).collect()
    assert len(found) == len(truth)

    def pairs(groups):
        by = {}
        for i, g in groups.items():
            by.setdefault(g, []).append(i)
        return {p for ids in by.values() for p in combinations(sorted(ids), 2)}

    got, want = pairs({r["record_id"]: r["new_person_id_2"] for r in found}), pairs(truth)
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.9
    ids = {r["new_person_id_2"] for r in found}
    assert ids == set(range(len(ids)))


def test_sizes(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 60, 61)], "n_records long")
    hist = {r["bin"]: r["n_clusters"] for r in summary.size_histogram(sizes).collect()}
    assert hist == {0: 3, 1: 1, 19: 1}
    stats = summary.size_stats(sizes.filter("n_records < 4")).first()
    assert stats["median_size"] == 1.5 and stats["mean_size"] == 1.5


def test_observed(spark):
    df, seen = summary.observed(spark.range(12).filter("id > 1"), "kept")
    df.collect()
    assert seen.get == {"rows": 10}


def test_person_ids(spark):
    base = spark.createDataFrame([(i, i) for i in range(5)], "record_id long, seq int")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "record_id long, cluster long")
    paths = spark.createDataFrame([(1, "1_0"), (2, "1_1_0"), (3, "1_0")], "record_id long, path string")
    got = {r["record_id"]: (r["new_person_id"], r["sub_comm"], r["new_person_id_2"]) for r in summary.person_ids(base, clusters, paths).collect()}
    assert got == {0: (0, None, 0), 1: (1, "0", 1), 2: (1, "1_0", 2), 3: (1, "0", 1), 4: (4, None, 3)}
