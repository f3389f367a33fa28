"""The pipeline's stages on a planted corpus, against what each should do."""

import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from namesake.llm import queries  # noqa: E402

NAMES = ["op1_token_counts", "op2_mixing", "op3_attention", "op4_packing", "op5_shards", "op6_quality_rules", "op7_language", "op8_simhash", "op9_order_minhash", "op10_outliers", "op11_conversation_trie", "op12_pieces", "op13_runs"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import numpy as np

    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(900)]
    say = lambda n: ". ".join(" ".join(rng.choice(words, 9)) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(260):
        rows.append((i, say(12 + i % 5), "en", f"s{i % 4}"))
        labels.append((i, 1, 0))
    for i in range(260, 320):
        rows.append((i, " ".join(f"{w.upper()}!! $$$" for w in rng.choice(words, 90)), "en", "s0"))
        labels.append((i, 0, 0))
    # Exact copies of a document, and one with a short text that fails the limits.
    rows += [(400 + k, rows[5][1], "en", "s1") for k in range(20)] + [(500, "too short.", "en", "s2")]
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(a, b, c, d, len(b)) for a, b, c, d in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_stages(spark, corpus):
    docs = corpus_pipeline.documents(spark, corpus)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, corpus))
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen}
    assert not set(ids["quality_classifier"]) & set(range(260, 320)) and set(range(260)) <= set(ids["quality_classifier"])
    assert set(ids["quality_rules"]) == set(ids["quality_classifier"]) - {500}
    assert ids["near_duplicates"] == sorted(set(range(260)))
    assert set(ids["source_mix"]) <= set(ids["near_duplicates"]) and max(map(ids["source_mix"].count, ids["source_mix"])) <= 2
    packed = dict(seen)["packing"]
    assert {r.doc_id for r in packed.collect()} == set(ids["source_mix"])


def test_run_equals_stages(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).columns[:3] == ["doc_id", "start", "length"]


def test_registered():
    assert list(queries.QUERIES) == NAMES and set(queries.ORACLES) <= set(NAMES)
    spec = importlib.util.spec_from_file_location("entry_of_llm", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert {*NAMES, "pipeline"} <= set(entry.queries())


def test_pipeline_survives_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_are_dropped(spark, tmp_path):
    """Of documents at most two fingerprint bits apart one stays, in chains too; all others stay."""
    from .test_similar import slow_components, slow_fingerprint

    words = [f"word{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:2999], "new"])), (4, " ".join(words[:2400] + [f"other{i}" for i in range(600)]))]
    rows += [(10 + i, " ".join(words[i * 40 : i * 40 + 60])) for i in range(20)]
    fps = {t: slow_fingerprint(t) for _, t in rows}
    root = slow_components(list(fps.values()))
    want = sorted({min(d for d, u in rows if root[fps[u]] == root[fps[t]]) for _, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == want
    assert 2 not in want and 3 not in want and 4 in want


def test_odd_rows_go_through_all_stages(spark, odd, odd_rows, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names; each stage also by itself."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, None), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        rows = out.collect()
        if name != "packing":
            assert out.columns == odd.columns and {str(r.doc_id) for r in rows} <= {str(r[0]) for r in odd_rows}
    # Each of them has fewer than 50 words or repeats itself.
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
