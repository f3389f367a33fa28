"""Registered queries against their SQL on the smallest driver tables."""

import importlib
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
entry = importlib.import_module("__spark_entry__")

# The blocking queries are compared with brute force in test_blocking.
LIGHT = [
    "edition_dimension", "stride_sample_editions", "edition_record_counts", "fractional_year", "edition_key", "missing_mask",
    "csv_round_trip", "edition_files", "json_values", "label_round_trip", "one_edition", "all_editions", "dictionary_files", "rank_features",
    "ngrams_padded", "bracket_compose", "variant_translate", "shape_and_phonetic_tokens", "record_tokens", "gram_embedding",
    "token_jaccard_documents", "band_window_counts", "guaranteed_pair_counts", "vote_mean_entropy",
    "uncertain_topk_antijoin", "random_sample", "bootstrap_draws", "class_weights", "standardise_features",
    "label_cell_text", "guaranteed_edges_year_bound", "person_ids_dense", "cluster_size_stats", "cluster_size_histogram",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, con, name):
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), columns)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
