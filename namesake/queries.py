"""Queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake import standin
from namesake.functions import text
from namesake.functions.vectors import rank_features as rank_pair
from namesake.functions.vectors import vote_entropy
from namesake.operators import (
    bisect, blocking, committee, communities, components, edges, editions, embed, factor, features, guarantee, metric_tree,
    ordered, sampling, suffix_sets, summary, temporal, tokens,
)
from namesake.plans import labelling, pairing, resolution
from namesake.plans.preparation import describe_values
from namesake.session import cut, scratch
from namesake.sources import candidates, dictionaries
from namesake.sources import records as sources
from namesake.sources.labels import label_cells, label_schema, read_labels, write_to_label
from namesake.standin import NAME_BRAND, SPEC, table

Query = Callable[[SparkSession, str], DataFrame]

# Rules of the stand-in committees.
DOC_RULES = 25
DOC_STEP = 150
# (feature, lower bound) per vote of the pair rules.
PAIR_RULES = (("xing_stroke", 0.9), ("ming_stroke", 0.9), ("ren_xian_stroke", 0.9), ("ren_sheng_stroke", 0.9), ("xing_pinyin", 0.5))
MAX_YEAR_DIFF = 20.0
EDGE_THRESHOLD = 0.8


# --- sources, projections, scalar derivations --------------------------------

def edition_dimension(spark, sf):
    return editions.edition_dimension(standin.records(spark, sf), "edition", "record_id").select(
        "edition", "first_record", "n_records", F.col("edition_seq").cast("long").alias("edition_seq")
    )


def stride_sample_editions(spark, sf):
    dim = editions.edition_dimension(standin.records(spark, sf), "edition", "record_id")
    return editions.stride_sample(dim, 10).select("edition", F.col("edition_seq").cast("long").alias("edition_seq"))


def edition_record_counts(spark, sf):
    return sources.edition_counts(standin.records(spark, sf))


def fractional_year(spark, sf):
    o = table(spark, sf, "orders")
    year = text.fractional_year(F.year("o_orderdate"), F.quarter("o_orderdate"))
    return o.select("o_orderkey", year.alias("frac_year"))


def _part_cells(spark, sf):
    """Parts with quotes, commas and line-like texts in their cells."""
    part = table(spark, sf, "part")
    note = F.concat(F.lit('say "'), "p_name", F.lit('", size '), F.col("p_size").cast("string"), F.lit(','))
    return part.select("p_partkey", note.alias("note"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("brand"), "p_retailprice")


def csv_round_trip(spark, sf):
    """Written in one column order, read in another by heading, numbered in the file's order."""
    path = scratch(spark, "csv")
    cells = _part_cells(spark, sf)
    sources.write_csv(cells.select("p_retailprice", "note", "p_partkey", "brand").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), path)
    return sources.read_csv(spark, path, cells.schema, row_number="line").select("line", *cells.columns)


def edition_files(spark, sf):
    """Records written by edition; three editions read back from their files alone."""
    path = scratch(spark, "records")
    sources.write_records(standin.records(spark, sf), path)
    return sources.read_edition_window(spark, path, 10, 3).select("record_id", "edition", F.col("edition_seq").cast("long").alias("edition_seq"), "year", "xing")


def one_edition(spark, sf):
    """Records written by edition, those of one read back by its label."""
    path = scratch(spark, "records")
    sources.write_records(standin.records(spark, sf), path)
    return sources.read_edition(spark, path, "e7").select("record_id", "edition", F.col("edition_seq").cast("long").alias("edition_seq"), "xing", "ming")


def all_editions(spark, sf):
    """The register from its raw headings: renamed, prepared, numbered, written by edition, all read back."""
    path = scratch(spark, "records")
    part = table(spark, sf, "part")
    cells = part.select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("type"), F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), "p_size")
    named = sources.rename_columns(cells, {"type": "kind", "brand": "maker"}, keep=("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("record_id"), F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("edition"), "kind", "maker"
    )
    kept, _ = sources.prepare_records(named, ("kind", "maker"), "maker")
    sources.write_records(kept, path)
    return sources.read_records(spark, path).select("record_id", "edition", "kind", "maker", F.col("edition_seq").cast("long").alias("edition_seq"))


def dictionary_files(spark, sf):
    """Character tables written as lines of text and read back."""
    folder = scratch(spark, "characters")
    out = None
    for name, frame in zip(("strokes", "standard", "syllable"), standin.dictionaries(spark, sf)):
        # Later fields of a line are not read.
        frame.select(F.concat_ws(" ", "char", name, F.lit("later")).alias("value")).write.text(f"{folder}/{name}")
        found = dictionaries.read_char_table(spark, f"{folder}/{name}", name).select(F.lit(name).alias("kind"), "char", F.col(name).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def rank_features(spark, sf):
    """Distance and minimum of two grades from 0 (read as 10) to 9, -1 where missing."""
    p = table(spark, sf, "part")
    left, right = F.col("p_size") % 12 - 1, F.floor("p_retailprice") % 11 - 1
    gap, least = rank_pair(left.cast("int"), right.cast("int"))
    return p.select("p_partkey", gap.alias("rank_diff"), least.alias("rank_min"))


def json_values(spark, sf):
    path = scratch(spark, "json")
    cells = _part_cells(spark, sf)
    sources.write_json(cells, path)
    return sources.read_json(spark, path, cells.schema)


def label_round_trip(spark, sf):
    """Cells exported for a person, filled in and read back with their labels."""
    folder = scratch(spark, "labels")
    pairs = label_pairs(spark, sf)
    write_to_label(label_cells(pairs), f"{folder}/to_label", files=None)
    shown = read_labels(spark, f"{folder}/to_label", with_scores=False)
    answered = shown.select(*[c for c in shown.columns if c not in ("label", "pair_id")], (F.col("pair_id") % 2).cast("int").alias("oracle"), F.col("pair_id").alias("index"))
    write_to_label(answered.select(*label_schema(False).names), f"{folder}/labelled", files=None)
    return read_labels(spark, f"{folder}/labelled", with_scores=False).select("pair_id", "label", "name", "year")


def edition_key(spark, sf):
    o = table(spark, sf, "orders")
    status = F.nullif("o_orderstatus", F.lit("P"))
    return o.select("o_orderkey", text.edition_key(status, F.year("o_orderdate"), F.quarter("o_orderdate")).alias("edition"))


def missing_mask(spark, sf):
    d = table(spark, sf, "documents")
    value = (
        F.when(F.col("lang") == "fr", "? ?").when(F.col("lang") == "de", "??")
        .when(F.col("source") == "src1", F.lit(None)).when(F.col("source") == "src2", "?").otherwise(F.col("text"))
    )
    d = d.select("doc_id", value.alias("value"))
    return d.select(
        "doc_id",
        text.is_missing(F.col("value")).alias("missing"),
        text.fill_missing(F.col("value")).alias("filled"),
        text.unfill_missing(F.col("value")).alias("unfilled"),
        text.key_of([F.col("value"), F.lit("x")], require_present=True).isNotNull().alias("has_key"),
    )


def ngrams_padded(spark, sf):
    p = table(spark, sf, "part")
    star = F.array(F.lit("*"))
    grams = text.ngrams(F.concat(star, text.chars(F.col("p_name")), star), 3)
    return p.select("p_partkey", F.array_join(grams, "|").alias("grams"))


def bracket_compose(spark, sf):
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    value = F.concat(words[0], F.lit("（"), F.lower("p_type"), F.lit("+"), F.col("p_brand"), F.lit("）"), words[1])
    return p.select("p_partkey", F.array_join(text.symbols(value), "|").alias("symbols"))


def variant_translate(spark, sf):
    r = standin.records(spark, sf)
    _, variants, _ = standin.dictionaries(spark, sf)
    out = tokens.convert_columns(r.select("record_id", "xing", "ming"), ("xing", "ming"), variants, "_standard")
    return out.select("record_id", "xing_standard", "ming_standard")


def shape_and_phonetic_tokens(spark, sf):
    values = cut(tokens.distinct_values(standin.records(spark, sf), ("xing", "ming", "ren_xian")))
    symbols = tokens.symbol_tokens(values, *standin.dictionaries(spark, sf))
    found = tokens.value_tokens(values, symbols)
    shape = F.array_join(F.transform("shape", lambda g: F.array_join(g, "|")), "/")
    return found.select("value", shape.alias("shape"), F.array_join("phon", "|").alias("phon"))


def record_tokens(spark, sf):
    """Token columns attached to the records themselves."""
    r = standin.records(spark, sf)
    cols = ("xing", "ming")
    values = cut(tokens.distinct_values(r, cols))
    found = tokens.value_tokens(values, tokens.symbol_tokens(values))
    out = tokens.attach_tokens(r.select("record_id", *cols), found, cols, "record_id")
    return out.select(
        "record_id",
        F.array_join(tokens.flat_shape(F.col("xing_stroke")), "|").alias("xing_stroke"),
        F.array_join("xing_pinyin", "|").alias("xing_pinyin"),
        F.array_join(tokens.flat_shape(F.col("ming_stroke")), "|").alias("ming_stroke"),
        F.array_join("ming_pinyin", "|").alias("ming_pinyin"),
    )


# --- vectors, candidates, features --------------------------------------------

# Written tables of stages that several queries start from, per session.
STAGES: dict = {}


def _stage(spark, name: str, sf: str, build):
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in STAGES:
        STAGES[key] = build()
    return STAGES[key]


def _values(spark, sf, spec=SPEC):
    r = standin.records(spark, sf)

    def build():
        vecs = cut(standin.gram_vectors(cut(features.feature_values(r, spec))))
        return describe_values(r, spec, vecs)

    return r, _stage(spark, "values", sf, build)


def gram_embedding(spark, sf):
    _, v = _values(spark, sf)
    return v.vectors.select("value", F.posexplode("vec").alias("dim", "x")).select("value", "dim", F.round("x", 6).alias("x"))


def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    vec = embed.unit(F.col("embedding").cast("array<double>"))
    left = e.select(F.col("vec_id").alias("l_item"), F.lit(0).alias("l_seq"), vec.alias("l_vec"))
    right = e.select(F.col("vec_id").alias("r_item"), F.lit(0).alias("r_seq"), F.col("vec_id").alias("r_tie"), vec.alias("r_vec"))
    found = metric_tree.tree_join(left, right, 10)
    return found.select(F.col("l_item").alias("left_id"), F.col("r_item").alias("right_id"), F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def jaccard_topk(spark, sf):
    r, v = _values(spark, sf)
    found = blocking.neighbours(r, SPEC, v.block_tokens, "jaccard")
    return found.select("left_id", "right_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def token_jaccard_documents(spark, sf):
    """The five documents closest to each benchmark item, by whole word sets."""
    def words(df, key):
        split = F.array_remove(F.split("text", "[ \n]+"), "")
        return df.select(F.col(key), F.sort_array(F.array_distinct(split)).alias("vec"))

    items = cut(words(table(spark, sf, "benchmark"), "item_id"))
    docs = words(table(spark, sf, "documents"), "doc_id")
    left = items.select(F.col("item_id").alias("l_item"), F.lit(0).alias("l_seq"), F.col("vec").alias("l_vec"))
    right = docs.select(F.col("doc_id").alias("r_item"), F.lit(0).alias("r_seq"), F.col("doc_id").alias("r_tie"), F.col("vec").alias("r_vec"))
    found = suffix_sets.set_join(left, right, 5)
    return found.select(F.col("l_item").alias("item_id"), F.col("r_item").alias("doc_id"), F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def band_window_counts(spark, sf):
    r = standin.records(spark, sf)
    found = editions.window_sizes(r, "edition_seq", SPEC.window, ("ren_xian",))
    return found.select("ren_xian", "l_seq", "n", "n_window")


def guaranteed_pair_counts(spark, sf):
    """Exact-key partners of every record inside its window."""
    r = standin.records(spark, sf)
    key = text.key_of([F.col(c) for c in NAME_BRAND.guarantee_cols])
    keyed = r.select("record_id", F.col("edition_seq").alias("l_seq"), key.alias("gkey"))
    sizes = editions.window_sizes(keyed, "l_seq", NAME_BRAND.window, ("gkey",))
    return keyed.join(sizes, ["gkey", "l_seq"]).select("record_id", (F.col("n_window") - 1).alias("n_guaranteed"))


def blocked_candidates(spark, sf):
    r, v = _values(spark, sf)
    return blocking.block(r, SPEC, v.block_vectors, v.block_tokens)


def blocked_candidates_unbuffered(spark, sf):
    spec = replace(SPEC, buffered=False)
    r, v = _values(spark, sf, spec)
    return blocking.block(r, spec, v.block_vectors, v.block_tokens)


def _featured(spark, sf):
    r, v = _values(spark, sf)
    return r, _stage(spark, "features", sf, lambda: cut(pairing.candidate_features(r, SPEC, v)))


def pair_features(spark, sf):
    _, f = _featured(spark, sf)
    return f.select("left_id", "right_id", *[F.round(c, 6).alias(c) for c in SPEC.feature_names])


def candidate_files(spark, sf):
    """Candidates with their features by left edition: a run that stops half way, leaves a torn folder, and is resumed."""
    path = scratch(spark, "candidates")
    r, f = _featured(spark, sf)
    seqs = r.select(F.col("record_id").alias("left_id"), F.col("edition_seq").alias("left_seq"))
    editions_ = [row[0] for row in seqs.select("left_seq").distinct().orderBy("left_seq").collect()]
    asked = []

    def make(some):
        asked.append(some)
        if len(asked) == 2:
            # What a killed job leaves: rows of an edition that has no marker.
            f.limit(3).withColumn("left_seq", F.lit(some[0])).write.mode("append").partitionBy("left_seq").parquet(f"{path}/candidates")
            raise InterruptedError("stopped")
        return f.join(seqs.filter(F.col("left_seq").isin(some)), "left_id")

    try:
        candidates.write_candidates(spark, path, editions_, make, at_once=20)
    except InterruptedError:
        candidates.write_candidates(spark, path, editions_, make, at_once=20)
    found = candidates.read_candidates(spark, path)
    return found.select("left_id", "right_id", F.col("left_seq").cast("long").alias("left_seq"), F.round("ming_stroke", 6).alias("ming_stroke"))


def labelled_pairs(spark, sf):
    """Label rows joined with the features of their pairs; answers still open don't count."""
    _, f = _featured(spark, sf)
    pool = f.select((F.col("left_id") * 100_000 + F.col("right_id")).alias("pair_id"), "ming_stroke", "same_year")
    labels = pool.select("pair_id", F.when(F.col("pair_id") % 3 > 0, F.col("pair_id") % 2).cast("int").alias("label"))
    rows = labelling.training_rows(pool, labels, ["ming_stroke", "same_year"])
    return rows.select("pair_id", F.round("ming_stroke", 6).alias("ming_stroke"), F.col("same_year").cast("long").alias("same_year"), "label")


def training_pool(spark, sf):
    r, v = _values(spark, sf)
    dim = r.select("edition_seq").distinct()
    pool = pairing.training_pool(r, dim, SPEC, v, n_editions=10)
    return pool.select("pair_id", "left_id", "right_id", F.round("ming_stroke", 6).alias("ming_stroke"), F.round("ming_sim1", 6).alias("ming_sim1"))


# --- committees and active learning -------------------------------------------

def _document_votes(spark, sf):
    d = table(spark, sf, "documents")
    votes = [(F.col("n_chars") >= DOC_STEP * (b + 1)).cast("int") for b in range(DOC_RULES)]
    return d.select("doc_id", committee.vote_share(votes).alias("predicted"))


def vote_mean_entropy(spark, sf):
    scored = _document_votes(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return scored.select(
        "doc_id", "quality", F.round("predicted", 6).alias("predicted"), F.round(vote_entropy(F.col("predicted")), 6).alias("uncertainty")
    )


def uncertain_topk_antijoin(spark, sf):
    found = sampling.uncertain_pool(_document_votes(spark, sf), table(spark, sf, "labels"), 100, "doc_id")
    return found.select("doc_id", F.round("predicted", 6).alias("predicted"), F.round("uncertainty", 6).alias("uncertainty"))


def random_sample(spark, sf):
    return sampling.random_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


def bootstrap_draws(spark, sf):
    return sampling.bootstrap_counts(table(spark, sf, "labels"), "doc_id", 5).select(
        F.col("member").cast("long").alias("member"), "doc_id", F.col("times").cast("long").alias("times")
    )


def class_weights(spark, sf):
    return committee.class_counts(table(spark, sf, "labels"), "quality").select(
        "n_pos", "n_neg", F.round("pos_weight", 6).alias("pos_weight")
    )


DOC_FEATURES = ["n_chars", "n_words", "n_lines", "n_distinct", "n_digits"]


def _document_features(spark, sf):
    d = table(spark, sf, "documents")
    words = F.array_remove(F.split("text", "[ \n]+"), "")
    return d.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("double").alias("n_distinct"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("double").alias("n_digits"),
    )


def standardise_features(spark, sf):
    scaled = sampling.standardise(_document_features(spark, sf), DOC_FEATURES)
    return scaled.select("doc_id", *[F.round(c, 6).alias(c) for c in DOC_FEATURES])


def _labelled_documents(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return cut(_document_features(spark, sf).join(labels, "doc_id"))


def committee_fit_score(spark, sf):
    labelled = _labelled_documents(spark, sf)
    models = committee.train_committee(labelled, DOC_FEATURES, committee.TreeParams(maxIter=10), 3, key="doc_id")
    return committee.score_committee(_document_features(spark, sf), models, DOC_FEATURES).select("doc_id", "prob", "predicted")


def kmeans_diverse(spark, sf):
    pool = cut(_document_features(spark, sf))
    return sampling.diverse_sample(pool, DOC_FEATURES, 20, key="doc_id")


def k_centre_fill(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return sampling.k_centre_fill(e, first, 12, "vec_id")


def word2vec_grams(spark, sf):
    values = cut(tokens.distinct_values(standin.records(spark, sf), SPEC.match_cols))
    symbols = cut(tokens.symbol_tokens(values, *standin.dictionaries(spark, sf)))
    return embed.train_gram_vectors(symbols, size=16)


def factor_grams(spark, sf):
    """Gram vectors by factorisation, learnt from the symbols of all values as sentences."""
    values = cut(tokens.distinct_values(standin.records(spark, sf), SPEC.match_cols))
    symbols = cut(tokens.symbol_tokens(values, *standin.dictionaries(spark, sf)))
    return factor.factor_gram_vectors(symbols, size=16)


def next_label_round(spark, sf):
    """Train on labelled documents, then pick ten diverse undecided ones."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label"))
    pool = cut(_document_features(spark, sf).withColumnRenamed("doc_id", "pair_id"))
    return labelling.next_round(pool, labels, DOC_FEATURES, 1, n=10, pool_size=200, size=3, params=committee.TreeParams(maxIter=5)).select(
        "pair_id", "predicted", "uncertainty"
    )


def label_pairs(spark, sf):
    """Every record with its next record of the same name and brand."""
    r = standin.records(spark, sf)
    nxt = ordered.with_next(r.select("record_id", "edition_seq", "xing", "ming", "ren_xian"), ["xing", "ming", "ren_xian"], ["edition_seq", "record_id"], ["record_id"])
    pairs = nxt.filter("next_record_id is not null").select(F.col("record_id").alias("left_id"), F.col("next_record_id").alias("right_id"))
    a = r.select(F.col("record_id").alias("left_id"), *[F.col(c).alias(f"1_{c}") for c in ("year", *SPEC.match_cols)])
    b = r.select(F.col("record_id").alias("right_id"), *[F.col(c).alias(f"2_{c}") for c in ("year", *SPEC.match_cols)])
    return pairs.join(a, "left_id").join(b, "right_id").withColumn("pair_id", F.col("left_id"))


def label_cell_text(spark, sf):
    return label_cells(label_pairs(spark, sf)).select("name", "jigou", "rensheng&xian", "year", F.col("index").alias("pair_id"))


# --- graph, clusters, ids ------------------------------------------------------

def _scored(spark, sf):
    r, f = _featured(spark, sf)
    votes = [(F.round(c, 6) >= bound).cast("int") for c, bound in PAIR_RULES]
    return r, cut(f.select("left_id", "right_id", F.round(committee.vote_share(votes), 6).alias("prob")))


def edge_dedup(spark, sf):
    _, scored = _scored(spark, sf)
    return edges.model_edges(scored, EDGE_THRESHOLD)


def guaranteed_edges_year_bound(spark, sf):
    t = guarantee.guarantee_table(standin.records(spark, sf), NAME_BRAND)
    return guarantee.guarantee_degrees(t, MAX_YEAR_DIFF)


def _graph(spark, sf, spec=NAME_BRAND):
    """Model edges and exact-key matches of the stand-in task."""
    r, scored = _scored(spark, sf)
    found = cut(edges.model_edges(scored, EDGE_THRESHOLD))
    t = cut(guarantee.guarantee_table(r, spec))
    everything = edges.union_edges(found, guarantee.guarantee_links(t, MAX_YEAR_DIFF))
    clusters = cut(components.connected_components(everything, r.select("record_id")))
    return r, found, t, clusters


def connected_components(spark, sf):
    return _graph(spark, sf)[3]


def induced_edges(spark, sf):
    """Model edges inside one edition-and-brand group."""
    r, scored = _scored(spark, sf)
    found = edges.model_edges(scored, EDGE_THRESHOLD)
    groups = r.select("record_id", F.concat_ws("_", "edition", "ren_xian").alias("grp"))
    return edges.induced(found, groups, "grp").select("src", "dst", "grp")


def strange_ratio(spark, sf):
    r, found, t, clusters = _graph(spark, sf)
    members = cut(resolution.temporal_members(r, t, clusters, NAME_BRAND))
    return temporal.break_counts(members, found, "cluster", MAX_YEAR_DIFF).select(
        "cluster", "n_rows", "breaks", F.round("ratio", 6).alias("ratio"), temporal.is_leaf(NAME_BRAND).alias("leaf")
    )


def person_ids_dense(spark, sf):
    return resolution.resolve(standin.records(spark, sf), NAME_BRAND).select(
        "record_id", "new_person_id", F.col("new_person_id_2").cast("long").alias("new_person_id_2")
    )


def _name_sizes(spark, sf):
    return summary.cluster_sizes(standin.records(spark, sf), "xing", "edition"), summary.cluster_sizes(
        standin.records(spark, sf).withColumn("name", F.concat_ws(" ", "xing", "ming")), "name", "edition"
    )


def cluster_size_stats(spark, sf):
    _, sizes = _name_sizes(spark, sf)
    rows = [
        summary.size_stats(sizes, c).select(
            F.lit(c).alias("counted"), "n_clusters", *[F.round(x, 6).alias(x) for x in ("mean_size", "std_size", "median_size")]
        )
        for c in ("n_records", "n_editions")
    ]
    return reduce(DataFrame.unionByName, rows)


def cluster_size_histogram(spark, sf):
    _, sizes = _name_sizes(spark, sf)
    return summary.size_histogram(sizes).select(F.col("bin").cast("long").alias("bin"), "n_clusters")


def split_clusters(spark, sf):
    """Clusters of equal given name, cut where model edges are thin."""
    r, scored = _scored(spark, sf)
    found = cut(edges.model_edges(scored, EDGE_THRESHOLD))
    clusters = cut(components.connected_components(found, r.select("record_id")))
    none = r.select("record_id", F.lit(None).cast("string").alias("gkey"))
    members = cut(resolution.temporal_members(r, none, clusters, SPEC))
    return bisect.split_clusters(members, found, SPEC, restarts=2)


def split_name_groups(spark, sf):
    """Groups of one name, all pairs within the year bound kept in grouped form."""
    r = standin.records(spark, sf)
    t = cut(guarantee.guarantee_table(r, NAME_BRAND))
    clusters = r.join(r.groupBy("xing", "ming").agg(F.min("record_id").alias("cluster")), ["xing", "ming"]).select("record_id", "cluster")
    members = cut(resolution.temporal_members(r, t, clusters, NAME_BRAND))
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    return bisect.split_clusters(members, empty, NAME_BRAND, restarts=2)


def community_moves(spark, sf):
    """Communities of the weighted model edges, and whether any record would raise its cluster's modularity by moving."""
    r, scored = _scored(spark, sf)
    found = cut(edges.model_edges(scored, EDGE_THRESHOLD))
    clusters = cut(components.connected_components(found, r.select("record_id")))
    parts = cut(communities.communities(clusters.select("record_id", F.col("cluster").alias("path")), found))
    return communities.moves_left(parts, found).select(
        "record_id", F.col("path").alias("cluster"), F.round("degree", 6).alias("degree"), (F.col("gain") > 1e-8).alias("gains")
    )


def resolve_entities(spark, sf):
    """Flagship: exact keys, components, break test, ids, statistics."""
    found = cut(resolution.resolve(standin.records(spark, sf), NAME_BRAND))
    out = resolution.compare(found)
    return out.select(
        "ids", "counted", "n_clusters", *[F.round(x, 6).alias(x) for x in ("mean_size", "std_size", "median_size")]
    )


def linkage_with_committee(spark, sf):
    """Everything: learnt vectors, blocking, committee, edges, clusters, ids."""
    r = standin.records(spark, sf)
    values = describe_values(r, SPEC, vector_size=16)
    pairs = cut(ordered.dense_index(pairing.candidate_features(r, SPEC, values), ["left_id", "right_id"], "pair_id"))
    votes = [(F.col(c) >= bound).cast("int") for c, bound in PAIR_RULES]
    labels = sampling.random_sample(pairs, "pair_id", 200).select("pair_id", (committee.vote_share(votes) >= EDGE_THRESHOLD).cast("int").alias("label"))
    rows = labelling.training_rows(pairs, cut(labels), SPEC.feature_names)
    models = committee.train_committee(rows, SPEC.feature_names, committee.TreeParams(maxIter=5), 3)
    scored = committee.score_committee(pairs, models, SPEC.feature_names)
    return resolution.resolve(r, SPEC, scored, restarts=1)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        edition_dimension, stride_sample_editions, edition_record_counts, fractional_year, csv_round_trip,
        edition_files, one_edition, all_editions, dictionary_files, json_values, label_round_trip, rank_features, candidate_files, labelled_pairs, edition_key, missing_mask,
        ngrams_padded, bracket_compose, variant_translate, shape_and_phonetic_tokens, record_tokens, gram_embedding,
        cosine_topk, jaccard_topk, token_jaccard_documents, band_window_counts, guaranteed_pair_counts,
        blocked_candidates, blocked_candidates_unbuffered, pair_features, training_pool, vote_mean_entropy,
        uncertain_topk_antijoin, random_sample, bootstrap_draws, class_weights, standardise_features,
        committee_fit_score, kmeans_diverse, k_centre_fill, word2vec_grams, factor_grams, next_label_round, label_cell_text,
        edge_dedup, guaranteed_edges_year_bound, connected_components, induced_edges, strange_ratio, person_ids_dense,
        cluster_size_stats, cluster_size_histogram, split_clusters, split_name_groups, community_moves, resolve_entities,
        linkage_with_committee,
    )
}
