"""Values, symbols, grams, dictionaries and vectors."""

import math

import pytest
from pyspark.sql import functions as F

from namesake.functions import text, vectors
from namesake.operators import embed, tokens


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,missing", [("?", True), ("? ?", True), ("??", True), (None, True), ("?a", False), ("？", False), ("", False)])
def test_missing(spark, value, missing):
    assert one(spark, value, text.is_missing) is missing


@pytest.mark.parametrize(
    "value,expected",
    [
        ("（木+子）", ["木子"]),
        ("王（木+子）明", ["王", "木子", "明"]),
        ("（a）b（c+d）", ["a", "b", "（", "c", "+", "d", "）"]),
        ("（a", ["（", "a"]),
        ("", []),
        ("𠀀b", ["𠀀", "b"]),
    ],
)
def test_symbols(spark, value, expected):
    assert one(spark, value, text.symbols) == expected


@pytest.mark.parametrize("letters,expected", [("abcd", ["abc", "bcd"]), ("abc", ["abc"]), ("ab", []), ("", [])])
def test_ngrams(spark, letters, expected):
    assert one(spark, letters, lambda c: text.ngrams(text.chars(c))) == expected


def test_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", "?"), ("a", "b")], "x string, y string")
    keys = [r[0] for r in df.select(text.key_of([F.col("x"), F.col("y")])).collect()]
    assert keys[0] == keys[1] != keys[2]
    strict = [r[0] for r in df.select(text.key_of([F.col("x"), F.col("y")], True)).collect()]
    assert strict[:2] == [None, None] and strict[2]


def test_edition_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([("a", 1, "x"), (None, 1, "x")], "a string, b int, c string")
    assert [r[0] for r in df.select(text.edition_key(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["a1x", None]


def test_cluster_key(spark):
    df = spark.createDataFrame([(5, "1_0"), (6, None)], "c long, s string")
    assert [r[0] for r in df.select(text.cluster_key(F.col("c"), F.col("s"))).collect()] == ["5_1_0", "6"]


@pytest.mark.parametrize("p,expected", [(0.48, 0.6923469670879616), (0.44, 0.6859298002503729)])
def test_vote_entropy(spark, p, expected):
    got = spark.range(1).select(vectors.vote_entropy(F.lit(p))).first()[0]
    assert math.isclose(got, expected, abs_tol=1e-12)


def test_set_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(vectors.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]
    shown = df.select(vectors.repr_chars(F.col("a"))).first()[0]
    assert set(shown) == set("['a' 'b']")


def test_rank_features(spark):
    df = spark.createDataFrame([(0, 7), (3, -1)], "a int, b int")
    diff, lower = vectors.rank_features(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(diff, lower).collect()] == [(3.0, 7.0), (-1.0, -1.0)]


def test_tokens_with_dictionaries(spark):
    values = spark.createDataFrame([("木x",), ("?",), ("（木+?）",), ("",)], "value string")
    strokes = spark.createDataFrame([("木", "12"), ("樹", "3")], "char string, strokes string")
    variants = spark.createDataFrame([("木", "樹")], "char string, standard string")
    phonetic = spark.createDataFrame([("木", "mu")], "char string, syllable string")
    symbols = tokens.symbol_tokens(values, strokes, variants, phonetic)
    found = {r["value"]: (r["shape"], r["phon"]) for r in tokens.value_tokens(values, symbols).collect()}
    assert found["木x"] == ([["*12", "123", "23*"], ["*??", "??*"]], ["mu", "x"])
    assert found["?"] == ([["*?*"]], ["?"])
    assert found["（木+?）"] == ([["*12", "123", "23?", "3?*"]], ["mu", "?"])
    assert found[""] == ([], [])


def test_convert_variants(spark):
    values = spark.createDataFrame([("木ab",), ("",)], "value string")
    variants = spark.createDataFrame([("木", "樹")], "char string, standard string")
    found = {r["value"]: r["standard"] for r in tokens.convert_variants(values, variants).collect()}
    assert found == {"木ab": "樹ab", "": ""}


def test_nested_means(spark):
    """Symbols weigh equally whatever their number of grams; unknown grams take the mean."""
    symbols = spark.createDataFrame([("a", ["g1"]), ("b", ["g2", "g2", "new"])], "symbol string, grams array<string>")
    grams = spark.createDataFrame([("g1", [1.0, 0.0]), ("g2", [0.0, 1.0])], "gram string, vec array<double>")
    vecs = {r["symbol"]: r["vec"] for r in embed.symbol_vectors(symbols, grams).collect()}
    assert vecs["a"] == [1.0, 0.0]
    assert [round(x, 9) for x in vecs["b"]] == [round(0.5 / 3, 9), round(2.5 / 3, 9)]
    values = spark.createDataFrame([("ab",)], "value string")
    got = embed.value_vectors(values, embed.symbol_vectors(symbols, grams)).first()["vec"]
    raw = [(1 + 0.5 / 3) / 2, 2.5 / 6]
    norm = math.hypot(*raw)
    assert all(math.isclose(g, x / norm) for g, x in zip(got, raw))


def test_word2vec_is_repeatable(spark):
    symbols = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"])], "symbol string, grams array<string>")
    a, b = (sorted(map(tuple, embed.train_gram_vectors(symbols, 4).select("gram", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")).collect())) for _ in range(2))
    assert a == b and [g for g, _ in a] == ["x", "y", "z"]


def test_tokens_are_attached_without_gathering_records(spark):
    """Every record keeps its tokens, nulls and repeats included, and none is sorted or grouped with its arrays."""
    rows = [(1, "ab", "c"), (2, None, "ab"), (3, "ab", None), (4, "zz", "c")]
    records = spark.createDataFrame(rows, "record_id long, xing string, ming string")
    found = spark.createDataFrame([("ab", [["x"], ["y"]], ["p"]), ("c", [["z"]], [])], "value string, shape array<array<string>>, phon array<string>")
    out = tokens.attach_tokens(records, found, ("xing", "ming"), "record_id")
    assert out.columns == ["record_id", "xing", "ming", "xing_stroke", "ming_stroke", "xing_pinyin", "ming_pinyin"]
    ab, c = [["x"], ["y"]], [["z"]]
    assert sorted(map(tuple, out.collect())) == [
        (1, "ab", "c", ab, c, ["p"], []), (2, None, "ab", None, ab, None, ["p"]), (3, "ab", None, ab, None, ["p"], None), (4, "zz", "c", None, c, None, []),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
