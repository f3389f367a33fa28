"""Quality rules, quality classifier, language identification."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.llm import langid, outliers, quality, stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(odd, odd_rows, none):
    got = outliers.judge(odd).collect()
    want = []
    for r in odd_rows:
        c = counts(r[1])
        want.append((r[0] or 0, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert outliers.judge(none).collect() == []


def test_repeated_windows(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in range(0, 60)] + ["a " * 500, "a b c " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", stats.words_of(F.col("t")))
    got = {r.t: r.n for r in stats.with_repeated_window_words(df, "w", "n").collect()}
    assert all(got[t] == counts(t)[4] for t in texts)


def planted(spark):
    """Two groups of ordinary vectors, of which a tenth lie far off, and a small group."""
    rng = np.random.default_rng(2)
    rows = []
    for lang, source, centre, n in (("en", "a", 1.6, 2000), ("de", "b", 1.9, 500), ("fr", "c", 1.7, 30)):
        x = rng.multivariate_normal([centre, 0.2, 0.3, 0.4], np.diag([0.02, 0.01, 0.01, 0.01]) + 0.004, n)
        x[: n // 10] += [1.5, 3.0, 0, 0]
        rows += [(lang, source, i < n // 10, False, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "_lang string, _source string, odd boolean, base_failed boolean, _x0 double, _x1 double, _x2 double, _x3 double"), rows


def test_minimum_covariance_determinant(spark):
    table, rows = planted(spark)
    grouped = outliers.grouped(table).cache()
    assert {r._group for r in grouped.select("_group").distinct().collect()} == {'["en","a"]', '["de","b"]', "*"}
    est = outliers.robust_estimates(grouped.select("_group", *outliers.VECTOR))
    assert {r._group for r in est.select("_group").collect()} == {'["en","a"]', '["de","b"]'}
    judged = outliers._with_distance(grouped, est).collect()
    for r in judged:
        if r._source == "c":
            assert r._d is None
        elif r.odd:
            assert r._d > outliers.MOST_DISTANCE
    assert np.mean([r._d > outliers.MOST_DISTANCE for r in judged if not r.odd and r._d is not None]) < 0.002
    # The same steps in numpy.
    x = np.array([r[4:] for r in rows if r[1] == "a"])
    floor = np.diag(np.square(outliers.FLOORS))
    mean = np.median(x, axis=0)
    cov = np.diag((np.median(abs(x - mean), axis=0) * 1.4826) ** 2) + floor
    for _ in range(30):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d <= np.quantile(d, 0.75)]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.CONSISTENCY + floor
    got = est.filter("_group = '[\"en\",\"a\"]'").first()
    assert all(math.isclose(got[f"m{i}"], mean[i], abs_tol=0.01) for i in range(4))
    assert math.isclose(got.logdet, np.linalg.slogdet(cov)[1], abs_tol=0.05)


def test_repetition_alone_rejects(spark):
    """In a clean group 40% of repeated lines or words reject, each alone too; clean texts stay."""
    rng = np.random.default_rng(8)
    fresh = iter(rng.permutation(200_000))
    line = lambda: " ".join(f"w{next(fresh):06d}" for _ in range(2))
    rows = [(i, "\n".join(line() for _ in range(50))) for i in range(200)]
    # Lines of two words, four of ten equal: every repeat of a line stands between others, so that no window of three repeats.
    own = [line() for _ in range(30)]
    rows.append((1000, "\n".join([*own[:10], *[x for i in range(20) for x in (own[i % 10], own[10 + i])]])))
    # Forty of a hundred words in windows that come twice, on lines of their own.
    w = [f"v{i}" for i in range(80)]
    rows.append((1001, "\n".join([" ".join(w[:20]), " ".join(w[20:50]), " ".join(w[:20]) + " " + " ".join(w[50:80])])))
    # Both: a block of ten lines comes twice, 20% of the lines and 40% of the words.
    block = [line() for _ in range(20)]
    rows.append((1002, "\n".join([*block[:10], *[line() for _ in range(15)], *block[:10], *[line() for _ in range(15)]])))
    docs = spark.createDataFrame([(a, b, "en", "s") for a, b in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert (got[1000].n_dup_lines, got[1000].n_repeat_words) == (20, 0) and got[1001].n_dup_lines == 0 and got[1001].n_repeat_words == 40
    assert (got[1002].n_dup_lines, got[1002].n_repeat_words) == (10, 40)
    assert all(got[i].kept for i in range(200)) and not any(got[i].kept for i in (1000, 1001, 1002))


def test_kept_documents(odd, none):
    got = outliers.kept_documents(odd)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} <= {1, 5, 8}
    assert outliers.kept_documents(none).collect() == []


def test_native(odd):
    text = outliers.measured(odd, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, f"A plain sentence number {i} that says one thing and then says another thing in turn. " * (1 + i % 3), 1) for i in range(300)]
    bad = [(i, f"BUY!! NOW!! item {i}!! $$$ ### " * (2 + i % 4), 0) for i in range(300, 420)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_rules(spark, labelled, odd, none):
    docs, labels = labelled
    model = quality.train(docs, labels)
    assert 0 < len(model.weights) < 40
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all((got[r.doc_id].predicted == r.quality) for r in labels.collect())
    # The compiled expression against the rules, one by one.
    table = quality.with_statistics(docs.select("doc_id", "text"), "text").collect()
    for r in table[::17]:
        total = model.intercept
        for rule, w in model.weights.items():
            total += w * all(r[n] <= v if up else r[n] > v for n, up, v in rule)
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-total)), rel_tol=1e-12)
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(none, model).collect() == []
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()
    assert quality.accepted(docs, labels).columns == docs.columns


def test_one_kind_of_label(spark, labelled):
    docs, labels = labelled
    only = quality.train(docs, labels.filter("quality = 1"))
    assert only.weights == {} and quality.score(docs, only).first().score > 0.9
    assert quality.train(docs, labels.limit(0)) == quality.RuleModel(0.0, {})


def test_tidy():
    assert quality.tidy([("a", True, 2.0), ("a", True, 1.0), ("a", False, 0.5)]) == (("a", False, 0.5), ("a", True, 1.0))


def brute_word(word, names, column):
    """Sum over all segmentations by recursion."""
    word = "▁" + word
    chance = dict(zip(names, column))
    memo = {len(word): 1.0}
    for i in range(len(word) - 1, -1, -1):
        total = 0.0
        for j in range(i + 1, min(len(word), i + langid.WIDEST) + 1):
            p = chance.get(word[i:j])
            if p is None and j == i + 1:
                p = column[-1]
            total += (p or 0.0) * memo[j]
        memo[i] = total
    return math.log(memo[0])


def test_forward():
    names = sorted(["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc"])
    rng = np.random.default_rng(3)
    table = rng.random((len(names) + 1, 2))
    table[-1] = langid.UNKNOWN
    words = ["a", "abc", "abcabc", "xyz", "bca" * 20, "é"]
    got = langid.log_probabilities(words, langid.Pieces(names), table)
    for w, row in zip(words, got):
        assert all(math.isclose(row[k], brute_word(w, names, table[:, k]), rel_tol=1e-9) for k in range(2))


def test_expected_counts():
    """Expected uses of a piece are the derivative of the log probability by its logarithm."""
    names = sorted(["▁", "▁a", "a", "b", "ab", "ba"])
    pieces = langid.Pieces(names)
    table = np.random.default_rng(4).random((len(names) + 1, 1))
    got = langid.expected_counts(["abab", "bb"], np.zeros(2, np.int64), np.array([3, 2]), pieces, table, 1)[0]
    f = lambda t: float(langid.log_probabilities(["abab", "bb"], pieces, t)[:, 0] @ [3, 2])
    for i in range(len(names)):
        moved = table.copy()
        moved[i] *= 1 + 1e-6
        assert math.isclose(got[i], (f(moved) - f(table)) / 1e-6, rel_tol=1e-3, abs_tol=1e-4)


def test_languages(spark, odd, none):
    en, de = "the quick brown fox and the lazy dog", "der schnelle braune fuchs und der faule hund"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train_and_identify(docs).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") and 0.5 < r.score <= 1 for r in got)
    odd_got = {(r.doc_id, r.lang_pred) for r in langid.train_and_identify(odd).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (9, "und")} <= odd_got and len(odd_got) == odd.select("doc_id").distinct().count()
    assert langid.train_and_identify(none).collect() == []
    assert {r.lang_pred for r in langid.train_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
