"""The mix against a brute-force version and SQL."""

import hashlib
import os
import re

import pytest

from namesake.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def brute(rows, weights=(5, 2, 1), budget=1.5, most=2):
    """taken by (doc_id, size): resharing the excess round after round."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held = {}
    for doc, text, source in rows:
        held.setdefault(source, []).append((hashlib.md5(str("" if doc is None else doc).encode()).hexdigest(), -1 if doc is None else doc, size(text)))
    order = sorted((s for s in held if s is not None)) + [None] * (None in held)
    total = {s: sum(x[2] for x in held[s]) for s in order}
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, budget * sum(total.values()), set(order)
    while open_:
        share = {s: left * weigh[s] / sum(weigh[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in order:
        at = 0
        for _, doc, n in sorted(held[s]):
            got = sum(max(0, min(n, int(target[s] + 1e-9) - at - r * total[s])) for r in range(most))
            out.append((doc, n, got, round(target[s], 6)))
            at += n
    return sorted(out)


def test_taken(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.taken, round(r.target, 6)) for r in got) == brute([(r[0], r[1], r[3]) for r in odd_rows])
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).collect() == []


def test_many_sources(spark):
    rows = [(i, "w " * (i * 7919 % 50), f"s{i % 11}" if i % 13 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size, r.taken, round(r.target, 6)) for r in got) == brute(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


@pytest.mark.parametrize("k", range(3))
def test_position_inverts_the_integral(spark, k):
    knots = mixing.SCHEDULES[k]

    def integral(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            x = min(max(t - a, 0), b - a)
            total += u * x + (v - u) / (b - a) * x * x / 2
        return total

    from pyspark.sql import functions as F

    shares = spark.range(101).select((F.col("id") / 100).alias("share"))
    rows = shares.select("share", mixing.training_position(F.col("share"), F.lit(k)).alias("t")).collect()
    assert all(abs(integral(r.t) - r.share * integral(1.0)) < 1e-9 for r in rows)
    assert [r.t for r in rows] == sorted(r.t for r in rows)


def test_training_order(odd, odd_rows, none):
    got = mixing.training_order(odd)
    assert got.columns == odd.columns
    sizes = {(r.doc_id, r.text) for r in got.collect()}
    assert sizes <= {(r[0], r[1]) for r in odd_rows} and all(t and t.strip() for _, t in sizes)
    assert mixing.training_order(none).collect() == []


def test_training_order_holds_the_words_taken(spark, odd):
    """With ``cut_last`` every source has the words that the mix takes, whole texts but for one each."""
    rows = [(i, " \n".join(f" w{i}x{j}" for j in range(1 + i * 7 % 23)) + "  ", f"s{i % 3}", i) for i in range(60)]
    rows += [(100, " ".join(f"long{j}" for j in range(5000)), "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    texts = {r[0]: r[1] for r in rows}
    got, partial = {}, {}
    for r in mixing.training_order(docs, cut_last=True).collect():
        n = len(r.text.split())
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        if r.text == texts[r.doc_id]:
            continue
        assert texts[r.doc_id].startswith(r.text) and texts[r.doc_id].split()[:n] == r.text.split() and r.n_chars == len(r.text)
        partial[r.source] = partial.get(r.source, 0) + 1
    assert got == {d: t for d, t in taken.items() if t} and all(n == 1 for n in partial.values()) and partial
    assert mixing.training_order(odd, cut_last=True).columns == odd.columns


@pytest.fixture(scope="module")
def some(spark):
    rows = [(i, " \n".join(f" w{i}x{j}" for j in range(1 + i * 7 % 23)) + "  ", f"s{i % 3}" if i % 5 else None) for i in range(80)]
    rows += [(100, " ".join(f"long{j}" for j in range(3000)), "one"), (7, "same id " * 9, "s1"), (7, "like size " * 9, "s1"), (8, "", "s1"), (9, None, "s2")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("slots, sent", [(1, 0), (7, 300_000), (256, 300_000)])
def test_texts_are_delivered_in_training_order(some, none, monkeypatch, slots, sent):
    """Every reading has its text, the last of a source up to the last word taken, sorted by when it is due."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "SENT_ROWS", sent)
    rows, docs = some
    got = mixing.deliver(docs).collect()
    assert [r.due for r in got] == sorted(r.due for r in got)
    assert all(len(r.text.split()) == r.words > 0 for r in got)
    held = {}
    for d, t, s in rows:
        held.setdefault((s, d), []).append(t or "")
    assert all(any(t == r.text or t.startswith(r.text) and r.words < len(t.split()) for t in held[r.source, r.doc_id]) for r in got)
    taken = {}
    for r in got:
        taken[r.source, r.start, r.doc_id] = taken.get((r.source, r.start, r.doc_id), 0) + r.words
    brute_taken = sorted((doc, n) for doc, _, n, _ in brute(rows) if n)
    assert sorted((k[2], n) for k, n in taken.items()) == brute_taken
    # Of a document read twice both readings have the same text, or the second a part of it.
    first = {(r.source, r.start): r.text for r in got if r.reading == 0}
    assert all(first[r.source, r.start].startswith(r.text) for r in got if r.reading)
    planned = sorted((r.doc_id, p) for r in mixing.plan(docs).collect() for p in r.positions)
    assert sorted((r.doc_id, r.due) for r in got) == planned
    assert mixing.deliver(none).collect() == []


def test_mix_tells_what_was_delivered(some, monkeypatch):
    """Words taken are those of the texts read out, not only planned."""
    rows, docs = some
    planned = {(r.doc_id, r.size, r.taken) for r in mixing.plan(docs).collect()}
    assert {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()} == planned
    whole = mixing.first_words
    monkeypatch.setattr(mixing, "first_words", lambda text, n: whole(text, n - 1))
    less = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()} - planned
    assert 0 < len(less) <= 5 and all((d, n, t + 1) in planned for d, n, t in less)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op2_mixing"])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES["op2_mixing"](spark, SF).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def test_native(spark, odd):
    """No Python stands in the plan."""
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
