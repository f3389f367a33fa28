"""The language model: gradients, normalisation, windows, counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from namesake.llm import attention, lmscore


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    size = 60
    counts = rng.integers(1, 50, size).astype(float)
    begins = rng.random(size) < 0.4
    begins[2] = True
    inv = attention.inventory(counts, begins, rng.integers(0, 5, size), [2], active=40)
    prev, nxt = rng.integers(0, inv.rows, 500), rng.integers(0, inv.outcomes, 500)
    tables = attention.tables_from_counts(prev, nxt, np.ones(500), 5.0, inv, steps=3, k=6)
    params = attention.fresh(tables, inv)
    params["out"] = rng.normal(0, 0.5, params["out"].shape).astype(np.float32)
    return inv, tables, params


def test_probabilities_sum_to_one(small):
    inv, tables, params = small
    model = attention.Model(params, tables["near"], inv)
    head = np.array([5, 9, 17, 30, 2, 8, 11], np.int32)
    for n in (0, 1, 4, 7):
        total = 0.0
        for nxt in range(60):
            ids = np.append(head[:n], nxt).astype(np.int32)
            w = attention.windows(ids, np.array([len(ids)]), inv, start=True)
            total += math.exp(model.log_scores(w)[w.targets >= 0][-1])
        assert abs(total - 1) < 1e-3


def test_windows_score_each_id_once(small):
    inv, tables, params = small
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 15, 16, 17, 100])
    flat = rng.integers(0, 60, sizes.sum()).astype(np.int32)
    w = attention.windows(flat, sizes, inv, start=True)
    assert [int((w.targets[w.text == t] >= 0).sum()) for t in range(6)] == sizes.tolist()
    assert w.targets[w.targets >= 0].tolist() == flat.tolist()
    assert int((attention.windows(flat, sizes, inv, start=False).targets >= 0).sum()) == sum(max(0, n - 1) for n in sizes)
    # A text's score doesn't depend on its neighbours in the batch.
    model = attention.Model(params, tables["near"], inv)
    whole = np.bincount(w.text, model.log_scores(w).sum(axis=1), 6)
    for t in range(6):
        part = flat[sizes[:t].sum() : sizes[: t + 1].sum()]
        alone = attention.windows(part, np.array([len(part)]), inv, start=True)
        assert math.isclose(model.log_scores(alone).sum(), whole[t], rel_tol=1e-4, abs_tol=1e-6)


def test_causal(small):
    """Later ids don't change earlier scores."""
    inv, tables, params = small
    model = attention.Model(params, tables["near"], inv)
    ids = np.random.default_rng(2).integers(0, 60, 50).astype(np.int32)
    other = ids.copy()
    other[30:] = (other[30:] + 7) % 60
    scores = []
    for x in (ids, other):
        w = attention.windows(x, np.array([50]), inv, start=True)
        scores.append(model.log_scores(w)[w.targets >= 0][:30])
    assert np.allclose(*scores)


def test_gradients(small):
    inv, tables, params = small
    near = tables["near"].astype(np.float64)
    exact = {n: x.astype(np.float64) for n, x in params.items()}
    rng = np.random.default_rng(3)
    w = attention.windows(rng.integers(0, 60, 80).astype(np.int32), np.array([50, 30]), inv, start=False)
    model = attention.Model(exact, near, inv)
    _, d = model.gradients(w)
    for name in params:
        flat = exact[name].reshape(-1)
        strongest = np.argsort(-abs(d[name].reshape(-1)))[:3]
        for i in strongest:
            old, ends = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = old + step
                model.prepare()
                ends.append(model.gradients(w)[0])
            flat[i] = old
            model.prepare()
            assert math.isclose((ends[0] - ends[1]) / 2e-3, d[name].reshape(-1)[i], rel_tol=0.05, abs_tol=2e-4), name


def test_training_lowers_the_loss(small):
    inv, tables, params = small
    rng = np.random.default_rng(4)
    flat = np.tile(rng.integers(0, 60, 12), 200).astype(np.int32)
    t = attention.Trainer(params, tables["near"], inv, batch=16)
    for _ in range(4):
        t.learn(flat, np.full(20, 120))
    assert np.mean(t.losses[-5:]) < 0.7 * np.mean(t.losses[:5])


def test_rows_that_a_batch_does_not_meet(small):
    """Their steps, made later in one sum, are those of Adam over all rows."""
    inv, tables, params = small
    rng = np.random.default_rng(7)
    t = attention.Trainer(params, tables["near"], inv, batch=4)
    model = attention.Model({n: x.copy() for n, x in params.items()}, tables["near"], inv)
    m, s, step = {n: np.zeros_like(x) for n, x in params.items()}, {n: np.zeros_like(x) for n, x in params.items()}, 0
    for _ in range(6):
        # A few ids at a time, and a batch to a call.
        flat = rng.choice(rng.integers(0, 60, 8), 4 * attention.STRIDE).astype(np.int32)
        t.learn(flat, np.array([len(flat)]))
        _, d = model.gradients(attention.windows(flat, np.array([len(flat)]), inv, start=True))
        step += 1
        for name, g in d.items():
            m[name] += 0.1 * (g - m[name])
            s[name] += 0.01 * (g * g - s[name])
            rate = t.RATE.get(name, t.rate) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            model.p[name] -= (rate * m[name] / (np.sqrt(s[name]) + 1e-8)).astype(np.float32)
        model.prepare()
    got = t.params()
    assert t.step == 6 and set(got) == set(params)
    for name, x in model.p.items():
        assert got[name].shape == x.shape and np.abs(got[name] - x).max() < 0.01 and np.abs(got[name] - x).mean() < 5e-4, name
    assert abs(got["gate"] - params["gate"]).max() > 0.05


def test_texts_are_cut_once(odd, none):
    """The reading that counts also gives each text's ids, which training takes as they are."""
    import public_tokenizers

    path = public_tokenizers.path(lmscore.PIECES)
    rows = lmscore.corpus_rows(odd.selectExpr("*", "false as held_out"), path)
    got = sorted(bytes(r.ids) for r in rows.filter("place is not null").collect())
    want = []
    for r in odd.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", low) for i in lmscore.subwords(path).model.encode(w) or [0]]
        want.append(np.array([*ids, lmscore.END], "<u2").tobytes())
    assert got == sorted(want)
    assert sorted(map(str, lmscore.counts_in(rows).collect())) == sorted(map(str, lmscore.corpus_counts(odd, path).collect()))
    assert sorted(bytes(r.ids) for r in lmscore.read_ids(odd, path).collect()) == got
    assert lmscore.corpus_rows(none.selectExpr("*", "false as held_out"), path).collect() == []
    # Those held out have ids and no counts.
    some = lmscore.corpus_rows(odd.selectExpr("*", "coalesce(doc_id, 0) % 2 = 0 as held_out"), path)
    assert sorted(bytes(r.ids) for r in some.filter("place is not null").collect()) == got
    counts = lmscore.corpus_counts(odd.filter("coalesce(doc_id, 0) % 2 <> 0"), path)
    summed = lambda t: Counter({(r.word, r.pair): r.n for r in t.collect() if r.n})
    assert summed(lmscore.counts_in(some)) == summed(counts)


def test_training_reads_whole_texts():
    """Every id of every text and its end, whatever its length."""
    import public_tokenizers
    import pyarrow as pa

    words = lmscore.subwords(public_tokenizers.path(lmscore.PIECES))
    texts = ["", "one", "two words", " ".join(f"item{i} of" for i in range(20_000)), "the end."]
    got = list(lmscore.whole_texts(pa.array(texts), words, most=1000))
    want = [[*[i for w in t.split() for i in words.model.encode(w)], lmscore.END] for t in texts]
    assert np.concatenate([s for _, s in got]).tolist() == [len(w) for w in want]
    assert np.concatenate([f for f, _ in got]).tolist() == sum(want, [])


def test_short_texts_are_trained_on(spark):
    """Starts and ends are learned, also of texts of one and two words, and each text in one round."""
    import public_tokenizers

    path = public_tokenizers.path(lmscore.PIECES)
    docs = spark.createDataFrame([(i, "yes" if i % 2 else "no then") for i in range(60)], "doc_id long, text string")
    counts = lmscore.cut(lmscore.corpus_counts(docs, path))
    inv, tables = lmscore.first_tables(lmscore.cut(lmscore.pair_counts(counts, path)), path)
    first, got = attention.fresh(tables, inv), lmscore.train_attention(spark, docs, inv, tables, path)
    start, end = inv.start, inv.row[lmscore.subwords(path).model.encode("yes")[-1]]
    assert all(abs(got["gate"][r] - first["gate"][r]).max() > 1e-3 for r in (start, end))


def brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows]
    c, docs = Counter(), held.count(False)
    for w, h in zip(words, held):
        if not h:
            c.update(w)
    total, kinds = sum(c.values()) + docs, len(c) + (docs > 0)
    unit = math.log10(total + kinds + 1)
    out = []
    for (d, _), w, h in zip(rows, words, held):
        base = sum(math.log10(c[x] + 1) for x in w) + math.log10(docs + 1) - unit * (len(w) + 1)
        out.append((str(d), h, len(w) + 1, sum(c[x] > 0 for x in w) + (docs > 0), total, base))
    return sorted(out)


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_base(odd, odd_rows, monkeypatch, head):
    monkeypatch.setattr(lmscore.head_counts, "__defaults__", (head,))
    monkeypatch.setattr(lmscore.train_attention, "__defaults__", (1,))
    got = lmscore.score(odd).collect()
    rows = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    want = brute([r[:2] for r in odd_rows])
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(rows, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = [r.score for r in got if r.doc_id == 1]
    assert len(same) == 2 and math.isclose(*same, rel_tol=1e-5)


def test_empty(none):
    assert lmscore.score(none).collect() == []


def test_learns_the_corpus(spark):
    """Held-out texts of the same kind score better than scrambled ones."""
    rng = np.random.default_rng(6)
    stems, ends = ["walk", "talk", "jump", "play"], ["ing", "ed", "er"]
    make = lambda: " ".join(f"the {rng.choice(stems)}{rng.choice(ends)} of a" for _ in range(30))
    rows = [(i, make()) for i in range(200)]
    rows += [(i, "".join(rng.permutation(list(make().replace(" ", "")))[:400].tolist())) for i in range(1000, 1020)]
    got = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    per = lambda keep: np.mean([r.score / r.n_tokens for r in got if keep(r)])
    held = per(lambda r: r.held_out and r.doc_id < 1000)
    assert held > -1.2 and held > np.mean([r.base_score / r.n_tokens for r in got if r.held_out and r.doc_id < 1000]) - 0.5
