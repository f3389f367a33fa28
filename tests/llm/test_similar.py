"""Near-duplicates and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from namesake.llm import ordermin, simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in lower).split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint(spark, odd_rows):
    for text in [r[1] for r in odd_rows if len(r[1] or "") < 1000] + ["One", "A b", "Ä B C D É", "a" * 300 + " b c", "x y z " * 400]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    # Spark's own hash of a string is the same one.
    assert spark.range(1).select(F.xxhash64(F.lit("the end of"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("the end of", 42)


def random_fingerprints():
    """Far apart ones, chains of close ones, and a crowd around one point."""
    r = random.Random(8)
    out = {r.getrandbits(64) for _ in range(300)}
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(8):
            out.add(f)
            f ^= 1 << r.randrange(64)
            f ^= 1 << r.randrange(64)
    centre = r.getrandbits(64)
    for _ in range(400):
        f = centre
        for _ in range(r.randrange(1, 6)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("cell_pairs", [4, 64, 10_000])
def test_links_give_all_components(spark, cell_pairs):
    fps = random_fingerprints()
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell_pairs=cell_pairs).collect()
    assert all(((e.src ^ e.dst) % 2**64).bit_count() <= 2 for e in edges)
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.src)] = find(e.dst)
    want = slow_components(fps)
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(find(s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_a_crowd_makes_no_pairs(spark):
    """Links of a crowd grow with its size, not with its square."""
    r = random.Random(9)
    centre, fps = r.getrandbits(62), set()
    while len(fps) < 3000:
        f = centre
        for _ in range(3):
            f ^= 1 << r.randrange(62)
        fps.add(f)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert edges.count() < 20 * len(fps)


def test_lower_bound(spark):
    fps = [f for f in random_fingerprints() if not f >> 63][:200]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", simhash.segment_counts(F.col("fp")).alias("c"))
    counts = {r.fp: r.c % 2**64 for r in df.collect()}
    for a in fps[::5]:
        for b in fps[::7]:
            manhattan = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
            assert manhattan == (counts[a] ^ counts[b]).bit_count() <= (a ^ b).bit_count()


def test_components(odd, odd_rows, none):
    got = simhash.components(odd).collect()
    fps = {r[1]: slow_fingerprint(r[1]) for r in odd_rows}
    root = slow_components(list(fps.values()))
    lowest = {}
    for r in odd_rows:
        if r[0] is not None:
            k = root[fps[r[1]]]
            lowest[k] = min(lowest.get(k, r[0]), r[0])
    want = sorted((r[0] or 0, fps[r[1]], lowest.get(root[fps[r[1]]], -1)) for r in odd_rows)
    assert sorted((r.doc_id or 0, r.fp % 2**64, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert simhash.components(none).collect() == []
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(lowest.get(root[fps[r[1]]])) for r in odd_rows})
    assert simhash.keep_first(none).collect() == []


def slow_sketches(text, k=ordermin.K):
    """Order MinHash word for word, from the same k-mer hashes."""
    h = ordermin.kmer_hashes(np.array([ord(c) for c in text], np.uint32)).tolist() if text else []
    seen, items = {}, []
    for place, x in enumerate(h):
        key = x >> 20
        seen[key] = seen.get(key, -1) + 1
        value = int(ordermin._mix(np.array([x], np.uint64) + np.uint64(seen[key] + 1) * ordermin._M3)[0])
        items.append((value % ordermin.BINS, value, place))
    out = []
    for b in range(ordermin.BINS):
        mine = sorted(x[1:] for x in items if x[0] == b)[: ordermin.TUPLE]
        if not mine:
            out.append(-1)
            continue
        total = np.zeros(1, np.uint64)
        ordered = [v for v, _ in sorted(mine, key=lambda x: x[1])] + [0] * (ordermin.TUPLE - len(mine))
        for j, v in enumerate(ordered):
            total = ordermin._mix(total * ordermin._M3 + np.uint64(v) + np.uint64(j + 1))
        out.append(int(total[0] >> np.uint64(48)))
    return out


def test_sketches():
    r = random.Random(4)
    texts = ["", "a", "abcd", "abcde", "aaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat and the cat sat on the hat"]
    texts += ["".join(r.choice("ab ") for _ in range(n)) for n in (50, 700, 5000)] + ["".join(chr(r.randrange(97, 123)) for _ in range(6000))]
    for t in texts:
        assert ordermin.text_sketches(t).tolist() == slow_sketches(t)


def test_order_and_edits_matter():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text, shuffled = " ".join(words), " ".join(r.sample(words, 400))
    like = lambda a, b: ordermin.likeness(ordermin.text_sketches(a), ordermin.text_sketches(b))
    near = text.replace(words[7], "zzzzzz")
    assert like(text, text) == 1.0 and like(text, near) > 0.9 > like(text, shuffled)
    half = text[: len(text) // 2] + shuffled[len(text) // 2 :]
    assert like(text, near) > like(text, half) > like(text, " ".join(r.choice("xyzuvw") * 6 for _ in range(400)))
    assert like("", "") == 1.0 and like("", text) == 0.0


@pytest.mark.parametrize("parts", [1, 8])
def test_edited_pairs(spark, odd, odd_rows, none, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ordermin.edited_pairs(odd).collect()
        rows = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        texts = [r[1] or "" for r in rows]
        want = []
        for r, t, nxt in zip(rows, texts, texts[1:] + texts[:1]):
            third = len(t) // 3
            new = t[: len(t) - third] + nxt[:third]
            a, b, c = map(ordermin.text_sketches, (t, new, nxt))
            want.append((str(r[0]), len(t), hashlib.sha256(new.encode()).hexdigest(), ordermin.written(a), ordermin.written(b), ordermin.likeness(a, b), ordermin.likeness(a, c)))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
        assert ordermin.edited_pairs(none).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
