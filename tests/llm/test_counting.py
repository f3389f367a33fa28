"""Token counts, packing and shards against the tokenizer's own library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from namesake.llm import packing, shards, tokencount
from namesake.llm.transducer import Scanner, WordTokenizer, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PIECES = st.sampled_from([
    "the", "'s", "'re", "'l", "'ll", "'v", "'ve", "'d", "'", "''", " ", "\n", "　", "don't", "12", "½", "É", "É", "ΣΑΣ", "İ", "日本", "😀", "_", "--",
    "<|endoftext|>", "<|startoftext|>", "<|", "internationalization", "zzzzqqq", "\x00", "r", "e", "l", "S",
])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_counts_and_ids_equal_the_library(text):
    words = tokenizer(PATH)
    want = ids_of(text)
    assert int(words.counts([text])[0]) == len(want)
    flat, offsets = words.ids([text])
    assert flat.tolist() == want and offsets.tolist() == [0, len(want)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
def test_batches_of_texts(texts):
    texts = ["".join(c for c in t if c < "⿠") for t in texts]
    words = tokenizer(PATH)
    assert words.counts(texts).tolist() == [len(words.ids([t])[0]) for t in texts]


def test_long_runs_cross_chunks():
    words = tokenizer(PATH)
    for text in ("a" * 5000, "ab" * 700 + "'re" * 300, "'" * 600 + "s", "x " * 900):
        assert int(words.counts([text])[0]) == len(ids_of(text))


def test_scan_equals_walk():
    s = Scanner()
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 10, 3000)
    state, want = 0, []
    for k in kinds:
        want.append(state)
        state = int(s.next[state, k])
    assert s.entry_states(s.generator[kinds]).tolist() == want


def test_token_counts(odd, odd_rows, none):
    got = tokencount.token_counts(odd).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (r[0] or 0, len((r[1] or "").encode()), n := len(ids_of(r[1])), n > 2048) for r in odd_rows
    )
    assert tokencount.token_counts(none).collect() == []


def check_packing(rows, texts, length):
    """Every id in one piece, sequences without gaps, padding only at powers of two: none."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    short = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= length
        if at < length:
            short.append(at)
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    want, got = [], []
    for t in texts:
        ids = np.array(ids_of(t) + [2], "<u4")
        want.append((len(ids), zlib.crc32(ids.tobytes())))
    docs = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (_, total), pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        copies = sum(r.length for r in pieces) // total
        assert sum(r.length for r in pieces) == copies * total
        if copies == 1:
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
            got.append((total, zlib.crc32(b"".join(r.ids for r in pieces))))
    assert set(got) <= set(want)
    assert sum(r.length for r in rows) == sum(n for n, _ in want)


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(odd, odd_rows, none, parts):
    rows = packing.pack(odd.repartition(parts), length=64, open_windows=2, with_ids=True).collect()
    check_packing(rows, [r[1] for r in odd_rows], 64)
    assert packing.pack(none).collect() == []


def test_remainders_merge_over_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(60)], "doc_id long, text string").repartition(20)
    rows = packing.pack(docs, length=128, with_ids=True).collect()
    check_packing(rows, [f"text number {i} " * (i % 7) for i in range(60)], 128)


def test_best_fit():
    p = packing.Packer(10, 2)
    for doc, n in (("a", 6), ("b", 3), ("c", 4)):
        p.add(doc, np.arange(n))
    # b fits beside a, with room for one more id; c has a window of its own.
    assert p.done == [] and [room for room, _ in p.rooms] == [1, 6]
    p.add("d", np.arange(6))
    assert [[x[0] for x in s] for s in p.done] == [["c", "d"]]
    p.add("e", np.arange(9))
    assert [room for room, _ in p.rooms] == [1, 1]
    p.add("f", np.arange(8))
    # f fits neither; the fullest is completed with its head, the rest waits.
    assert [(x[0], len(x[2])) for x in p.done[1]] == [("a", 6), ("b", 3), ("f", 1)]
    # What is left, 9 ids of e and 7 of f, makes one more sequence and 6 ids.
    rest = p.close()
    assert sum(len(x[2]) for x in p.done[2]) == 10 and sum(len(x[2]) for x in rest) == 6


@pytest.mark.parametrize("n", [1, 2, 5, 100, 4097])
def test_permutation(n):
    slots = shards.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert shards.permute(slots, n, inverse=True).tolist() == list(range(n))
    if n > 50:
        assert shards.permute(np.arange(n), n, key=1).tolist() != slots.tolist()


def test_shards_round_trip(odd, odd_rows, none, tmp_path):
    index, folder = shards.write_shards(odd.coalesce(1), str(tmp_path / "out"), length=32, per_shard=50)
    found = {r.slot: r for r in shards.read_slots(index, folder, length=32).collect()}
    rows = sorted(index.collect(), key=lambda r: r.sequence_no)
    assert sorted(found) == list(range(len(rows)))
    stream = [i for r in odd.coalesce(1).collect() for i in ids_of(r.text) + [2]]
    got = [i for r in rows for i in np.frombuffer(found[r.slot].ids, "<u2").tolist()]
    assert got == stream and sum(r.n_ids for r in rows) == len(stream)
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 64 for r in rows)
    assert all(p.stat().st_size == 64 * sum(r.shard == int(p.stem[6:]) for r in rows) for p in (tmp_path / "out").iterdir())
    again, _ = shards.write_shards(odd.coalesce(1), str(tmp_path / "out"), length=32, per_shard=50)
    assert sorted(map(tuple, again.drop("doc_ids").collect())) == sorted(map(tuple, index.drop("doc_ids").collect()))
    assert shards.write_shards(none, str(tmp_path / "none"))[0].collect() == []


@pytest.mark.parametrize("change", ["key", "texts"])
def test_a_filled_folder_is_never_taken_for_another(spark, tmp_path, change):
    """Same folder, same number of ids, another key or other words: every slot reads its own ids."""
    texts = lambda a, b: spark.createDataFrame([(i, f"{a} {b} " * (i % 9 + 1)) for i in range(80)], "doc_id long, text string").coalesce(2)
    folder = str(tmp_path / "out")
    shards.write_shards(texts("the", "cat"), folder, length=16, per_shard=7)
    docs, key = (texts("the", "cat"), 5) if change == "key" else (texts("the", "dog"), shards.KEY)
    index, _ = shards.write_shards(docs, folder, length=16, per_shard=7, key=key)
    fresh, other = shards.write_shards(docs, str(tmp_path / "fresh"), length=16, per_shard=7, key=key)
    read = lambda i, f: sorted((r.slot, r.ids) for r in shards.read_slots(i, f, length=16).collect())
    assert read(index, folder) == read(fresh, other)


def test_memory_generations_change_nothing():
    words = transducer_of_few()
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice(list("abcdef'1"), rng.integers(1, 9))) for _ in range(8)) for _ in range(3)]
        assert words.counts(texts).tolist() == [len(ids_of(t)) for t in texts]
        assert words.ids(texts)[0].tolist() == [i for t in texts for i in ids_of(t)]


def transducer_of_few():
    words = WordTokenizer(PATH)
    words.REMEMBERED, words.merger.MOST = 5, 40
    return words


def test_spans_and_merges_by_definition():
    """The words of ``pretokens`` make up the text again, and merges are those of the definition."""
    import public_tokenizers

    from namesake.llm.tokencount import VOCABULARY
    from namesake.llm.transducer import tokenizer

    words = tokenizer(public_tokenizers.path(VOCABULARY))
    texts = ["", "aa aa aaa aaaa bbb", "Größe ΣΑΣ naïve 東京 12", "it's  we've", "x" * 70 + " y"]
    spans, index, first = words.pretokens([t.lower() for t in texts])
    assert len(set(spans)) == len(spans)
    joined = b"".join(spans[i] for i in index)
    assert joined == ("\n".join(texts) + "\n").lower().encode()
    merger = words.merger

    def by_definition(symbols):
        while True:
            ranked = [(merger.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merger.rank]
            if not ranked:
                return symbols
            a, b = symbols[min(ranked)[1]], symbols[min(ranked)[1] + 1]
            out, i = [], 0
            while i < len(symbols):
                pair = symbols[i : i + 2] == [a, b]
                out.append(a + b if pair else symbols[i])
                i += 2 if pair else 1
            symbols = out

    for word in ("aaaaaaa", "banana", "lalala", "mississippi", "hahahahaha", "tttttt"):
        assert merger.merge(list(word)) == by_definition(list(word))


def test_pairs_without_merging():
    """What merges at the boundary of two tokens say is what merging their letters says."""
    merger = tokenizer(PATH).merger
    rng = np.random.default_rng(5)
    tokens = sorted(merger.vocab)
    for t in [tokens[i] for i in rng.integers(0, len(tokens), 3000)]:
        assert merger._alone(t) == (merger.merge(merger._symbols(t)) == [t])
    inner = [t for t in tokens if not t.endswith(merger.suffix) and merger._alone(t)]
    short = [t for t in inner if len(t) < 4]
    met = set()
    for firsts, lasts in ((inner, tokens), (short, short), (["a", "aa", "aaa", "ha", "haha", "l", "ll"], ["a", "aa", "aaa", "ha", "haha", "ll", "aa</w>"])):
        for _ in range(3000):
            a, b = firsts[rng.integers(len(firsts))], lasts[rng.integers(len(lasts))]
            if b in merger.vocab and a in merger.vocab and merger._alone(b):
                met.add(apart := merger._apart(a, b, len(merger.rank)))
                assert apart == (merger.merge([*merger._symbols(a), *merger._symbols(b)]) == [a, b]), (a, b)
    assert met == {True, False}


def test_words_advance_together():
    """Words of a batch take no step one by one, and have the ids that they have alone."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoinshr'é1日"), rng.integers(1, 20))) for _ in range(500)]
    whole, alone = WordTokenizer(PATH), WordTokenizer(PATH)
    whole.merger.TOGETHER = 64
    flat, offsets = whole.ids(words)
    assert not whole.merger.step and not whole.merger.stop
    alone.LONGEST = 0
    assert not alone.merger.moves.size
    for i, w in enumerate(words):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == alone.ids([w])[0].tolist() == ids_of(w)


def test_ids_of_rare_words_compile_nothing():
    """Short words take their merges together, also where equal pairs overlap; longer ones have their places among them."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("aaalhno'1é"), rng.integers(1, 40))) for _ in range(400)]
    texts += ["a" * n for n in range(1, 65)] + ["", "ha" * 31, " ".join(["z" * 80, "aaaa", "z" * 65, "b", "z" * 80])]
    words = WordTokenizer(PATH)
    flat, offsets = words.ids(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == ids_of(t), t
    words = WordTokenizer(PATH)
    words.ids(texts[:400])
    assert not words.merger.moves.size and not words.merger.step
