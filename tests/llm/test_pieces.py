"""Encoding and decoding against the sentencepiece library itself."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from namesake.llm import pieces, queries
from namesake.llm.prefixtable import PieceTokenizer, tokenizer

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = st.sampled_from([
    " ", "  ", "      ", "▁", "a", "the", "ing", "ation", "\n", "\t", "\r\n", "é", "é", "中", "日本", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x0A>",
    "ｆ", "Z", "1", "2024", "...", "⁇", "�", "　", "zzzzqqq", "internationalization",
])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_equal_the_library(text):
    words = tokenizer(PATH)
    want = LIBRARY.encode(text)
    assert words.encode(text).tolist() == want
    assert words.decode(want) == LIBRARY.decode(want)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    words = tokenizer(PATH)
    assert words.encode(text).tolist() == LIBRARY.encode(text)
    assert words.decode(words.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


def test_any_ids():
    r = random.Random(3)
    words = tokenizer(PATH)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32_000), r.randrange(259), 259, 260, 28705, 0, 1, 2]) for _ in range(r.randint(0, 8))]
        assert words.decode(ids) == LIBRARY.decode(ids)


def test_pairs_by_definition():
    """The walk back in time agrees with merging the characters."""
    r = random.Random(4)
    words = tokenizer(PATH)
    names = [*words.parts, *words.letters]
    for _ in range(20_000):
        a, b = r.choice(names), r.choice(names)
        if r.random() < 0.6:
            whole = a + b
            cut = r.randint(1, len(whole) - 1)
            a, b = whole[:cut], whole[cut:]
            if any(x not in words.letters and x not in words.parts for x in (a, b)):
                continue
        assert words.fit(a, b) == (words._merge(list(a + b)) == [a, b])


def test_small_memory():
    """Generations that turn over all the time change nothing."""
    words = PieceTokenizer(PATH)
    words.CHUNKS, words.PAIRS = 3, 5
    r = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(r.choice("abcdefgh\n") for _ in range(r.randint(0, 9))) for _ in range(6))
        assert words.encode(text).tolist() == LIBRARY.encode(text)


def test_long_text_without_spaces():
    words = tokenizer(PATH)
    for text in ("a" * 20_000, " " * 5_000, "ab\n" * 3_000, "日" * 4_000, "😀" * 2_000, "the quick " * 4_000):
        assert words.encode(text).tolist() == LIBRARY.encode(text)
        assert words.decode(words.encode(text)) == text


def test_tables(spark, odd, odd_rows, none):
    both = pieces.round_trip(odd)
    want = sorted((str(r[0]), LIBRARY.encode(r[1] or ""), r[1] or "") for r in odd_rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both.collect()) == want
    encoded = pieces.encode(odd, keep=("doc_id", "size"))
    assert encoded.columns == ["doc_id", "size", "ids"]
    back = pieces.decode(encoded)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted((a, c) for a, _, c in want)
    assert both.filter("false").collect() == pieces.round_trip(none).collect() == pieces.encode(none).collect() == []
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, `a.b` string")
    assert sorted(tuple(r) for r in pieces.decode(rows, keep=("doc_id", "a.b")).collect()) == [(1, "x", ""), (2, "y", "")]


def test_query(spark, odd, odd_rows, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_rows:
        ids = LIBRARY.encode(r[1] or "")
        want.append((str(r[0]), len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    got = queries.op12_pieces(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
