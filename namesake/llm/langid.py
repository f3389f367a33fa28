"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over every way to cut it into pieces, found by
the forward algorithm; a text is scored by the product over its words. All
distinct words of a batch with the same length advance together.

The distributions are learned from word counts per language over all training
documents: first from how often a piece occurs as a substring, then by one or
more rounds of expected counts (forward and backward). What reaches the driver
is a number per piece and language.

A word is a run of letters, lower case, marked at its start; runs beyond
LONGEST letters are taken as several words. A letter outside the vocabulary
passes at the same small probability in every language.

Defined results: null texts and texts without a letter are ``und`` with score 0;
the score of others is the probability of the language given the text, all
languages being equally likely beforehand; ties go to the name that sorts first.
Without training rows every text is ``und``. Null languages are not learned;
repeated rows and null ids are handled row by row; an empty table gives an
empty result. Only doc_id, text and lang are read, lang for learning alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import crc_fold, slices
from namesake.session import cut

PIECES = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
ROUNDS = 1
#: Added to the expected count of each piece of the vocabulary.
SMOOTHING = 0.5
#: Letters of the longest piece, its mark included, and of a run at most.
WIDEST, LONGEST = 17, 100
#: Probability of a letter that the vocabulary lacks.
UNKNOWN = 1e-7
#: Keeps products near one: about the inverse of the probability of a letter.
LIFT = 16.0
UNDETERMINED = "und"
SLICE = 4_000_000
_START = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces, those at a word's start with the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    bodies = ((p, p.removeprefix(_START)) for p in pieces)
    return sorted(p for p, b in bodies if p == _START or (b.isalpha() and b == b.lower()))


class Pieces:
    """Finds pieces by the hash of their code points."""

    def __init__(self, names: list[str]) -> None:
        self.size = len(names)
        if max(map(len, names)) > WIDEST:
            raise ValueError("a piece is longer than words are searched")
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.ids = np.full(1 << _BITS, -1, np.int32)
        self.single = {n for n in names if len(n) == 1}
        for i, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * int(_P) + ord(c)) & (2**64 - 1)
            at = self._slot(np.array([h], np.uint64))[0]
            while self.keys[at]:
                if self.keys[at] == h:
                    raise ValueError("two pieces share a hash")
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ids[at] = h, i

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        key = self.keys[at]
        out = np.where(key == h, self.ids[at], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece ids) of words of one length, by start; id ``size`` is an unknown letter."""
        m, n = codes.shape
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i, min(n, i + WIDEST)):
                h = h * _P + codes[:, j]
                found = self.find(h)
                if j == i:
                    found[found < 0] = self.size
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield i, j + 1, rows, found[rows]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, code matrix) of words of equal length, with the mark before each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(order)]):
        rows, n = order[a:b], int(lengths[order[a]])
        if n == 0:
            continue
        flat = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.empty((b - a, n + 1), np.uint64)
        codes[:, 0] = ord(_START)
        codes[:, 1:] = flat.reshape(b - a, n)
        yield rows, np.ascontiguousarray(codes)


def log_probabilities(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; ``table`` is (pieces + 1, languages)."""
    out = np.zeros((len(words), table.shape[1]))
    lifted = [table * LIFT**k for k in range(WIDEST + 1)]
    for rows, codes in by_length(words):
        m, n = codes.shape
        alpha = np.zeros((n + 1, m, table.shape[1]))
        alpha[0] = 1.0
        for i, j, r, ids in pieces.arcs(codes):
            alpha[j, r] += alpha[i, r] * lifted[j - i][ids]
        out[rows] = np.log(np.maximum(alpha[n], 1e-300)) - n * np.log(LIFT)
    return out


def expected_counts(words: list[str], langs: np.ndarray, n: np.ndarray, pieces: Pieces, table: np.ndarray | None, languages: int) -> np.ndarray:
    """Expected uses of each piece in each language; without a table, occurrences as substrings."""
    width = pieces.size + 1
    out = np.zeros(width * languages)
    for rows, codes in by_length(words):
        lang, weight = langs[rows], n[rows].astype(float)
        arcs = list(pieces.arcs(codes))
        if table is None:
            for _, _, r, ids in arcs:
                out += np.bincount(lang[r] * width + ids, weight[r], len(out))
            continue
        m, length = codes.shape
        alpha = np.zeros((length + 1, m))
        beta = np.zeros((length + 1, m))
        alpha[0] = beta[length] = 1.0
        chance = [table[ids, lang[r]] * LIFT ** (j - i) for i, j, r, ids in arcs]
        for (i, j, r, _), p in zip(arcs, chance):
            alpha[j, r] += alpha[i, r] * p
        for (i, j, r, _), p in zip(reversed(arcs), reversed(chance)):
            beta[i, r] += beta[j, r] * p
        whole = np.maximum(alpha[length], 1e-300)
        for (i, j, r, ids), p in zip(arcs, chance):
            out += np.bincount(lang[r] * width + ids, weight[r] * alpha[i, r] * p * beta[j, r] / whole[r], len(out))
    return out.reshape(languages, width)


def letter_runs(texts: pa.Array) -> pa.ListArray:
    """Runs of letters of each text, in lower case."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " ")
    # Runs beyond the limit go on as further words.
    if pc.any(pc.match_substring_regex(spaced, f"[^ ]{{{LONGEST}}}")).as_py():
        spaced = pc.replace_substring_regex(spaced, f"([^ ]{{{LONGEST}}})", r"\1 ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text = batch.column("lang"), batch.column("text")
            for name in pc.unique(lang):
                mine = text.filter(pc.equal(lang, name))
                sizes = pc.fill_null(pc.utf8_length(mine), 0).to_pylist()
                for a, b in slices(sizes, SLICE):
                    words = letter_runs(mine.slice(a, b - a)).flatten()
                    counts = words.filter(pc.not_equal(words, "")).value_counts()
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(name, len(counts)), counts.field("values"), counts.field("counts")], names=["lang", "word", "n"]
                    )

    emitted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return emitted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, table): probabilities of pieces, one column for each language."""
    path = path or public_tokenizers.path(PIECES)
    counts = cut(word_counts(docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")))
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    names = vocabulary(path)
    table: np.ndarray | None = None
    for _ in range(rounds + 1 if languages else 0):
        known = table

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            pieces, number = Pieces(names), {x: i for i, x in enumerate(languages)}
            total = np.zeros((len(languages), pieces.size + 1))
            for batch in batches:
                langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                total += expected_counts(batch.column("word").to_pylist(), langs, batch.column("n").to_numpy(), pieces, known, len(languages))
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[lang, piece])], names=["lang", "piece", "n"]
            )

        sums = counts.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        table = np.full((len(names) + 1, len(languages)), SMOOTHING)
        # A number for each piece of the fixed vocabulary and language.
        for r in sums.orderBy("lang", "piece").toLocalIterator():
            table[r["piece"], r["lang"]] += r["n"]
        table[len(names)] = 0
        table /= table.sum(axis=0)
        table[len(names)] = UNKNOWN
    return languages, table if table is not None else np.zeros((len(names) + 1, 0))


def identify(docs: DataFrame, languages: Sequence[str], table: np.ndarray, keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, held_out, lang_pred and score for every row of ``docs``."""
    path = path or public_tokenizers.path(PIECES)
    names = [f"_k{i}" for i in range(len(keep))]
    narrow = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], (crc_fold(FOLDS) == HELD_OUT).alias("held_out"), F.col("text").alias("_text")
    )
    shipped = narrow.sparkSession.sparkContext.broadcast((list(languages), table, vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chances, inventory = shipped.value
        pieces = Pieces(inventory)
        for batch in batches:
            text = batch.column("_text")
            for a, b in slices(pc.fill_null(pc.utf8_length(text), 0).to_pylist(), SLICE):
                part = batch.slice(a, b - a)
                runs = letter_runs(part.column("_text"))
                coded = runs.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                sums = np.zeros((b - a, len(known)))
                size = pc.list_value_length(runs).to_numpy()
                if len(words):
                    logs = log_probabilities(words, pieces, chances)[coded.indices.to_numpy()]
                    some = np.flatnonzero(size)
                    sums[some] = np.add.reduceat(logs, (np.cumsum(size) - size)[some], axis=0)
                lettered = np.zeros(b - a, bool)
                owner = np.repeat(np.arange(b - a), size)
                lettered[owner[np.array([bool(w) for w in words], bool)[coded.indices.to_numpy()]]] = True
                if known:
                    best = sums.argmax(axis=1)
                    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    guess = [known[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
                    share = np.where(lettered, share, 0.0)
                else:
                    guess, share = [UNDETERMINED] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in [*names, "held_out"]], pa.array(guess, pa.string()), pa.array(share)],
                    names=[*names, "held_out", "lang_pred", "score"],
                )

    kinds = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    made = narrow.mapInArrow(run, f"{kinds}, held_out boolean, lang_pred string, score double")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "held_out", "lang_pred", "score")


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold and labels all."""
    languages, table = train(docs.filter(crc_fold(FOLDS) != HELD_OUT))
    return identify(docs, languages, table)
