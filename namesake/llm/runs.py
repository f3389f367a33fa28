"""Runs: stretches of words that repeat with a period.

A run is a stretch of words whose smallest period is ``q``, which holds the
period often enough, and which no neighbouring word extends. They are found by
Lyndon roots. Every run holds, for one of the two orders of the words, the
longest Lyndon word that begins at some place as its period; so the longest
Lyndon word at each place, in either order, is a candidate, two for each word.
A candidate is extended to the right by the longest common extension of its
start and its end, and to the left by that of the reversed text. Suffix trees
of the text and of its reversal answer both in constant time (``suffixtree``).

Before the trees are built, words that cannot lie in a run are taken out: a run
holds each of its words as often as it holds its period. A stretch of them is
put in the tree as one symbol of its own, which no run can cross. What remains
is told from counts within the stretches left, again and again until nothing
changes.

Work is n log n for a text of n words. The trees stand in the memory of one task
and take some hundred bytes for each word that may lie in a run.

Defined results: null and empty texts have no words and no runs; texts of any
length are searched whole; rows are handled one by one, so repeated rows, ties
and null keys stay as they are; an empty table gives an empty result. Only the
columns named are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import slices, text_of
from namesake.llm.suffixtree import SuffixTree

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Code points whose results are handed on together.
SLICE = 2_000_000


def repetitive(codes: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """Places that may lie in a run, rising."""
    places = np.arange(len(codes))
    while len(places) >= least_words:
        # Stretches of neighbouring places, and how often each word stands in its stretch.
        stretch = np.concatenate([[0], np.cumsum(np.diff(places) > 1)])
        _, key, count = np.unique(stretch * (codes.max() + 1) + codes[places], return_inverse=True, return_counts=True)
        kept = (count[key] >= least_periods) & (np.bincount(stretch)[stretch] >= least_words)
        if kept.all():
            return places
        places = places[kept]
    return places[:0]


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank, else the number of places."""
    n = len(rank)
    out, open_ = [n] * n, []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of_codes(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period), sorted by start, then period."""
    none = np.empty((0, 3), np.int64)
    places = repetitive(codes, least_words, least_periods)
    if not len(places):
        return none
    # A gap between stretches becomes one symbol that occurs nowhere else.
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    apart = int(codes.max()) + 1 + np.arange(len(breaks))
    symbols = np.insert(codes[places], breaks, apart)
    origin = np.insert(places, breaks, -1)
    n = len(symbols)
    forward, backward = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    falling = np.empty(n + 1, np.int64)
    falling[forward.tour(falling=True)[0]] = np.arange(n + 1)
    found = []
    for rank in (forward.rank, falling):
        i = np.arange(n)
        j = _next_smaller(rank[:n].tolist())
        short = (j - i) * least_periods <= n
        i, j = i[short], j[short]
        right = forward.common(i, j)
        left = backward.common(n - i, n - j)
        start, length, period = i - left, j - i + left + right, j - i
        long = (length >= least_words) & (length >= least_periods * period)
        found.append(np.stack([origin[start[long]], length[long], period[long]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def runs_of_words(words: Sequence, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    if len(words) < least_words:
        return np.empty((0, 3), np.int64)
    number: dict = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return runs_of_codes(codes, least_words, least_periods)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: not if a run holds it after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str | Column = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """``keep``, n_words, runs (start, length, period; sorted by start, then period), collapsed.

    ``collapsed`` holds the words that stay, with one space between them.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    given = text_of(F.col(f"`{text}`") if isinstance(text, str) else text)
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], given.alias("_text"))
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), SLICE):
                sizes, rows, collapsed = [], [], []
                for text in texts.slice(a, b - a):
                    # Bytes are split at exactly the white space that separates words.
                    words = (text.as_py() or "").encode().split()
                    found = runs_of_words(words, least_words, least_periods)
                    sizes.append(len(words))
                    rows.append(found)
                    if len(found):
                        words = [w for w, k in zip(words, kept_words(len(words), found).tolist()) if k]
                    collapsed.append(b" ".join(words))
                flat = np.concatenate([np.empty((0, 3), np.int64), *rows])
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(shape))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n).slice(a, b - a) for n in names],
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), fields),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=[*names, "n_words", "runs", "collapsed"],
                )

    kinds = [f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names]
    kinds += ["n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]
    found = narrow.mapInArrow(run, ", ".join(kinds))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "runs", "collapsed")


def with_period(words: Column, at: Column, period: Column) -> Column:
    """``words`` of which those from ``at`` on repeat the first ``period`` words there."""
    rest = F.transform(F.sequence(at, F.size(words) - 1), lambda i: F.get(words, (at + (i - at) % period).cast("int")))
    return F.concat(F.slice(words, 1, at), rest)
