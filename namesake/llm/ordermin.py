"""Document fingerprints by Order MinHash.

A k-mer is a run of K code points together with how often it came before in the
text. Every occurrence-numbered k-mer has a hash; the low bits assign it to one
of BINS sketches, and each sketch keeps its TUPLE smallest. They are put back
into text order and hashed as a tuple, so the sketch changes both when k-mers
change and when their order does: agreement of sketches follows edit distance.
(The sketches share one hash function and divide the k-mers among them instead
of each hashing all anew, which takes one pass for any number of sketches.)

A fingerprint is BINS fields of four hex digits; ``----`` marks a sketch that no
k-mer fell to. The likeness of two fingerprints is the share of sketches that
agree among those that at least one of them has; two without any are alike. A
text shorter than K is one k-mer.

``edited_pairs`` compares every document with an edit of itself: rows are dealt
by ranges of the id, which moves each text once, and neighbours within a range
are met while it streams by. Only the two rows at the ends of a range take part
in a second, small join.

Defined results: null texts are empty; equal texts have equal fingerprints; rows
of equal id follow each other by text, and null ids come last; with one row the
next document is the row itself; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesake.llm.common import text_of, written as in_shared_folder

K = 5
BINS = 64
TUPLE = 2
_EMPTY = "-" * 4
_PLACE = 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def kmer_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of ``k`` code points."""
    if len(codes) == 0:
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    wide = codes.astype(np.uint64)
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        h = h * _M3 + wide[j : len(codes) - k + 1 + j]
    return _mix(h)


def sketches(hashes: np.ndarray, bins: int = BINS, size: int = TUPLE) -> np.ndarray:
    """One value per sketch from k-mer hashes in text order; -1 where it has no k-mer."""
    n = len(hashes)
    out = np.full(bins, -1, np.int64)
    if n == 0:
        return out
    # Equal k-mers side by side in text order; 44 bits of the hash tell them apart.
    if n <= 1 << _PLACE:
        packed = np.sort(hashes >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        ranked = packed >> np.uint64(_PLACE)
    else:
        ranked = hashes >> np.uint64(_PLACE)
        order = np.argsort(ranked, kind="stable")
        ranked = ranked[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    if fresh.all():
        numbered = _mix(hashes + _M3)
    else:
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (np.arange(n) - first).astype(np.uint64)
        numbered = _mix(hashes + (occurrence + np.uint64(1)) * _M3)
    # A sketch's smallest are nearly always among the smallest of all; if one lacks them, all are sorted.
    most = 8 * bins * size
    if n > 4 * most:
        limit = np.uint64(int(2**64 * (most / n)))
        some = np.flatnonzero(numbered < limit)
        got = np.bincount((numbered[some] & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        if got.min() < size:
            some = np.arange(n)
    else:
        some = np.arange(n)
    value = numbered[some]
    sketch = (value & np.uint64(bins - 1)).astype(np.int64)
    by = np.lexsort((value, sketch))
    sketch, place, value = sketch[by], some[by], value[by]
    start = np.flatnonzero(np.diff(sketch, prepend=-1))
    ids = sketch[start]
    ends = np.append(start[1:], len(sketch))
    places = np.full((len(ids), size), n, np.int64)
    values = np.zeros((len(ids), size), np.uint64)
    for j in range(size):
        has = start + j < ends
        places[has, j] = place[start[has] + j]
        values[has, j] = value[start[has] + j]
    values = np.take_along_axis(values, np.argsort(places, axis=1, kind="stable"), axis=1)
    h = np.zeros(len(ids), np.uint64)
    for j in range(size):
        h = _mix(h * _M3 + values[:, j] + np.uint64(j + 1))
    out[ids] = (h >> np.uint64(48)).astype(np.int64)
    return out


def text_sketches(text: str) -> np.ndarray:
    return sketches(kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))


def written(values: np.ndarray) -> str:
    return "".join(_EMPTY if v < 0 else f"{v:04x}" for v in values.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing sketches among those that either text has."""
    either = (a >= 0) | (b >= 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def made(texts):
        return texts.map(lambda t: written(text_sketches(t)))

    return docs.withColumn(name, made(text_of(text)))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the head of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(key: object, text: str, own: np.ndarray, following: str, other: np.ndarray) -> dict:
    new = edited(text, following)
    changed = own if new == text else text_sketches(new)
    return {
        "doc_id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": written(own), "edited_fingerprint": written(changed),
        "near_edited": likeness(own, changed), "near_next": likeness(own, other),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is that of the next smaller id; after the last
    comes the first.
    """
    narrow = docs.select("doc_id", text_of().alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = narrow.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, schema, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            rows = []
            schema = schema or pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                ("part", pa.int64()), ("end", pa.string()), ("text", pa.string()),
            ])
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = text_sketches(text)
                if last is None:
                    first = (key, text)
                else:
                    rows.append(_compared(*last, text, own))
                last = (key, text, own)
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)
        if last is not None:
            ends = [{"doc_id": first[0], "end": "first", "text": first[1]}, {"doc_id": last[0], "end": "last", "text": last[1]}]
            yield pa.RecordBatch.from_pylist([{f.name: (r | {"part": part}).get(f.name) for f in schema} for r in ends], schema=schema)

    seen = in_shared_folder(dealt.mapInArrow(run, f"doc_id {kind}, {_RESULT}, part long, end string, text string"))
    inner = seen.filter(F.col("end").isNull()).drop("part", "end", "text")
    # Two rows of each range: the numbers of ranges are put in order, the texts follow by a join.
    firsts = seen.filter("end = 'first'").select("part", F.col("text").alias("next_text"))
    parts = firsts.select("part")
    whole = Window.partitionBy()
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(whole)).alias("next_part"))
    lasts = seen.filter("end = 'last'").select("doc_id", "part", "text").join(following, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))):
                rows.append(_compared(key, text, text_sketches(text), other, text_sketches(other)))
            columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[c] for r in rows], t) for c, t in zip(columns, kinds)]], names=["doc_id", *columns]
            )

    return inner.unionByName(pairs.mapInArrow(finish, f"doc_id {kind}, {_RESULT}"))
