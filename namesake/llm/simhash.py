"""SimHash near-duplicates by segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment
is mapped to the number of its bits that are set. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so a range
join of the vectors finds every link; what it finds is then verified exactly.

The range join works on a grid. The vector is cut into blocks, two more than
can still be equal: with ``max_bits`` differences, at most ``max_bits`` of the
``max_bits + 3`` blocks differ, so two vectors in range share a cell of at least
one of the grids that fix three blocks. A cell holds few fingerprints as a rule.
A crowded cell (the surroundings of a large group of near copies) is not
compared pair by pair: its fingerprints are linked through the points one bit
away, which all fingerprints two bits apart share. Nothing is lost either way.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; equal texts and
repeated rows share a fingerprint and so a component; a null id gets the
component of its fingerprint, and an empty table an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import WORD
from namesake.operators.components import connected_components, join_counted
from namesake.session import cut

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A cell with more fingerprints than this is linked through shared points.
CELL_PAIRS = 64
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = re.compile(WORD)


def shingles_of(text: str | None, shingle_words: int) -> Iterable[str]:
    """The runs of so many words of a text; all its words where they are fewer."""
    words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []
    if len(words) < shingle_words:
        return [" ".join(words)] if words else []
    return map(" ".join, zip(*[words[i:] for i in range(shingle_words)]))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as an unsigned number."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(text, shingle_words)), np.uint64)
    if not len(hashes):
        return 0
    # Sums of bytes stay below 256 within a block of 255 rows.
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` and fp: the fingerprint as a signed long."""
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column("_text")]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(signed, pa.int64())], names=[*names, "fp"])

    narrow = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").alias("_text"))
    kinds = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    made = narrow.mapInArrow(run, f"{kinds}, fp long")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "fp")


_ODD = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """The counts of all two-bit segments in one long, as 00, 01 or 11.

    In this form the Manhattan distance of two vectors is the number of bits in
    which they differ.
    """
    other = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(other).bitwiseAND(F.lit(_ODD))
    both = fp.bitwiseAND(other).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _masks(max_bits: int) -> list[int]:
    """Bit masks, one for each grid: three of ``max_bits + 3`` blocks of segments."""
    blocks = max_bits + 3
    edges = [round(32 * b / blocks) for b in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    out = [block[i] | block[j] | block[k] for i, j, k in combinations(range(blocks), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints ``fps(fp)``.

    Their components are those of all pairs within ``max_bits``: a pair in range
    is either an edge itself or meets in a point to which both are joined.
    """
    if max_bits != 2:
        raise ValueError("shared points are worked out for two bits")
    counts = segment_counts(F.col("fp"))
    masks = F.array(*[F.lit(m) for m in _masks(max_bits)])
    cells = cut(
        fps.withColumn("counts", counts)
        .select("fp", F.posexplode(masks).alias("grid", "_mask"), "counts")
        .select("grid", F.col("counts").bitwiseAND(F.col("_mask")).alias("cell"), "fp")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(cells.join(sizes, ["grid", "cell"]))
    few = shared.filter(F.col("n") <= cell_pairs).drop("n")
    left, right = few.withColumnRenamed("fp", "src"), few.withColumnRenamed("fp", "dst")
    ranged = left.join(right, ["grid", "cell"]).filter(
        (F.col("src") < F.col("dst")) & _near(segment_counts(F.col("src")), segment_counts(F.col("dst")), max_bits)
    )
    verified = ranged.filter(_near(F.col("src"), F.col("dst"), max_bits)).select("src", "dst")
    crowded = shared.filter(F.col("n") > cell_pairs).select("fp").distinct()
    flips = [0, *[1 << b for b in range(63)], -(1 << 63)]
    ways = F.array(*[F.lit(f).cast("long") for f in flips])
    points = crowded.select("fp", F.explode(ways).alias("_flip")).select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("point"))
    # All fingerprints at a point are two bits apart at most; each is tied to the smallest there.
    lowest = points.groupBy("point").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1")
    ties = points.join(lowest, "point").filter(F.col("fp") != F.col("dst")).select(F.col("fp").alias("src"), "dst")
    return verified.unionByName(ties).distinct()


def components(docs: DataFrame, keep: Sequence[str] = ("doc_id",), max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` (with doc_id), fp, component_id and cluster: documents linked by near fingerprints.

    ``component_id`` is the smallest doc_id that links lead to, ``cluster`` the
    smallest fingerprint. Documents of equal fingerprint are one node, whatever
    their number.
    """
    table = cut(fingerprints(docs, keep, shingle_words))
    nodes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")))
    found = connected_components(links(nodes.select("fp"), max_bits))
    grouped = nodes.join(found.withColumnRenamed("record_id", "fp"), "fp", "left")
    grouped = grouped.withColumn("cluster", F.coalesce("cluster", "fp"))
    low = grouped.groupBy("cluster").agg(F.min("first").alias("component_id"))
    named = cut(grouped.select("fp", "cluster", "_n").join(low, "cluster").select("fp", "component_id", "cluster", "_n"))
    # A fingerprint may stand for a third of all documents.
    return join_counted(table, named, "fp", "_n", table.count()).select(*keep, "fp", "component_id", "cluster")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of equal ids the first read.

    Rows without an id stand behind those with one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # Texts are written once, within their rows.
    numbered = cut(docs.select(row, F.monotonically_increasing_id().alias("_uid")))
    given = numbered.select("_uid", F.col("_row")["doc_id"].alias("doc_id"), F.col("_row")["text"].alias("text"))
    found = components(given, ("_uid", "doc_id"), max_bits, shingle_words)
    best = found.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")).alias("best"))
    return numbered.join(best.select("best._uid"), "_uid", "left_semi").select("_row.*")
