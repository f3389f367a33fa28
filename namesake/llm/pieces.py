"""Encoding texts into the ids of a SentencePiece model, and decoding them.

One narrow pass each: no shuffle, nothing sent to the driver. See ``prefixtable``
for the method.

Defined results: null and empty texts have no ids, and no ids (or a null row of
ids) are the empty text; texts of any length are encoded whole; rows are handled
one by one, so repeated rows, ties and null keys stay as they are; an empty table
gives an empty result. A text that holds the space mark itself comes back with
a space in its place, as the model cannot tell them apart. Only the columns named
are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import slices, text_of
from namesake.llm.prefixtable import tokenizer

MODEL = "piece_bpe_32k.model"
#: Code points (or ids) that are handled together.
SLICE = 2_000_000


def _ids_column(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint16), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _apply(rows: DataFrame, keep: Sequence[str], outputs: Sequence[str], path: str) -> DataFrame:
    """``rows`` hold ``_given`` (a text, or ids); adds ``ids`` and ``decoded`` as asked for."""
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            given = batch.column("_given")
            sizes = (pa.compute.list_value_length if pa.types.is_list(given.type) else pa.compute.utf8_length)(given).to_pylist()
            for a, b in slices(sizes, SLICE):
                part, some = batch.slice(a, b - a), given.slice(a, b - a)
                if pa.types.is_list(given.type):
                    ids = [v.values.to_numpy(zero_copy_only=False) for v in some]
                else:
                    ids = [words.encode(t) for t in some.to_pylist()]
                made = {}
                if "ids" in outputs:
                    made["ids"] = _ids_column(ids)
                if "decoded" in outputs:
                    made["decoded"] = pa.array([words.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made.values()], names=[*names, *made])

    narrow = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], "_given")
    kinds = [f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names]
    kinds += [{"ids": "ids array<int>", "decoded": "decoded string"}[o] for o in outputs]
    return narrow.mapInArrow(run, ", ".join(kinds)).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *outputs)


def _keys(rows: DataFrame, keep: Sequence[str]) -> list:
    return [F.col(f"`{c}`") for c in dict.fromkeys(keep)]


def encode(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", model: str | None = None) -> DataFrame:
    """``keep`` and ids: those of the whole text, without begin or end."""
    rows = docs.select(*_keys(docs, keep), text_of(F.col(f"`{text}`")).alias("_given"))
    return _apply(rows, keep, ["ids"], model or public_tokenizers.path(MODEL))


def decode(rows: DataFrame, keep: Sequence[str] = ("doc_id",), ids: str = "ids", model: str | None = None) -> DataFrame:
    """``keep`` and decoded: the text of each row of ids."""
    given = F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>"))
    return _apply(rows.select(*_keys(rows, keep), given.alias("_given")), keep, ["decoded"], model or public_tokenizers.path(MODEL))


def round_trip(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", model: str | None = None) -> DataFrame:
    """``keep``, ids and decoded: both ways in one pass."""
    rows = docs.select(*_keys(docs, keep), text_of(F.col(f"`{text}`")).alias("_given"))
    return _apply(rows, keep, ["ids", "decoded"], model or public_tokenizers.path(MODEL))
