"""Packing documents into token sequences with bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document first fills
whole sequences by itself; what is left goes to the open window it fits best.
If it fits none and all windows are in use, the fullest is completed with the
head of the document and emitted, and the rest starts a new window, so no
sequence is padded in the middle of the work. The windows still open at the end
of a partition are merged into one remainder, the remainders of neighbouring
partitions are merged by 64 and again by 64, and the last one is cut into
lengths that are powers of two.

Nothing is shuffled but one remainder, shorter than a sequence, per partition.

Defined results: a null or empty text is the end id alone; a document of any
length is cut into as many pieces as needed; repeated rows and null ids are
packed one by one; an empty table gives no sequence. Only doc_id and text are
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import slices, text_of
from namesake.llm.tokencount import VOCABULARY
from namesake.llm.transducer import tokenizer
from namesake.session import cut

LENGTH = 4096
END_ID = 2
OPEN_WINDOWS = 32
#: Remainders merged by one task.
FAN_IN = 64
SLICE = 1_000_000

# A piece: document id, ids of the document before it, ids, number of the document's ids.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Packs the documents of one partition; ``done`` collects finished sequences."""

    def __init__(self, length: int, open_windows: int) -> None:
        self.length, self.most = length, open_windows
        self.windows: dict[int, list[Piece]] = {}
        #: (room, window) in order of room.
        self.rooms: list[tuple[int, int]] = []
        self.next = 0
        self.done: list[list[Piece]] = []

    def _open(self, piece: Piece) -> None:
        self.windows[self.next] = [piece]
        insort(self.rooms, (self.length - len(piece[2]), self.next))
        self.next += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.done.append([(doc, at, ids[at : at + self.length], total)])
            at += self.length
        if at == total:
            return
        rest = ids[at:].copy()
        fit = bisect_left(self.rooms, (len(rest), -1))
        if fit < len(self.rooms):
            room, w = self.rooms.pop(fit)
            self.windows[w].append((doc, at, rest, total))
            if room == len(rest):
                self.done.append(self.windows.pop(w))
            else:
                insort(self.rooms, (room - len(rest), w))
        elif len(self.rooms) < self.most:
            self._open((doc, at, rest, total))
        else:
            room, w = self.rooms.pop(0)
            self.done.append([*self.windows.pop(w), (doc, at, rest[:room], total)])
            self._open((doc, at + room, rest[room:], total))

    def close(self) -> list[Piece]:
        """Merges the open windows; returns the pieces of the remainder."""
        pieces = [p for w in self.windows.values() for p in w]
        self.windows, self.rooms = {}, []
        full, rest = lay(pieces, self.length)
        self.done += full
        return rest


def lay(pieces: list[Piece], length: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces end to end, cut at every ``length`` ids: whole sequences, and what is left."""
    full, current, used = [], [], 0
    for doc, start, ids, total in pieces:
        while len(ids):
            head = ids[: length - used]
            current.append((doc, start, head, total))
            used, start, ids = used + len(head), start + len(head), ids[len(head) :]
            if used == length:
                full.append(current)
                current, used = [], 0
    return full, current


def _schema(kind: pa.DataType) -> pa.Schema:
    piece = pa.struct([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
    return pa.schema([
        ("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
        ("part", pa.int64()), ("left_pieces", pa.list_(piece)), ("left_ids", pa.binary()),
    ])


def _rows(sequences: list[list[Piece]], first: int, schema: pa.Schema, with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for k, sequence in enumerate(sequences):
        offset = 0
        for doc, start, ids, total in sequence:
            raw = ids.astype("<u4").tobytes()
            for col, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, first + k, offset, raw if with_ids else None)):
                col.append(v)
            offset += len(ids)
    n = len(cols[0])
    arrays = [pa.array(c, f.type) for c, f in zip(cols, schema)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(n, f.type) for f in list(schema)[8:]]], schema=schema)


def _remainder(pieces: list[Piece], part: int, schema: pa.Schema) -> pa.RecordBatch:
    table = [{"doc_id": d, "start": s, "length": len(i), "doc_tokens": t} for d, s, i, t in pieces]
    ids = np.concatenate([i for _, _, i, _ in pieces]).astype("<u4").tobytes()
    row = {"part": part, "left_pieces": table, "left_ids": ids}
    return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in schema}], schema=schema)


def _merger(length: int, base: int, last: bool, with_ids: bool):
    """Merges the remainders of a group of partitions; the last group leaves nothing."""

    def merge(table: pa.Table) -> pa.Table:
        schema = _schema(table.schema.field("doc_id").type)
        table = table.sort_by("part")
        pieces: list[Piece] = []
        group = table.column("part")[0].as_py() // FAN_IN
        for row in table.select(["left_pieces", "left_ids"]).to_pylist():
            ids, at = np.frombuffer(row["left_ids"], "<u4"), 0
            for p in row["left_pieces"]:
                pieces.append((p["doc_id"], p["start"], ids[at : at + p["length"]], p["doc_tokens"]))
                at += p["length"]
        full, rest = lay(pieces, length)
        while last and rest:
            size = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1)
            ended, beyond = lay(rest, size)
            full.append(ended[0])
            rest = [p for s in ended[1:] for p in s] + beyond
        batches = [_rows(full, base + (group << 28), schema, with_ids)]
        if rest:
            batches.append(_remainder(rest, group, schema))
        return pa.Table.from_batches(batches, schema)

    return merge


def pack(docs: DataFrame, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: where a run of a document's ids lies in a sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids themselves (little-endian, 32 bits each).
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select("doc_id", text_of().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, schema = tokenizer(path), Packer(length, open_windows), None
        part = TaskContext.get().partitionId()
        made = 0
        for batch in batches:
            schema = schema or _schema(batch.schema.field("doc_id").type)
            texts, keys = batch.column("_text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                flat, offsets = words.ids(texts[a:b])
                for i in range(b - a):
                    packer.add(keys[a + i], np.append(flat[offsets[i] : offsets[i + 1]], np.uint16(end_id)))
                if packer.done:
                    yield _rows(packer.done, (part << 33) + made, schema, with_ids)
                    made += len(packer.done)
                    packer.done = []
        if schema is not None:
            rest = packer.close()
            if packer.done:
                yield _rows(packer.done, (part << 33) + made, schema, with_ids)
            if rest:
                yield _remainder(rest, part, schema)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, "
        f"left_pieces array<struct<doc_id: {kind}, start: long, length: long, doc_tokens: long>>, left_ids binary"
    )
    packed = cut(narrow.mapInArrow(run, ddl))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    result = packed.filter(F.col("sequence_id").isNotNull()).select(columns)
    left = packed.filter(F.col("part").isNotNull())
    highest = left.agg(F.max("part")).first()[0]
    level = 0
    while highest is not None:
        level += 1
        last = highest < FAN_IN
        merge = _merger(length, (1 << 62) + (level << 56), last, with_ids)
        merged = left.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, ddl)
        if not last:
            merged = cut(merged)
        result = result.unionByName(merged.filter(F.col("sequence_id").isNotNull()).select(columns))
        left = merged.filter(F.col("part").isNotNull())
        highest = None if last else highest // FAN_IN
    return result
