"""Training-order materialisation: token ids in binary shards.

Documents become ids and the ids of each partition one stream, cut into
sequences of a fixed length. A keyed Feistel network permutes the numbers of all
sequences: it works on the next even power of two, and a result beyond the last
sequence walks on through the network until it falls inside. So every sequence
has a global slot, known from its number alone, and the order can be rebuilt or
resumed from the key.

Ranges of slots are shards. A shard is a file of records of one size, in slot
order: slot ``s`` lies in shard ``s // per_shard`` at byte ``(s % per_shard) *
length * 2``, so a reader starts anywhere with one seek and reads on. A shard is
written under a temporary name, then renamed; a repeated task writes the same
bytes, and a shard that is already whole is not written again. Checksums in a
folder beside the shards tell that, so that a folder that was filled under
another key or from other texts is written anew.

Ids are unsigned 16-bit little-endian numbers. The last sequence of a partition
is filled up with the end id; ``n_ids`` says how many ids are its own.

Defined results: null and empty texts are an end id alone; texts of any length
run on over sequences; repeated rows and null ids are written one by one; an
empty table gives no shard. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import slices, text_of
from namesake.llm.tokencount import VOCABULARY
from namesake.llm.transducer import tokenizer
from namesake.session import _file_system, scratch, shared_dir

LENGTH = 1024
END_ID = 2
#: Records read at once, at most.
RECORDS_READ = 512
#: Sequences in a shard: 8 MB at this length.
PER_SHARD = 4096
KEY = 20_240_607
ROUNDS = 6
SLICE = 1_000_000


def _round(x: np.ndarray, key: int) -> np.ndarray:
    h = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def permute(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each number below ``n`` (or, inversely, the number of each slot)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [zlib.crc32(f"{key}/{r}".encode()) << 32 | zlib.crc32(f"{r}/{key}".encode()) for r in range(ROUNDS)]
    out = np.asarray(numbers, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> width, out[walking] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_round(left, k) & mask), left
            else:
                left, right = right, left ^ (_round(right, k) & mask)
        out[walking] = left << width | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def sequences(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(part, at, n_ids, doc_ids, ids): the sequences of each partition's stream, numbered from 0."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select("doc_id", text_of().alias("_text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokenizer(path), TaskContext.get().partitionId()
        held, owners, made, schema = np.zeros(0, np.uint16), [], 0, None

        def rows(stream: np.ndarray, spans: list, first: int, own: int) -> pa.RecordBatch:
            """Whole sequences of ``stream``; ``spans`` are (document, start, end) in it."""
            count = len(stream) // length
            lists: list[list] = [[] for _ in range(count)]
            for doc, a, b in spans:
                for k in range(a // length, min(count, -(-b // length))):
                    lists[k].append(doc)
            raw = stream.astype("<u2").tobytes()
            sizes = [min(length, own - k * length) for k in range(count)]
            return pa.RecordBatch.from_arrays([
                pa.array([part] * count, pa.int64()), pa.array(range(first, first + count), pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(lists, schema.field("doc_ids").type), pa.array([raw[2 * k * length : 2 * (k + 1) * length] for k in range(count)], pa.binary()),
            ], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("part", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int32()),
                ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("ids", pa.binary()),
            ])
            texts, keys = batch.column("_text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                flat, offsets = words.ids(texts[a:b])
                # An end id after each document.
                joined = np.insert(flat, offsets[1:], end_id)
                edges = offsets + np.arange(len(offsets)) + len(held)
                spans = owners + [(keys[a + i], int(edges[i]), int(edges[i + 1])) for i in range(b - a)]
                stream = np.concatenate([held, joined])
                whole = len(stream) // length * length
                if whole:
                    yield rows(stream[:whole], spans, made, whole)
                    made += whole // length
                held = stream[whole:].copy()
                owners = [(d, max(0, s - whole), e - whole) for d, s, e in spans if e > whole]
        if len(held):
            filled = np.full(length, end_id, np.uint16)
            filled[: len(held)] = held
            yield rows(filled, owners, made, len(held))

    return narrow.mapInArrow(run, f"part long, at long, n_ids int, doc_ids array<{kind}>, ids binary")


def write_shards(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, str]:
    """Writes the shards; returns (index, folder).

    The index has a row per sequence: slot, sequence_no, shard, byte_offset,
    n_ids, doc_ids.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    # A folder of our own is removed when the session ends.
    folder = folder or scratch(spark, "shards") + "/data"
    staged = f"{base}/sequences-{uuid.uuid4().hex}"
    # Ids take three quarters of their room this way.
    sequences(docs, length).write.option("compression", "zstd").parquet(staged)
    table = spark.read.parquet(staged)
    starts, total = [], 0
    # One number for each partition of the scan.
    for r in table.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "part long, _start long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the sequences of a batch that go to one shard; their ids travel compressed together."""
        pressed = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = permute(batch.column("sequence_no").to_numpy(), total, key)
            order = np.argsort(slot, kind="stable")
            batch, slot = batch.take(pa.array(order)), slot[order]
            shard = slot // per_shard
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            bounds = pa.array(np.append(starts, len(slot)), pa.int32())
            ids = batch.column("ids").to_pylist()
            packed = [pressed.compress(b"".join(ids[a:b])) for a, b in zip(starts, [*starts[1:], len(slot)])]
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(slot), *(batch.column(c) for c in ("sequence_no", "n_ids", "doc_ids")))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), *lists, pa.array(packed, pa.binary())], names=["shard", "slot", "sequence_no", "n_ids", "doc_ids", "ids"])

    kind = table.schema["doc_ids"].dataType.simpleString()
    numbered = table.join(F.broadcast(offsets), "part").select((F.col("_start") + F.col("at")).alias("sequence_no"), "n_ids", "doc_ids", "ids")
    placed = numbered.mapInArrow(place, f"shard long, slot array<long>, sequence_no array<long>, n_ids array<int>, doc_ids array<{kind}>, ids binary")
    write = _shard_writer(folder, length * 2, per_shard)
    index = placed.groupBy("shard").applyInArrow(write, f"slot long, sequence_no long, shard long, byte_offset long, n_ids int, doc_ids {kind}")
    listed = f"{base}/index-{uuid.uuid4().hex}"
    index.write.parquet(listed)
    for path, now in ((staged, True), (listed, False)):
        target, system = _file_system(spark, path)
        system.delete(target, True) if now else system.deleteOnExit(target)
    return spark.read.parquet(listed), folder


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _holds(system, path: str, data: bytes) -> bool:
    if system.get_file_info(path).size != len(data):
        return False
    with system.open_input_file(path) as source:
        return source.read() == data


def _replace(system, path: str, data: bytes | None) -> None:
    """Puts a file in place as a whole, or removes it."""
    part = f"{path}.{uuid.uuid4().hex}"
    if data is not None:
        with system.open_output_stream(part) as out:
            out.write(data)
    if system.get_file_info(path).size is not None:
        system.delete_file(path)
    if data is not None:
        system.move(part, path)


def _shard_writer(folder: str, stride: int, per_shard: int):
    def write(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        slot, number, n_ids, docs = (pc.list_flatten(table.column(c)).combine_chunks() for c in ("slot", "sequence_no", "n_ids", "doc_ids"))
        order = np.argsort(slot.to_numpy(), kind="stable")
        shard = table.column("shard")[0].as_py()
        system, path = _open(shard_path(folder, shard))
        opened = zstandard.ZstdDecompressor()
        records = np.frombuffer(b"".join(opened.decompress(x) for x in table.column("ids").to_pylist()), np.uint8).reshape(-1, stride)
        data = records[order].tobytes()
        # What a shard holds is told by its checksum, so a folder of another key or other texts is never taken for this one.
        mark, seal = _open(shard_path(f"{folder}-checksums", shard))[1], xxhash.xxh3_128_digest(data)
        if system.get_file_info(path).size != len(data) or not _holds(system, mark, seal):
            for file in (path, mark):
                system.create_dir(file.rpartition("/")[0], recursive=True)
            _replace(system, mark, None)
            _replace(system, path, data)
            _replace(system, mark, seal)
        at = pa.array(order)
        placed = slot.take(at)
        return pa.table({
            "slot": placed, "sequence_no": number.take(at), "shard": pa.repeat(shard, len(order)),
            "byte_offset": pa.array(placed.to_numpy() % per_shard * stride, pa.int64()), "n_ids": n_ids.take(at), "doc_ids": docs.take(at),
        })

    return write


def read_slots(index: DataFrame, folder: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """(slot, ids, ids_crc32) of the sequences of ``index``, read from the shards in order."""
    stride = length * 2

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        system, path = _open(shard_path(folder, table.column("shard")[0].as_py()))
        ids, sums = [], []
        offsets, sizes = table.column("byte_offset").to_numpy(), table.column("n_ids").to_pylist()
        # Records that follow each other are read at once.
        starts = np.flatnonzero((np.diff(offsets, prepend=-1) != stride) | (np.arange(len(offsets)) % RECORDS_READ == 0))
        with system.open_input_file(path) as source:
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(offsets)]):
                source.seek(int(offsets[a]))
                records = source.read(stride * (b - a))
                for k in range(a, b):
                    raw = records[(k - a) * stride : (k - a) * stride + 2 * sizes[k]]
                    sums.append(zlib.crc32(raw))
                    ids.append(raw if with_ids else None)
        return pa.table({"slot": table.column("slot"), "ids": pa.array(ids, pa.binary()), "ids_crc32": pa.array(sums, pa.int64())})

    narrow = index.select("slot", "shard", "byte_offset", "n_ids")
    return narrow.groupBy("shard").applyInArrow(read, "slot long, ids binary, ids_crc32 long")
