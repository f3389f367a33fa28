"""Scoring texts with a language model learned from the corpus.

Learning has two parts. Counts of all neighbouring subword ids of all training
documents, summed by Spark, give the model's first tables. Then a causal
self-attention model (``attention``) is trained from them in one pass over every
training document, whole and with its start and end. The pass is dealt over rounds
by hash of the row: each scan partition runs its own steps from common parameters
on the documents of the round, the results are averaged by Spark, and the next
round starts from the average. The driver meets parameter tables only, whose size
is fixed.

All texts are scored whole in overlapping windows. Beside the model's score
stands a base: word frequencies with one added. Counts of the most frequent
words (at most HEAD_WORDS) travel to the tasks; the other words of a document
meet their counts in a join.

Words are runs without ASCII white space, A to Z in lower case; each is cut into
subword ids by a fixed public vocabulary, with the space before it, so the row of
ids determines the row of words and the score is a probability of the text. A
text ends with the end id.

Defined results: null and empty texts are the end alone; texts of any length are
scored whole; repeated rows and null ids are scored one by one; without training
documents all tables are even and every word is unknown; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesake.llm import attention
from namesake.llm.common import crc_fold, slices, text_of, written
from namesake.session import cut

PIECES = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
END, START = 2, 1
HEAD_WORDS = 1 << 18
#: Letters of a word that travels or is remembered, at most.
LONGEST = 64
#: Parts of the one pass of training, with an average after each.
ROUNDS = 3
BATCH = 128
SLICE = 1_000_000
#: Entries gathered in a task before they are passed on.
GATHERED = 1_500_000
_SHIFT = 16
_CHUNK = 8192


class Subwords:
    """Ids of words; words seen before are remembered up to a bound, long ones aren't."""

    REMEMBERED = 200_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}

    def pieces(self) -> list[str]:
        return [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        found = {w: array("H", ids or [0]).tobytes() for w, ids in zip(new, self.model.encode(new, num_threads=1) if new else [])}
        parts = [found.get(w) or known[w] for w in words]
        known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
        return np.frombuffer(b"".join(parts), np.uint16).astype(np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 2


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word, text of each word)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), owner[real.to_numpy(zero_copy_only=False)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def corpus_rows(docs: DataFrame, path: str) -> DataFrame:
    """What one reading of ``docs(doc_id, text, held_out)`` gives: rows of documents and rows of counts.

    A document's row has doc_id, held_out, text, ``place``, which is the hash of
    its row, and ``ids``: its ids and its end, two bytes each. Counts are those of
    a scan partition over documents that aren't held out, and have either a word
    or a pair of neighbouring ids across words. ``pair`` is the earlier id times
    65536 plus the later; the pair -1 counts documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ids_of(batch: pa.RecordBatch, flat: np.ndarray, sizes: np.ndarray) -> pa.Table:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 2
        ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u2"))])
        own = {name: batch.column(name) for name in ("doc_id", "held_out", "text", "place")}
        return pa.table({"word": pa.nulls(len(ids), pa.string()), "pair": pa.nulls(len(ids), pa.int64()), "n": pa.nulls(len(ids), pa.int64()), **own, "ids": ids})

    def counts_of(table: dict, schema: pa.Schema) -> pa.Table:
        size = len(table["n"])
        either = {"word": pa.nulls(size, pa.string()), "pair": pa.nulls(size, pa.int64()), **table}
        others = {name: pa.nulls(size, schema.field(name).type) for name in ("doc_id", "held_out", "text", "place")}
        return pa.table({**either, **others, "ids": pa.nulls(size, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_words, documents = subwords(path), 0
        tables: list[pa.Table] = []
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            if tables:
                t = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
                yield from counts_of({"word": t["word"], "n": t["n_sum"]}, batch.schema).to_batches(100_000)
            if keys:
                k, n = _summed(keys, sums)
                yield from counts_of({"pair": pa.array(k), "n": pa.array(n)}, batch.schema).to_batches(100_000)
            tables.clear(), keys.clear(), sums.clear()

        for batch in batches:
            text, learnt = batch.column("text"), ~batch.column("held_out").to_numpy(zero_copy_only=False)
            documents += int(learnt.sum())
            for a, b in slices(pc.utf8_length(text).to_pylist(), SLICE):
                words, index, owner = split_words(text.slice(a, b - a))
                ids, n = cut_words.words(words)
                yield from ids_of(batch.slice(a, b - a), *_text_ids(ids, n, index, owner, b - a, end=True)).to_batches()
                texts, kept = int(learnt[a:b].sum()), learnt[a:b][owner]
                index, owner = index[kept], owner[kept]
                if not len(index):
                    keys.append(np.array([START << _SHIFT | END]))
                    sums.append(np.array([texts]))
                    continue
                times = np.bincount(index, minlength=len(words))
                tables.append(pa.table({"word": pa.array(words, pa.string()), "n": times}).filter(pa.array(times > 0)))
                ends = np.cumsum(n)
                first, last = ids[ends - n][index], ids[ends - 1][index]
                fresh = np.diff(owner, prepend=-1) != 0
                left = np.concatenate([np.where(fresh, START, np.concatenate([[0], last[:-1]])), last[np.append(fresh[1:], True)]])
                right = np.concatenate([first, np.full(fresh.sum(), END)])
                k, c = np.unique(left.astype(np.int64) << _SHIFT | right, return_counts=True)
                keys.append(np.append(k, START << _SHIFT | END))
                sums.append(np.append(c, texts - fresh.sum()))
                if sum(map(len, tables)) + sum(map(len, keys)) > GATHERED:
                    yield from passed_on()
        if documents:
            yield from passed_on()
            yield from counts_of({"pair": pa.array([-1], pa.int64()), "n": pa.array([documents], pa.int64())}, batch.schema).to_batches()

    return docs.select("doc_id", "held_out", text_of().alias("text"), _place()).mapInArrow(
        run, f"word string, pair long, n long, doc_id {kind}, held_out boolean, text string, place long, ids binary"
    )


def _place() -> Column:
    """The hash of a document's row, which names its round."""
    return F.xxhash64(F.col("doc_id").cast("string"), text_of()).alias("place")


def counts_in(rows: DataFrame) -> DataFrame:
    """(word, pair, n) from ``corpus_rows``."""
    return rows.filter(F.col("n").isNotNull()).groupBy("word", "pair").agg(F.sum("n").alias("n"))


def corpus_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, pair, n): counts of words, and of neighbouring ids across words, as in ``corpus_rows``, over all of ``docs``."""
    return counts_in(corpus_rows(docs.withColumn("held_out", F.lit(False)), path))


def pair_counts(counts: DataFrame, path: str) -> DataFrame:
    """(prev, next, n): all neighbouring ids, those across words and those within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_words = subwords(path)
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            ids, n = cut_words.words(batch.column("word").to_pylist())
            if len(ids) < 2:
                continue
            weight = np.repeat(batch.column("n").to_numpy(), n)
            within = np.ones(len(ids), bool)
            within[np.cumsum(n) - n] = False
            at = np.flatnonzero(within)
            key, inverse = np.unique(ids[at - 1].astype(np.int64) << _SHIFT | ids[at], return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(inverse, weight[at], len(key)))
            if sum(map(len, keys)) > GATHERED:
                keys, sums = ([x] for x in _summed(keys, sums))
        key, total = _summed(keys, sums)
        yield from pa.table({"pair": key, "n": total}).to_batches(100_000)

    inside = counts.filter(F.col("word").isNotNull()).select("word", "n").mapInArrow(run, "pair long, n long")
    whole = inside.unionByName(counts.filter("pair >= 0").select("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n"))
    return whole.select(F.shiftright("pair", _SHIFT).cast("int").alias("prev"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int").alias("next"), "n")


def first_tables(pairs: DataFrame, path: str) -> tuple[attention.Inventory, dict[str, np.ndarray]]:
    """Inventory and first tables from a written table of pair counts."""
    spark = pairs.sparkSession
    pieces = subwords(path).pieces()
    begins = np.array([p.startswith("▁") or i == END for i, p in enumerate(pieces)])
    letters = np.array([len(p.lstrip("▁")) for p in pieces])
    counts = np.zeros(len(pieces))
    # One row for each id of the vocabulary.
    for r in pairs.groupBy("next").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["next"]] = r["n"]
    inv = attention.inventory(counts, begins, letters, [END])
    place = spark.createDataFrame(
        [(i, int(inv.start if i == START else inv.row[i]), int(inv.outcome[i])) for i in range(len(pieces))], "id int, row int, outcome int"
    )
    left = F.broadcast(place.select(F.col("id").alias("prev"), "row"))
    right = F.broadcast(place.select(F.col("id").alias("next"), "outcome"))
    # At most a row for each pair of the model's rows and outcomes.
    t = pairs.join(left, "prev").join(right, "next").groupBy("row", "outcome").agg(F.sum("n").alias("n")).toArrow()
    prev, nxt, n = (t[c].to_numpy() for c in ("row", "outcome", "n"))
    order = np.lexsort((nxt, prev))
    return inv, attention.tables_from_counts(prev[order], nxt[order], n[order].astype(float), counts[END], inv)


def whole_texts(text: pa.Array, cut_words: Subwords, most: int = SLICE // 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, sizes) of runs of texts: every id of every text, and its end."""
    for a, b in slices(pc.utf8_length(text).to_pylist(), most):
        words, index, owner = split_words(text.slice(a, b - a))
        yield _text_ids(*cut_words.words(words), index, owner, b - a, end=True)


def read_bytes(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, sizes) from two bytes for each id."""
    return np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype(np.int32), pc.binary_length(ids).to_numpy().astype(np.int64) // 2


def read_ids(table: DataFrame, path: str) -> DataFrame:
    """(place, ids) of ``table(doc_id, text)``, as in ``corpus_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_words = subwords(path)
        for batch in batches:
            at = 0
            for flat, sizes in whole_texts(batch.column("text"), cut_words):
                texts = np.split(flat.astype("<u2"), np.cumsum(sizes)[:-1])
                ids = pa.array([t.tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("place").slice(at, len(sizes)), ids], names=["place", "ids"])
                at += len(sizes)

    return table.select(text_of().alias("text"), _place()).mapInArrow(run, "place long, ids binary")


def train_attention(spark, table: DataFrame, inv: attention.Inventory, tables: dict[str, np.ndarray], path: str, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """One pass of training over ``table(place, ids)`` in rounds, averaged in between.

    Each text is trained on whole, in the round that the hash of its row names.
    A table of ``doc_id`` and ``text`` is cut into ids first.
    """
    if "ids" not in table.columns:
        table = written(read_ids(table, path))
    turn = F.pmod("place", F.lit(rounds))
    params = attention.fresh(tables, inv)
    shapes = {n: x.shape for n, x in params.items()}
    fixed = spark.sparkContext.broadcast((inv, tables["near"]))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, near = fixed.value
            trainer = attention.Trainer(sent.value, near, known, batch=BATCH)
            for batch in batches:
                ids = batch.column("ids")
                for a, b in slices(pc.binary_length(ids).to_pylist(), SLICE // 2):
                    trainer.learn(*read_bytes(ids.slice(a, b - a)))
            if trainer.windows:
                for name, x in trainer.params().items():
                    values = x.reshape(-1)
                    for c in range(0, len(values), _CHUNK):
                        yield pa.RecordBatch.from_pylist([{"name": name, "chunk": c, "weight": float(trainer.windows), "value": values[c : c + _CHUNK].tolist()}], schema=_PARTS)

        parts = table.filter(turn == number).select("ids").mapInArrow(run, "name string, chunk int, weight double, value array<float>")
        mean = parts.groupBy("name", "chunk").applyInArrow(_average, "name string, chunk int, weight double, value array<float>").toArrow()
        if not len(mean):
            # No text's hash names this round.
            continue
        got = {n: np.zeros(int(np.prod(s)), np.float32) for n, s in shapes.items()}
        for name, c, value in zip(mean["name"].to_pylist(), mean["chunk"].to_pylist(), mean["value"]):
            x = value.values.to_numpy()
            got[name][c : c + len(x)] = x
        params = {n: got[n].reshape(s) for n, s in shapes.items()}
        sent.unpersist()
    return params


_PARTS = pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("weight", pa.float64()), ("value", pa.list_(pa.float32()))])


def _average(table: pa.Table) -> pa.Table:
    """Mean of one stretch of parameters, weighted by the windows behind it."""
    order = np.argsort(table["weight"].to_numpy(), kind="stable")
    weight = table["weight"].to_numpy()[order]
    total = 0.0
    for w, i in zip(weight, order):
        total = total + w * table["value"][int(i)].values.to_numpy().astype(np.float64)
    mean = (total / weight.sum()).astype(np.float32)
    return pa.Table.from_pylist([{"name": table["name"][0].as_py(), "chunk": table["chunk"][0].as_py(), "weight": float(weight.sum()), "value": mean.tolist()}], schema=_PARTS)


def _text_ids(ids: np.ndarray, n: np.ndarray, index: np.ndarray, owner: np.ndarray, texts: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, sizes) from ids of distinct words and the words' order."""
    first = np.cumsum(n) - n
    size = n[index]
    upto = np.cumsum(size)
    take = np.repeat(first[index] - (upto - size), size) + np.arange(int(size.sum()))
    flat = ids[take] if len(take) else np.zeros(0, np.int32)
    sizes = np.bincount(owner, size, texts).astype(np.int64)
    if end:
        flat = np.insert(flat, np.cumsum(sizes), END)
        sizes = sizes + 1
    return flat, sizes


def head_counts(words: DataFrame, most: int = HEAD_WORDS) -> dict[str, int]:
    """Counts of the most frequent words: all above a bound that at most ``most`` words exceed.

    Words of more than LONGEST letters are left to the join.
    """
    words = words.filter(F.char_length("word") <= LONGEST)
    band = F.floor(F.log2(F.col("n")) * 8).cast("int")
    bands = words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()
    left, bound = most, None
    for r in sorted(bands, key=lambda r: -r["band"]):
        left -= r["n"]
        if left < 0:
            break
        bound = r["band"]
    if bound is None:
        return {}
    t = words.filter(band >= bound).select("word", "n").toArrow()
    return dict(zip(t["word"].to_pylist(), t["n"].to_pylist()))


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark, path = docs.sparkSession, path or public_tokenizers.path(PIECES)
    # Texts are cut into ids once for counts, training and scores.
    rows = written(corpus_rows(docs.select("doc_id", "text", (crc_fold(FOLDS) == HELD_OUT).alias("held_out")), path))
    whole = rows.filter(F.col("place").isNotNull())
    counts = cut(counts_in(rows))
    words = counts.filter(F.col("word").isNotNull()).select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = counts.filter("pair = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens, kinds = total + texts, distinct + (texts > 0)
    inv, tables = first_tables(cut(pair_counts(counts, path)), path)
    params = train_attention(spark, whole.filter(~F.col("held_out")).select("place", "ids"), inv, tables, path)
    head = head_counts(words)
    shipped = spark.sparkContext.broadcast((inv, tables["near"], params, head))
    unit = float(np.log10(train_tokens + kinds + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, near, trained, frequent = shipped.value
        model = attention.Model(trained, near, known)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(pc.utf8_length(text).to_pylist(), SLICE):
                m = b - a
                distinct, index, owner = split_words(text.slice(a, m))
                own = np.fromiter((frequent.get(w, -1) for w in distinct), np.int64, len(distinct))
                seen = own[index]
                base = np.bincount(owner, np.log10(np.maximum(seen, 0) + 1.0), m) + np.log10(texts + 1.0)
                n = np.bincount(owner, minlength=m) + 1
                n_known = np.bincount(owner[seen > 0], minlength=m) + int(texts > 0)
                # Words beyond the frequent ones, each once per text with its number.
                rare = seen < 0
                key, times = np.unique(owner[rare] * max(1, len(distinct)) + index[rare], return_counts=True)
                bounds = np.searchsorted(key // max(1, len(distinct)), np.arange(m + 1)).astype(np.int32)
                values = pa.array(distinct, pa.string()).take(pa.array(key % max(1, len(distinct))))
                flat, sizes = read_bytes(batch.column("ids").slice(a, m))
                w = attention.windows(flat, sizes, known, start=True)
                total_log = np.bincount(w.text, model.log_scores(w).sum(axis=1), m) / np.log(10)
                part = batch.slice(a, m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(m)), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base - n * unit), pa.array(total_log),
                    pa.ListArray.from_arrays(bounds, values), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64())),
                ], names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])
                number += m

    made = cut(whole.select("doc_id", "held_out", "text", "ids").mapInArrow(
        run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<string>, times array<long>"
    ))
    pairs = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("_x")).select("uid", F.col("_x.rare").alias("word"), F.col("_x.times").alias("times"))
    # Words that training never met add nothing and find no partner here.
    more = pairs.join(words, "word").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("also")
    )
    return made.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
