"""Token counts of whole texts by compiled finite-state transducers.

The work is one narrow pass: no shuffle, nothing sent to the driver. See
``transducer`` for the method.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any
length are counted whole; rows are counted one by one, so repeated rows and null
ids stay as they are; an empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesake.llm.common import slices, text_of
from namesake.llm.transducer import tokenizer

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Code points that are scanned together.
SLICE = 2_000_000


def token_counts(docs: DataFrame, keep: Sequence[str] = ("doc_id",), limit: int = TOKEN_LIMIT, vocabulary: str | None = None) -> DataFrame:
    """``keep``, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = [f"_k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], text_of().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE):
                part = batch.slice(a, b - a)
                sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], sizes, pa.array(words.counts(texts[a:b]), pa.int64())],
                    names=[*names, "n_bytes", "n_tokens"],
                )

    kinds = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    counted = narrow.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long")
    return counted.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
