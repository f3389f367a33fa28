"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept and each calling one
operator: the quality classifier drops what it rejects, the quality rules drop
failures and outliers, of each group of documents linked by SimHash (three-word
shingles, at most two differing bits) one stays, the mix reads sources to their
target weights in training order, and packing lays the ids of the result into
sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it again as the next ``docs``.

Defined results, by stage: null and empty texts are scored as texts of no words
by the classifier, rejected by the rules (fewer than 50 words), linked with each
other by the near-duplicate stage if it is given any, not read by the mix, and
one end id in packing. Texts of any length are handled whole. Repeated rows are
rows of their own until the near-duplicate stage, which keeps one of them. Null
ids, languages and sources are kept. Of a tie (equal fingerprints) the smallest
doc_id stays, of equal ids the first row read. An empty table gives an empty
result, and without labels the classifier rejects nothing. Stages carry whole rows in one
struct, so columns of any name survive unchanged.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from namesake.llm import mixing, outliers, packing, quality, simhash
from namesake.llm.common import documents
from namesake.session import WRITTEN, cut, remove

# Models and groups cannot be said in SQL: the stages are tested against brute force.
ORACLE_SQL = None


#: Tables that the stages so far have written for themselves.
_OWN: list[str] = []


def alone(stage):
    """A stage that first removes what the stages before it wrote for themselves.

    Their results are written and read again by then, so nothing needs those
    tables; they stay if ``docs`` was handed over unwritten and still reads one.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _OWN and not any(own in f for f in docs.inputFiles() for own in _OWN):
            for path in _OWN:
                remove(spark, path)
            _OWN.clear()
        before = set(WRITTEN)
        result = stage(spark, docs, sf_dir)
        _OWN.extend(p for p in WRITTEN if p not in before)
        return result

    return run_stage


@alone
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@alone
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.kept_documents(docs)


@alone
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, max_bits=simhash.MAX_BITS, shingle_words=simhash.SHINGLE_WORDS)


@alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs, cut_last=True)


@alone
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
