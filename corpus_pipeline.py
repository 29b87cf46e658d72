"""Documents to packed training sequences: toxicity, line dedup, near-duplicates, decontamination, packing.

Every stage but the last returns rows of its input with the columns of its input.  Nulls and blank texts are documents
without words: they are kept as they are, and packed as their end alone.  Rows that share an id go or stay together in
near-duplicates and decontamination; a row without an id is never a duplicate.  Ties go to the smaller id.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, line_dedup, minhash_forest, packing, toxicity
from plumbline.llm.catalog import VOCABULARY, table
from plumbline.llm.storage import ARROW_BATCH, ARROW_BYTES, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic; the model learns from labelled ones among those that are given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier, and without documents that lose all their words by it."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of 75 % similarity connect."""
    return minhash_forest.drop_near_documents(docs, 75)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item, or a whole shorter one."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is, in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), 2048, 0)


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that hands Python workers a few megabytes at a time, for whole texts differ much in size."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BYTES, ARROW_BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("line dedup", in_small_batches(drop_repeated_lines)),
    ("near-duplicates", in_small_batches(drop_near_duplicates)),
    ("decontamination", in_small_batches(drop_contaminated)),
    ("packing", in_small_batches(pack)),
]

# no stage but decontamination can be expressed in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``; each stage's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
