"""From raw documents to an encoded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it decides takes
effect on its rows. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe_tree, common, mixing, pii, quality, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the CRF calls good; the rejected ones go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one_per_group(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a run in part."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed document."""
    return bpe_tree.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=True).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", redact_pii), ("mix", mix_sources), ("bpe", encode)]

#: The classifier, the signatures and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to shared storage and read again.

    A stage's table goes once the next one is written; that of the last stage but one stays, since the
    result reads it.
    """
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            common.remove(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
