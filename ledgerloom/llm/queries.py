"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, host_rules, lm_score, mixing, pii, quality, topk, toxicity, whitening
from .bpe_tree import bpe_encode
from .common import table
from .minhash import fingerprint_pairs
from .simhash import simhash_components
from .token_count import count_tokens


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; see ``toxicity``."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; see ``token_count``."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; see ``lm_score``."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document; see ``simhash``."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; see ``minhash``."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; see ``pii``."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see ``mixing``."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; see ``bpe_tree``."""
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; see ``quality``."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector; see ``topk``."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector; see ``whitening``."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document; see ``host_rules``."""
    ruled = host_rules.apply_host_rules(table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document under two tokenizers; see ``alignment``."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_lm_score, op4_simhash_dedup, op5_minhash_fingerprints, op6_pii_crf, op7_source_mixing, op8_bpe_encode, op9_line_quality, op10_exact_topk, op11_whitening, op12_host_rules, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": mixing.SQL, "op10_exact_topk": topk.SQL, "op12_host_rules": host_rules.SQL}
