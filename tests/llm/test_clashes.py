"""Extra columns that bear the operators' own names change nothing."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, bpe_tree, host_rules, lm_score, minhash, token_count, topk, whitening

CLASHING = ["n_tokens", "n_bytes", "over_limit", "ids", "decoded", "levels", "text_key", "score", "h", "k", "bucket", "extra", "row", "block", "no", "piece", "pid", "groups", "n_words", "host", "_host", "rate", "verdict", "query_id", "rank", "component", "n", "dim", "v", "width"]
TEXTS = ["a b c", "", None, "Hello, world! " * 30, "a b c"]


def rows_of(df):
    return sorted(map(str, df.collect()))


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").coalesce(1)


OPERATORS = {
    "tokens": lambda d: token_count.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "bpe": lambda d: bpe_tree.bpe_encode(d, public_tokenizers.path("word_bpe_49k.json"), keep=True),
    "lm": lambda d: lm_score.score_documents(d),
    "minhash": lambda d: minhash.fingerprint_pairs(d),
    "hosts": lambda d: host_rules.apply_host_rules(d),
    "alignment": lambda d: alignment.align(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_documents(docs, name):
    assert rows_of(OPERATORS[name](with_clashes(docs))) == rows_of(OPERATORS[name](docs))


def test_vectors(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)], "vec_id long, embedding array<double>").coalesce(1)
    assert rows_of(topk.top_k(with_clashes(df))) == rows_of(topk.top_k(df))
    numbers = lambda d: sorted((r.vec_id, r.component, r.n, r.deviation) for r in whitening.whiten(d).collect())
    assert numbers(with_clashes(df)) == numbers(df)


def test_places_among_bounds(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        bounds = sorted({(int(k), int(h)) for k, h in zip(rng.integers(-5, 5, n), rng.integers(-(2**62), 2**62, n))})
        points = [(int(k), int(h)) for k, h in zip(rng.integers(-6, 6, 50), rng.integers(-(2**62), 2**62, 50))] + bounds[:20] + [(-(2**63), -(2**63)), (2**63 - 1, 2**63 - 1)]
        df = spark.createDataFrame(points, "k long, h long").withColumn("place", minhash.place_among(F.struct("k", "h"), bounds))
        assert all(r.place == sum(b <= (r.k, r.h) for b in bounds) for r in df.collect())


def test_digest_is_that_of_the_groups(docs):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    plain = {r.doc_id: r.groups for r in alignment.align(docs, *paths).collect()}
    assert {r.doc_id: r.groups_sha256 for r in alignment.align(docs, *paths, digest=True).collect()} == {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in plain.items()}
