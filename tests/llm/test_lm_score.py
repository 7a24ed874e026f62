import collections
import math
import random

import numpy as np
import pytest

from ledgerloom.llm import lm_score as L
from ledgerloom.llm.common import WordHashes, doc_bucket_py

SCHEMA = "doc_id long, text string, score string"


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def base(rows):
    c = collections.Counter()
    for d, t, _ in rows:
        if d is None or doc_bucket_py(d, 5) != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t, _ in rows]


def rows_of(seed, n=150):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    rows = [(i, rng.choice([" ", "\n", "\x0b "]).join(rng.choices(voc, weights=[1 / (1 + i) for i in range(300)], k=rng.randint(0, 80))), "x") for i in range(n)]
    return rows + [(2, rows[2][1], "again"), (None, "null Id", ""), (901, None, ""), (902, "", ""), (903, "big " * 50_000, ""), (904, "É é WORD word", "")]


@pytest.mark.parametrize("most_words", [L.MOST_WORDS, 0])
def test_base_scores_by_broadcast_and_by_join(spark, most_words):
    rows = rows_of(1)
    got = L.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), most_words=most_words).collect()
    n, want = base(rows)
    key = lambda r: (str(r[0]), r[1], round(r[3], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score <= 0 and r.held_out == (r.doc_id is not None and doc_bucket_py(r.doc_id, 5) == 1) for r in got)


def test_counts_read_back_from_the_filter():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = np.minimum(rng.zipf(1.6, 20_000), 10**6)
    bits, keys = L.build_filter(hashes, counts, 2**31)
    bloom = L.LogBloom([(0, bits.tobytes())], 1, 1, 1)
    level = bloom.level(hashes)
    assert keys == L.levels(counts).sum() and (level >= L.levels(counts)).all() and (level == L.levels(counts)).mean() > 0.98
    assert (bloom.level(rng.integers(0, 2**63, 50_000).astype(np.uint64)) > 0).mean() < 0.01
    small, _ = L.build_filter(hashes, counts, 4096)
    assert len(small) == 512 and (L.LogBloom([(0, small.tobytes())], 1, 1, 1).level(hashes) >= L.levels(counts)).all()


def test_quantised_values_are_close():
    c = np.array([1, 2, 3, 4, 5, 7, 10, 100, 12345, 10**6, 10**9])
    assert (np.abs(np.log(L.VALUE[L.levels(c)] / c)) < np.log(1.5)).all() and L.VALUE[L.levels(np.array([1]))][0] == 1


def test_seen_passages_score_higher_than_shuffled_ones(spark):
    rng = random.Random(6)
    voc = [f"w{i}" for i in range(500)]
    text = " ".join(rng.choices(voc, k=400))
    train = [i for i in range(100) if doc_bucket_py(i, 5) != 1]
    held = [i for i in range(100) if doc_bucket_py(i, 5) == 1]
    mixed = text.split()
    rng.shuffle(mixed)
    rows = [(i, text, "") for i in train] + [(held[0], text, ""), (held[1], " ".join(mixed), "")]
    got = {r.doc_id: r for r in L.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 50


def brute_scores(rows):
    """log10 of each text by quantised counts, in plain Python; no filter, so no false positives."""
    one, two = collections.Counter(), collections.Counter()
    for d, t, _ in rows:
        if d is None or doc_bucket_py(d, 5) != 1:
            w = tokens(t)
            one.update(w)
            two.update(zip(["start", *w], w))
    n, v = sum(one.values()), len(one)

    def value(c):
        if c < 2:
            return float(c)
        q = 1
        while c >= 1.5**q:
            q += 1
        return 1.0 if q == 1 else (1.5 ** (q - 1) + 1.5**q) / 2

    out = []
    for d, t, _ in rows:
        total, before = 0.0, "start"
        for w in tokens(t):
            context = value(one[None] if before == "start" else one[before])
            prior = min(1.0, (value(one[w]) + 0.5) / (n + 0.5 * (v + 1)))
            total += math.log10((min(value(two[before, w]), context) + 200.0 * prior) / (context + 200.0))
            before = w
        out.append((str(d), len(tokens(t)), total))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [L.SHARD_BYTES, 2000])
def test_scores_against_brute_force(spark, shard_bytes):
    rows = rows_of(11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in L.score_documents(df, shard_bytes=shard_bytes).collect())
    want = brute_scores(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    close = [abs(g[2] - w[2]) <= 1e-9 * abs(w[2]) for g, w in zip(got, want)]
    # a read above the true level is a false positive of the filter: two reads a token, at most 0.5 % each
    assert np.mean(close) > np.mean([0.995 ** (2 * w[1]) for w in want]) - 0.05
    assert all(abs(g[2] - w[2]) < 0.01 * abs(w[2]) + 0.3 for g, w in zip(got, want))


def test_shards_follow_the_bytes(spark):
    df = spark.createDataFrame(rows_of(11), SCHEMA)
    few, many = L.plan_shards(df, 4), L.plan_shards(df, 4, 1000)
    size = sum(len((t or "").encode()) for _, t, _ in rows_of(11))
    assert few == (4, 4) and many == (-(-size // 1000), -(-many[0] // L.SHARDS_A_TASK))


def test_blocks_sum_over_chunks(spark, monkeypatch):
    rows = rows_of(7)
    blocks = L.count_blocks(spark.createDataFrame(rows, SCHEMA).repartition(5).select("text"), 4)
    total = collections.Counter()
    for b in blocks.where("kind = 0").collect():
        for h, c in zip(*L._unpack(bytes(b.data))):
            total[int(h)] += int(c)
    memo, want = WordHashes(), collections.Counter()
    for _, t, _ in rows:
        want.update([int(memo[w]) if w is not None else int(L.END) for w in tokens(t)])
    assert total == want


def test_empty_tables(spark):
    assert L.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if doc_bucket_py(i, 5) == 1)
    (r,) = L.score_documents(spark.createDataFrame([(held, "only held out", "")], SCHEMA)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("most_words", [L.MOST_WORDS, 0])
def test_scores_and_error_rate_are_the_same_however_little_is_broadcast(spark, monkeypatch, most_words):
    df = spark.createDataFrame(rows_of(9), SCHEMA).repartition(3)
    whole = L.score_documents(df, most_words=most_words).collect()
    seen, build = [], L.build_shards
    monkeypatch.setattr(L, "build_shards", lambda *a: seen.append(build(*a)) or seen[-1])
    got = L.score_documents(df, most_words=most_words, most_filter_bytes=64).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    assert sorted(map(key, got)) == [(*k[:2], pytest.approx(k[2], rel=1e-12)) for k in sorted(map(key, whole))]
    assert L.filter_stats(seen[0]).first().false_positive_rate < 0.005
    assert len(L.groups_of(seen[0], 64)) > 1


def test_a_model_in_many_parts_costs_no_pass_a_part(spark, monkeypatch):
    """Texts are dealt once and written nowhere, however many groups of parts there are; scores and base scores stay."""
    rows = rows_of(12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    rows_ = lambda frame: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect())
    whole = rows_(L.score_documents(df, shard_bytes=2000))
    written, checkpoint = [], L.shared_checkpoint
    monkeypatch.setattr(L, "shared_checkpoint", lambda x: written.append(x.columns) or checkpoint(x))
    monkeypatch.setattr(L, "CHUNK_BYTES", 4000)
    asked = L.score_documents(df, most_filter_bytes=64, shard_bytes=2000)
    assert len(written) == 1 and "text" not in written[0]
    got = rows_(asked)
    assert [g[:4] for g in got] == [w[:4] for w in whole]
    assert all(g[4:] == pytest.approx(w[4:]) for g, w in zip(got, whole))
    assert "ReusedExchange" in asked._jdf.queryExecution().executedPlan().toString()
