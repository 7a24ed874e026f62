import random

import numpy as np
import pytest

from ledgerloom.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every=50, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("query_block", [1, 3, 4096])
def test_against_brute_force(spark, monkeypatch, query_block):
    rng = random.Random(query_block)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)], "s") for i in range(300)]
    rows += [(400 + i, rows[i % 7][1], "copy") for i in range(60)]  # ties
    rows += [(50, rows[3][1], "again"), (1000, None, ""), (1001, [0.1, None], ""), (1050, [float("nan")] * 40, ""), (1100, [0.5] * 3, ""), (None, [0.1] * 40, ""), (1101, [float("inf")] * 40, ""), (1150, [], "")]
    got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), query_block=query_block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_pruning_is_exact_on_skewed_vectors():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(3000, 64)) * 256 * np.linspace(3, 0.01, 64))
    block = K.Block(np.arange(3000), rows)
    for q in range(0, 3000, 300):
        ids, scores = K.best(*block.search(rows[q], q, 5, -np.inf), 5)
        full = rows @ rows[q]
        full[q] = -np.inf
        assert (scores == np.sort(full)[::-1][:5]).all()


@pytest.mark.parametrize("size", [1e4, 1e6, 3e7])
def test_large_components_are_exact(spark, size):
    rng = random.Random(int(size))
    rows = [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(24)], "s") for i in range(220)]
    rows += [(300 + i, rows[0][1], "copy") for i in range(7)]
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows)]
    got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    if max(abs(w[3]) for w in want) < 2**63 - 1:
        assert sorted(map(tuple, got)) == want
    else:  # saturated scores tie
        assert sorted((g.query_id, g["rank"], g.score) for g in got) == [(w[0], w[1], w[3]) for w in want]


@pytest.mark.parametrize("size", [1e7, 1e8, 1e9])
def test_pruning_by_doubles_keeps_the_exact_best(size):
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(2000, 48)) * size * np.linspace(3, 0.01, 48))
    rows[100:160] = rows[5] + rng.integers(-2, 3, (60, 48))  # scores that differ in their last digits only
    block = K.Block(np.arange(2000), rows)
    for q in (0, 5, 100, 1500):
        ids, scores = K.best(*block.search(rows[q], q, 5, -np.inf), 5)
        full = sorted((-min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(rows[q], r))), i) for i, r in enumerate(rows) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == full


def test_scores_beyond_a_long_saturate(spark):
    rows = [(50, [1e20, 1.0], ""), (3, [1e20, 0.0], ""), (2, [1e30, 0.0], ""), (4, [-1e20, 5.0], ""), (5, [0.0, 2.0], "")]
    got = [tuple(r) for r in K.top_k(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(50, 1, 2, 2**63 - 1), (50, 2, 3, 2**63 - 1), (50, 3, 5, 256 * 512), (50, 4, 4, -(2**63))]


def test_empty(spark):
    assert K.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert K.top_k(spark.createDataFrame([(50, [1.0], "")], SCHEMA)).collect() == []
