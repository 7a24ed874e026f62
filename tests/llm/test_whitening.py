import numpy as np
import pytest

from ledgerloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def brute(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = (n * x - s) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), d @ u / np.sqrt(e), e / (np.trace(d.T @ d) / n)


def run(spark, rows, parts=3, **more):
    out = {}
    for r in W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts), **more).collect():
        assert 0 <= r.identity_error <= 1e-9
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("width,components", [(12, 32), (40, 8), (160, 6)])
def test_against_eigh(spark, width, components):
    rng = np.random.default_rng(width)
    v = rng.standard_normal((400, width)) * np.linspace(3, 0.5, width) @ np.linalg.qr(rng.standard_normal((width, width)))[0] + rng.standard_normal(width)
    got = run(spark, [(i, list(map(float, x)), "x", 7) for i, x in enumerate(v)], components=components)
    k = min(width, components)
    n, deviation, whitened, explained = brute(v, k)
    assert len(got) == 400 and all(sorted(c) == list(range(1, k + 1)) for c in got.values())
    table = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in range(400)])
    table *= np.sign((table * whitened).sum(0))
    assert np.abs(table - whitened).max() < 1e-7
    assert [got[i][1].deviation for i in range(400)] == deviation.tolist() and got[0][1].n == n
    assert np.allclose([got[0][c].explained for c in range(1, k + 1)], explained, rtol=1e-10)


def test_iterations_certify_and_the_limit_raises(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 90)) * np.geomspace(5, 1, 90)
    rows = spark.createDataFrame([(i, list(map(float, x)), "", 0) for i, x in enumerate(v)], SCHEMA)
    monkeypatch.setattr(W, "MOST_ITERATIONS", 2)
    with pytest.raises(ArithmeticError, match="residual"):
        W.whiten(rows, components=3)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    good = [list(map(float, x)) for x in rng.standard_normal((50, 5))]
    rows = [(i, v, "x", 0) for i, v in enumerate(good)] + [(0, good[0], "again", 0), (None, good[1], "no id", 0)]
    rows += [(100, None, "", 0), (101, [], "", 0), (102, [1.0, None, 0.0, 0.0, 0.0], "", 0), (103, [float("nan")] * 5, "", 0), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0], "", 0), (105, [1.0] * 4, "narrow", 0)]
    result = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(result) == 52 * 5 and {r.vec_id for r in result} == {None, *range(50)} and {r.n for r in result} == {52}


def test_no_variance(spark):
    empty = lambda rows: W.whiten(spark.createDataFrame(rows, SCHEMA)).count()
    assert empty([]) == 0 and empty([(1, [0.5, 2.0], "", 0)]) == 0 and empty([(i, [0.5, 2.0], "", 0) for i in range(9)]) == 0
    flat = W.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 1.0], "", 0) for i in range(20)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1}  # one direction holds all variance


def test_sums_and_deviations_beyond_doubles():
    x = np.array([[2**61 + 1, 5], [3, 7], [2**61, -(2**61)]], np.int64)
    c = W.Centred(3, [int(v) for v in x.astype(object).sum(0)])
    want = [[3 * int(a) - s for a, s in zip(row, c.sums)] for row in x]
    assert c.exact(x).tolist() == want and c.deviation(x).tolist() == [min(2**63 - 1, sum(v * v for v in row)) for row in want]
    y = np.array([[40_000_000, 1]] * 2 + [[-(10**9), 0]], np.int64)
    small = W.Centred(3, [int(v) for v in y.sum(0)])
    assert small.exact(y).dtype == np.int64 and small.deviation(y).tolist() == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, small.sums)) for r in y]


def test_huge_entries_do_not_fail(spark):
    rows = [(i, [float(i) * 1e300, 1e17 * i, float(i % 3)], "", 0) for i in range(-5, 6)]
    assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() > 0
