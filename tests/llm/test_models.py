"""Boosted trees, calibration, CRF, and the two classifiers on held-out rows."""

import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import crf, quality, toxicity
from ledgerloom.llm.common import doc_bucket_py
from ledgerloom.llm.learning import BoostedTrees, Isotonic

DOCS = "doc_id long, text string, score string, label string"
LABELS = "doc_id long, quality int, toxic int"


def auc(scores, y):
    rank = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def all_paths(scores, trans):
    n, k = scores.shape
    return {p: scores[range(n), list(p)].sum() + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=n)}


def test_crf_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    scores, trans = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    lay = crf.Layout(lengths)
    marginal, pairs, log_z = crf.forward_backward(scores, trans, lay)
    best = crf.viterbi(scores, trans, lay)
    at, z_all, pair_all = 0, 0.0, np.zeros((3, 3))
    for n in lengths[lengths > 0]:
        paths = all_paths(scores[at : at + n], trans)
        z = np.log(np.exp(list(paths.values())).sum())
        z_all += z
        want = np.zeros((n, 3))
        for p, v in paths.items():
            for i, label in enumerate(p):
                want[i, label] += np.exp(v - z)
            for a, b in zip(p, p[1:]):
                pair_all[a, b] += np.exp(v - z)
        assert np.allclose(marginal[at : at + n], want)
        assert tuple(best[at : at + n]) == max(paths, key=paths.get)
        at += n
    assert np.isclose(log_z, z_all) and np.allclose(pairs, pair_all)


def test_crf_learns_a_transition():
    rng = random.Random(1)
    feats, gold, lengths = [], [], []
    for _ in range(80):
        n = rng.randint(2, 8)
        start = rng.random() < 0.5
        labels = [(i + start) % 2 for i in range(n)]
        feats += [[labels[0] if i == 0 else 2] for i in range(n)]
        gold += labels
        lengths.append(n)
    w, trans = crf.fit(np.array(feats), np.array(gold), np.array(lengths), 3, 2, rounds=60, penalty=0.01)
    assert (crf.viterbi(crf.score(np.array(feats), w), trans, crf.Layout(np.array(lengths))) == gold).all()


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-4 * (x[:, 0] * x[:, 1] > 0) + 2))).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000])
    raw = model.raw(x[2000:])
    assert auc(raw, y[2000:]) > 0.8
    p = Isotonic().fit(raw[:500], y[2000:2500])(raw[500:])
    assert abs(p.mean() - y[2500:].mean()) < 0.06 and 0 <= p.min() and p.max() <= 1
    order = np.argsort(raw[500:])
    assert (np.diff(p[order]) >= -1e-12).all()
    assert len(Isotonic().fit(np.zeros(0), np.zeros(0))(np.zeros(3))) == 3


def test_calibration_against_brute_force():
    rng = np.random.default_rng(4)
    raw, y = rng.normal(size=60).round(1), (rng.random(60) < 0.4).astype(float)
    order = np.argsort(raw, kind="stable")
    v = y[order]
    n = len(v)
    mean = lambda a, b: v[a : b + 1].mean()
    want = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])  # min-max formula
    iso = Isotonic().fit(raw, y)
    pools = [(want[i], np.flatnonzero(want == want[i])) for i in sorted({int(np.flatnonzero(want == w)[0]) for w in want})]
    assert len(pools) == len(iso.at)
    for (level, rows), at, value in zip(pools, iso.at, iso.value):
        assert np.isclose(at, raw[order][rows].mean()) and np.isclose(value, (level * len(rows) + 0.01) / (len(rows) + 0.02))


def test_first_tree_against_exhaustive_search():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.5).astype(float)
    y[x[:, 1] > 0.3] = 1.0
    t = BoostedTrees(trees=1, depth=1).fit(x, y)
    share = (y.sum() + 0.5) / 201
    g, h = share - y, np.full(200, share * (1 - share))
    b = t.binner(x)
    best = None
    for f in range(3):
        for c in range(t.bins):
            left = b[:, f] <= c
            if h[left].sum() < t.least or h[~left].sum() < t.least:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + t.ridge) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + t.ridge)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, c)
    feature, cut, value = t.model[0]
    assert (feature[0], cut[0]) == best[1:]
    left = b[:, best[1]] <= best[2]
    want = np.where(left, *(-t.rate * g[m].sum() / (h[m].sum() + t.ridge) for m in (left, ~left))) + np.log(share / (1 - share))
    assert np.allclose(t.raw(x), want)


def test_toxicity_features_against_plain_counts():
    lexicon = {"grobble": 4.0, "^snar": 3.5, "meh": 1.6}
    text = "You GROBBLE! the meh, meh snarfing gr0bble?? one two three four five six seven you 12 $$ ok"
    f = toxicity.Features(lexicon).one(text)
    n = 18
    weight = 4.0 + 1.6 * 2 + 3.5 + 4.0
    size = len(text.encode())
    assert len(f) == toxicity.Features.COUNT and len(text.split()) == n
    want = {0: np.log1p(n), 1: weight / n, 3: 5 / n, 4: 3 / n, 5: np.log1p(3), 6: 3.0, 7: 4.0, 8: 3.5, 9: 4.0 + 4.0 + 3.5, 11: 2.0, 12: 2 / 3, 13: 1.0, 14: 2 / n, 15: 8 / size, 16: 1 / n, 17: 3 / size, 18: 2 / size, 19: 3 / size, 20: 1 / n, 21: 1.0}
    for i, v in want.items():
        assert np.isclose(f[i], v), (i, f[i], v)


def test_line_bound_takes_documents_whole(spark):
    rows = [(i, "\n".join(["a line of words"] * (i + 1)), 1) for i in range(40)] + [(99, "x\n" * 1_000_000, 0)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert quality.within_lines(sample, 10**7).count() == 41
    got = quality.within_lines(sample, 300).collect()
    assert 0 < sum(r.text.count("\n") + 1 for r in got) <= 300 and 99 not in {r.doc_id for r in got}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in quality.within_lines(sample.repartition(7), 300).collect())
    assert quality.fit(sample, 300).lines is None  # one label left


def test_lines_of_mixed_documents_are_told_apart(spark):
    docs, labels = corpus(11, 400)
    text = {d: t for d, t, _, _ in docs}
    good, bad = ([text[i] for i, q, _ in labels if q == v and text[i].count("\n") > 2] for v in (1, 0))
    sample = spark.createDataFrame([(i, text[i], q) for i, q, _ in labels], "doc_id long, text string, label int")
    model = quality.fit(sample)
    mixed = [quality.line_features(a + "\n" + b) for a, b in zip(good[:40], bad[:40])]
    x, lengths, _ = quality._arrays(mixed)
    p = model.lines.marginals(x, lengths)
    truth = np.concatenate([np.repeat([1, 0], [a.count("\n") + 1, b.count("\n") + 1]) for a, b in zip(good[:40], bad[:40])])
    assert ((p > 0.5) == truth).mean() > 0.85


def corpus(seed, n):
    rng = random.Random(seed)
    voc = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(2, 9))) for _ in range(1500)]
    bad = ["grobble", "snarfing", "dunkbert"]
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        lines = [[rng.choice(voc) for _ in range(rng.randint(5, 14))] for _ in range(rng.randint(2, 9))]
        if toxic:
            for _ in range(3):
                rng.choice(lines).insert(2, rng.choice(bad))
        text = "\n".join(" ".join(x).capitalize() + "." if good else " | ".join(x).upper() for x in lines)
        docs.append((i, text, "x", "y"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("score,label,modulus,held", [(toxicity.score_toxicity, "toxic", 4, 2), (quality.score_quality, "quality", 5, 0)])
def test_held_out_accuracy_and_edges(spark, score, label, modulus, held):
    docs, labels = corpus(modulus, 500)
    extra = [(None, "null id", "", ""), (900, None, "", ""), (901, "", "", ""), (3, docs[3][1], "", ""), (902, "long " * 60_000, "", "")]
    d, y = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame([*labels, (3, labels[3][1], labels[3][2]), (5000, None, 1), (None, 1, 1)], LABELS)
    got = score(d, y).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: (q, t) for i, q, t in labels}
    rows = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and doc_bucket_py(r.doc_id, modulus) == held) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    want = np.array([truth[r.doc_id][label == "toxic"] for r in rows])
    assert np.mean([r.predicted for r in rows] == want) > 0.93 and auc(np.array([r.score for r in rows]), want) > 0.95
    # held-out labels have no influence
    swapped = [(i, 1 - q, 1 - t) if doc_bucket_py(i, modulus) == held else (i, q, t) for i, q, t in labels]
    again = score(d, spark.createDataFrame(swapped, LABELS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, score(d, spark.createDataFrame(labels, LABELS)).collect()))


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_without_labels(spark, score):
    none = spark.createDataFrame([], LABELS)
    assert [(r.doc_id, r.score, r.predicted) for r in score(spark.createDataFrame([(1, "a b", "", "")], DOCS), none).collect()] == [(1, 0.0, 0)]
    assert score(spark.createDataFrame([], DOCS), none).collect() == []
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)], LABELS)
    got = score(spark.createDataFrame([(i, "a b", "", "") for i in range(6)], DOCS), one).collect()
    assert all(r.score == 1.0 for r in got)


def test_keep_good(spark):
    docs, labels = corpus(9, 300)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns
    good = {i for i, q, _ in labels if q}
    ids = {r.doc_id for r in kept.collect()}
    assert len(good - ids) <= 3 and len(ids - good) <= 12
    assert quality.keep_good(d, spark.createDataFrame([], LABELS)).count() == 300
