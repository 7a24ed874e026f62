"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is mined from the labelled training rows: words and word beginnings that occur in markedly
more toxic than clean documents, weighted by log odds. It holds every such term of the sample, whose
``MOST_ROWS`` rows are what bounds it. It is mined once without each fold, so features of
training rows never know their own label; the trees, and on out-of-fold margins the calibration, are
fitted on those. Per text: densities of lexicon weight and hits, hits near a second-person word,
capitals, punctuation and obfuscation rates. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, doc_bucket_py, slices
from .learning import BoostedTrees, Isotonic, labelled_sample

#: Bound of the labelled rows that the lexicon, the trees and the calibration are fitted on.
MOST_ROWS = 12_000
FOLDS = 4
THRESHOLD = 0.3
#: Fixed: second-person words of the languages at hand.
YOU = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie tú ti tus usted ustedes vos".split())
_EDGES = "\"'`.,;:!?()[]{}<>«»“”„…-–—_*#%&$@^~|/\\+="
_LEET = str.maketrans("@4031!5$7", "aaoeiisst")
_ODD = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|(.)\1\1")
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
NEAR = 5


def terms(raw: str) -> tuple[str, list[str], bool]:
    """The bare lower-case word, what of it is looked up (itself and its beginnings), and whether it is disguised."""
    bare = raw.strip(_EDGES).lower()
    disguised = bool(_ODD.search(bare))
    if disguised:
        bare = re.sub(r"(.)\1\1+", r"\1", re.sub(r"[^\w]", "", bare.translate(_LEET)))
    return bare, [bare, *("^" + bare[:n] for n in (4, 5, 6) if len(bare) > n)] if bare else [], disguised


class Features:
    """Rows of features of texts under a lexicon (term -> weight)."""

    COUNT = 22

    def __init__(self, lexicon: dict[str, float], memo: int = 250_000) -> None:
        self.lexicon, self.limit = lexicon, memo
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[tuple] = []

    def row(self, raw: str) -> tuple:
        bare, looked, disguised = terms(raw)
        whole = self.lexicon.get(bare, 0.0)
        start = max((self.lexicon.get(t, 0.0) for t in looked[1:]), default=0.0)
        return (whole, start, max(whole, start), bare in YOU, len(raw) > 1 and raw.isupper(), disguised, disguised and max(whole, start) > 0)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.COUNT))
        for i, text in enumerate(texts):
            out[i] = self.one(text)
        return out

    def one(self, text: str) -> list[float]:
        tokens = text.split()
        if len(self.index) > self.limit:
            self.clear()
        index, rows = self.index, self.rows
        for t in set(tokens).difference(index):
            index[t] = len(rows)
            rows.append(self.row(t))
        n = len(tokens)
        distinct = Counter(tokens)
        hits = [(t, rows[index[t]], c) for t, c in distinct.items()]
        weight = sum(r[2] * c for _, r, c in hits)
        hit = [(t, r, c) for t, r, c in hits if r[2] > 0]
        strong = [(t, r, c) for t, r, c in hit if r[2] >= 3.0]
        per = 1.0 / max(n, 1)
        near = share = 0.0
        gap = 50.0
        if strong:
            bad = {t for t, _, _ in strong}
            you = [k for k, t in enumerate(tokens) if rows[index[t]][3]]
            at = [k for k, t in enumerate(tokens) if t in bad]
            if you:
                close = np.abs(np.array(at)[:, None] - np.array(you)[np.clip(np.searchsorted(you, at)[:, None] + np.array([-1, 0]), 0, len(you) - 1)]).min(1)
                near, share, gap = float((close <= NEAR).sum()), float((close <= NEAR).mean()), float(min(50, close.min()))
        data = text.encode("utf-8", "replace")
        size = 1.0 / max(len(data), 1)
        gone = lambda chars: len(data) - len(data.translate(None, chars))
        marks = gone(b"!?")
        return [
            np.log1p(n),
            weight * per,
            sum(r[0] * c for _, r, c in hit) * per,
            sum(c for _, _, c in hit) * per,
            sum(c for _, _, c in strong) * per,
            np.log1p(sum(c for _, _, c in strong)),
            float(len(strong)),
            max((r[0] for _, r, _ in hit), default=0.0),
            max((r[1] for _, r, _ in hit), default=0.0),
            sum(r[2] for _, r, _ in sorted(hit, key=lambda x: -x[1][2])[:3]),
            np.log1p(sum(c for _, r, c in hits if r[1] >= 3.0)),
            near,
            share,
            gap,
            sum(c for _, r, c in hits if r[3]) * per,
            gone(_UPPER) * size,
            sum(c for _, r, c in hits if r[4]) * per,
            marks * size,
            gone(b"*#$%&@^~|<>=+_") * size,
            gone(_DIGIT) * size,
            sum(c for _, r, c in hits if r[5]) * per,
            float(sum(c for _, r, c in hits if r[6])),
        ]


def fold_of(doc_id: int) -> int:
    return doc_bucket_py(doc_id, 4 * FOLDS) // 4 if doc_id is not None else 0


def mine(sample: DataFrame) -> list[dict[str, float]]:
    """Lexica: one without each fold, and last the one of all rows."""
    names = [f"{kind}{f}" for kind in "ct" for f in range(FOLDS)]

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                slot = fold_of(doc_id) + FOLDS * label
                seen.update((t, slot) for t in {t for w in set(text.split()) for t in terms(w)[1]})
        rows: dict[str, list[int]] = {}
        for (t, slot), n in seen.items():
            rows.setdefault(t, [0] * (2 * FOLDS))[slot] = n
        items = list(rows.items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), *(pa.array([r[i] for _, r in part], pa.int64()) for i in range(2 * FOLDS))], names=["term", *names])

    counts = sample.select("doc_id", "text", "label").mapInArrow(count, "term string, " + ", ".join(f"{n} long" for n in names))
    counts = counts.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    toxic, clean = sum((F.col(f"t{f}") for f in range(FOLDS)), F.lit(0)), sum((F.col(f"c{f}") for f in range(FOLDS)), F.lit(0))
    totals = {(r.label, r.fold): r.n for r in sample.select("label", (F.floor(doc_bucket(F.col("doc_id"), 4 * FOLDS) / 4)).cast("int").alias("fold")).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(n for (y, _), n in totals.items() if y), sum(n for (y, _), n in totals.items() if not y)
    frequent = counts.where((toxic >= 2) & (toxic * max(n_clean, 1) >= 4 * clean * max(n_toxic, 1)))
    found = frequent.orderBy("term").collect()

    def lexicon(without: int | None) -> dict[str, float]:
        folds = [f for f in range(FOLDS) if f != without]
        a_all = sum(totals.get((1, f), 0) for f in folds)
        b_all = sum(totals.get((0, f), 0) for f in folds)
        out = {}
        for r in found:
            a, b = sum(r[f"t{f}"] for f in folds), sum(r[f"c{f}"] for f in folds)
            odds = np.log((a + 0.3) / (a_all + 1.0)) - np.log((b + 0.3) / (b_all + 1.0))
            if a >= 2 and odds >= 1.5:
                out[r.term] = float(odds)
        return out

    return [lexicon(f) for f in (*range(FOLDS), None)]


class ToxicityModel:
    """Lexicon, trees and calibration; ``scores`` works on any texts."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, calibrate: Isotonic | None, share: float) -> None:
        self.lexicon, self.trees, self.calibrate, self.share = lexicon, trees, calibrate, share

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        return self.calibrate(self.trees.raw(features))


def fit(sample: DataFrame) -> ToxicityModel:
    """From (doc_id, text, label). No rows: every score 0; rows of one label only: its share."""
    lexica = mine(sample)

    def features(batches):
        makers = [Features(x) for x in lexica[:-1]]
        for batch in batches:
            ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
            folds = [fold_of(d) for d in ids]
            rows = [makers[f].one(t) for f, t in zip(folds, texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(folds, pa.int32()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "fold", "label", "x"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(features, "doc_id long, fold int, label int, x array<double>").toPandas()
    if not len(got):
        return ToxicityModel({}, None, None, 0.0)
    got = got.sort_values("doc_id")
    x, y, fold = np.array(got.x.tolist(), np.float64), got.label.to_numpy(np.float64), got.fold.to_numpy()
    if y.min() == y.max():
        return ToxicityModel(lexica[-1], None, None, float(y[0]))
    out = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if rest.any() and (~rest).any():
            out[~rest] = BoostedTrees().fit(x[rest], y[rest]).raw(x[~rest])
    return ToxicityModel(lexica[-1], BoostedTrees().fit(x, y), Isotonic().fit(out, y), float(y.mean()))


def score_toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row.

    Null and empty texts have the features of a text without words and are scored like any other; a null
    doc_id isn't held out; repeated rows each give a row; very long texts are scored whole, one at a time. An empty
    table gives no rows; other columns are not read. The model (the sample's lexicon and some trees)
    is what the scoring pass receives; that pass has no shuffle. No labels: score 0.
    """
    model = fit(labelled_sample(documents, labels, "toxic", modulus, held_out, MOST_ROWS))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        maker = Features(m.lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([], map(len, texts), 1_000_000):
                s = m.scores(maker(texts[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(doc_bucket(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
