"""Document quality by a linear-chain CRF that labels every line good or bad.

A document's non-blank lines are a chain. Each line's features (lengths, character classes, repetition,
whether the line occurs again in the document) are binned; a line sees its own bins, those of the line
before and of the line after, and the chain's transitions. Forward-backward gives each line's marginal
of being good; their mean weighted by line length is the document's raw quality, calibrated on
out-of-fold rows. Training lines carry their document's label; a labelled document is in the training
sample whole or not at all. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import doc_bucket, doc_bucket_py, slices, thrifty
from .learning import Binner, Isotonic, labelled_sample

#: Bounds of what is collected to fit: labelled rows, and lines in all of them.
MOST_ROWS, MOST_LINES = 5_000, 400_000
FOLDS = 2
THRESHOLD = 0.3
BINS = 8
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS, _ENDS, _PAUSES = b"#$%&*@^~<>{}[]\\=+_/|", b"!?", b".,;:"
N_FEATURES = 16
#: Rows of the weight table: three slots (before, own, after) of each feature with BINS bins and "no line".
_WIDTH = BINS + 1
TABLE = 3 * N_FEATURES * _WIDTH


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """One row of features and the length in characters of each non-blank line."""
    rows, sizes = [], []
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    times: dict[str, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    for x in lines:
        tokens, data = x.split(), x.encode("utf-8", "replace")
        n, size = max(len(tokens), 1), len(data)
        count = lambda chars: size - len(data.translate(None, chars))
        upper, lower, digit, symbol, ends, pauses, bars = (count(c) / size for c in (_UPPER, _LOWER, _DIGIT, _SYMBOLS, _ENDS, _PAUSES, b"|"))
        distinct = len(set(tokens)) / n
        again = sum(map(eq, tokens, tokens[1:])) / n
        rows.append(
            [np.log1p(n), len(x) / n, upper, lower, digit, symbol, ends, pauses, bars, distinct, again, times[x] - 1.0, sum(1 for t in tokens if not t[-1].isalnum()) / n, sum(1 for t in tokens if t.isupper()) / n, float(max(map(len, tokens))), size / len(x)]
        )
        sizes.append(len(x))
    return rows, sizes


def chain_features(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Weight-table rows of every line: own, previous and next line's bins."""
    n = len(bins)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(lengths)
    some = np.asarray(lengths) > 0
    first[(ends - lengths)[some]] = True
    last[ends[some] - 1] = True
    before, after = np.roll(bins, 1, 0), np.roll(bins, -1, 0)
    before[first], after[last] = BINS, BINS
    offset = np.arange(N_FEATURES) * _WIDTH
    step = N_FEATURES * _WIDTH
    return np.concatenate([before + offset, bins + offset + step, after + offset + 2 * step], 1)


class LineModel:
    """Binning, weights and transitions of the line CRF."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> None:
        self.bins = Binner(x, BINS)
        feats = chain_features(self.bins(x), lengths)
        gold = np.repeat(good, lengths).astype(np.int64)
        self.w, self.trans = crf.fit(feats, gold, lengths, TABLE, 2, rounds=60)

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        if not len(x):
            return np.zeros(0)
        scores = crf.score(chain_features(self.bins(x), lengths), self.w)
        return crf.forward_backward(scores, self.trans, crf.Layout(lengths))[0][:, 1]

    def raw(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, empty: float) -> np.ndarray:
        """Length-weighted mean marginal of each document, as log odds; ``empty`` for those without a line."""
        p = self.marginals(x, lengths)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(doc, sizes, len(lengths))
        mean = np.where(total > 0, np.bincount(doc, p * sizes, len(lengths)) / np.maximum(total, 1), empty)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def _arrays(docs: list[tuple[list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r, _ in docs], np.int64)
    x = np.array([r for rows, _ in docs for r in rows], np.float64).reshape(-1, N_FEATURES)
    return x, lengths, np.array([s for _, sizes in docs for s in sizes], np.float64)


class QualityModel:
    def __init__(self, lines: LineModel | None, calibrate: Isotonic | None, share: float) -> None:
        self.lines, self.calibrate, self.share = lines, calibrate, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.lines is None:
            return np.full(len(texts), self.share)
        return self.calibrate(self.lines.raw(*_arrays([line_features(t) for t in texts]), self.share))


def within_lines(sample: DataFrame, most: int) -> DataFrame:
    """The rows of a sample whose lines, taken whole documents in order of a hash of the id, fit in ``most``."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    held, ids, over = 0, [], False
    for r in sample.select("doc_id", lines.alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if held + r.n <= most:
            held += r.n
            ids.append((r.doc_id,))
        else:
            over = True
    if not over:
        return sample
    chosen = sample.sparkSession.createDataFrame(ids, sample.select("doc_id").schema)  # at most MOST_ROWS ids
    return sample.join(F.broadcast(chosen), "doc_id")


def fit(sample: DataFrame, most_lines: int = MOST_LINES) -> QualityModel:
    """From (doc_id, text, label). No rows: every score 0; rows of one label only: its share."""
    sample = within_lines(sample, most_lines)

    def features(batches):
        for batch in batches:
            ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
            docs = [line_features(t) for t in texts]
            flat = [[v for r in rows for v in r] for rows, _ in docs]
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(flat, pa.list_(pa.float32())), pa.array([s for _, s in docs], pa.list_(pa.int32()))], names=["doc_id", "label", "x", "sizes"])

    got = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(thrifty(features), "doc_id long, label int, x array<float>, sizes array<int>").toPandas()
    if not len(got):
        return QualityModel(None, None, 0.0)
    got = got.sort_values("doc_id").reset_index(drop=True)
    y = got.label.to_numpy(np.float64)
    share = float(y.mean())
    if y.min() == y.max():
        return QualityModel(None, None, share)
    docs = [(np.asarray(x, np.float64).reshape(-1, N_FEATURES), list(s)) for x, s in zip(got.x, got.sizes)]
    fold = np.array([doc_bucket_py(d, 5 * 7 * FOLDS) // 35 for d in got.doc_id])
    out = np.zeros(len(y))
    parts = [np.flatnonzero(fold == f) for f in range(FOLDS)]
    for f, rows in enumerate(parts):
        rest = np.setdiff1d(np.arange(len(y)), rows)
        if len(rows) and len(rest):
            x, lengths, _ = _arrays([docs[i] for i in rest])
            out[rows] = LineModel(x, lengths, y[rest]).raw(*_arrays([docs[i] for i in rows]), share)
    x, lengths, _ = _arrays(docs)
    return QualityModel(LineModel(x, lengths, y), Isotonic().fit(out, y), share)


def apply_model(documents: DataFrame, model: QualityModel, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of every row with its score as ``name``; one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = documents.select(*columns) if "text" in columns else documents.select(*columns, "text")

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([], map(len, texts), 1_000_000):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), pa.array(m.scores(texts[a:b]), pa.float64())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema.fields)
    return out.mapInArrow(thrifty(run), f"{schema}, `{name}` double")


def score_quality(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row.

    Null texts count as empty; a text without lines has the raw score of the labels' share. A null doc_id
    isn't held out; repeated rows each give a row; very long texts are scored whole. An empty table gives no
    rows; other columns are not read. No labels: score 0.
    """
    model = fit(labelled_sample(documents, labels, "quality", modulus, held_out, MOST_ROWS))
    scored = apply_model(documents, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(doc_bucket(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` scored at least ``threshold``, columns unchanged; all rows if nothing is labelled.

    Null and empty texts are scored as texts without lines, by the labels' share; repeated rows are kept or
    go together; an empty table gives no rows; extra columns, of whatever name, pass through.
    """
    model = fit(labelled_sample(documents, labels, "quality", 5, 0, MOST_ROWS))
    if model.lines is None:
        return documents
    name = "score"
    while name in documents.columns:
        name = f"_{name}"
    return apply_model(documents, model, documents.columns, name).where(F.col(name) >= threshold).drop(name)
