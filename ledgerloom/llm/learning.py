"""Training samples, gradient-boosted trees and isotonic calibration, all fitted in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, shared_checkpoint


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out remainder.

    The sample is chosen among labels by a hash of the id, so it doesn't depend on row order; what is
    broadcast to find its texts is these ids, ``most`` at the most. A doc_id labelled twice has its
    larger label; of repeated document rows one counts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(doc_bucket(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return shared_checkpoint(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))


class Binner:
    """Quantile bins of each feature."""

    def __init__(self, x: np.ndarray, bins: int) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1).astype(np.int64) if x.shape[1] else np.zeros(x.shape, np.int64)


class BoostedTrees:
    """Second-order boosting of the logistic loss; trees of fixed depth over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.binner = Binner(x, self.bins)
        b = self.binner(x)
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.bias = float(np.log(share / (1 - share)))
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(len(y), self.bias)
        n_feats = b.shape[1]
        flat = b + np.arange(n_feats) * self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                width, base = 2**level, 2**level - 1
                key = (node[:, None] * (n_feats * self.bins) + flat).ravel()
                size = width * n_feats * self.bins
                gs = np.bincount(key, np.repeat(g, n_feats), size).reshape(width, n_feats, self.bins).cumsum(2)
                hs = np.bincount(key, np.repeat(h, n_feats), size).reshape(width, n_feats, self.bins).cumsum(2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(hs < self.least) | (ha - hs < self.least)] = 0.0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                feature[base : base + width] = best // self.bins
                cut[base : base + width] = np.where(good, best % self.bins, self.bins)
                node = 2 * node + (b[np.arange(len(y)), feature[base + node]] > cut[base + node])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.model.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binner(x)
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            out += value[node]
        return out


class Isotonic:
    """Pool-adjacent-violators calibration; between the pools' centres it is linear, so order survives."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for x, v in zip(raw[order], y[order]):
            pools.append([float(v), 1.0, float(x)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, n, c = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + c]
        self.at = np.array([c / n for _, n, c in pools])
        self.value = np.array([(s + 0.01) / (n + 0.02) for s, n, _ in pools])
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.zeros(len(raw))
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)
