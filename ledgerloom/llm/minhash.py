"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once; the top bits of the hash name one of ``BINS`` bins, the rest is
its value, and a bin keeps its smallest. An empty bin borrows by optimal densification: it asks the
others in a fixed seeded order of its own until one is filled, independent of what its neighbours
hold; that order names every bin, so some filled one is always met. Of each bin ``BITS`` low-order bits
of its value mixed with the bin's number are stored, two bins a byte: bins that borrowed one value
store different bits, so they agree by chance independently. Two fingerprints agree in a bin with
probability J + (1 - J) / 2**BITS; the estimate solves that for J. Its variance is that of ``BINS``
bins for texts of many shingles, and of as many bins as the union has shingles for shorter ones: with
few shingles J itself is coarse, while the chance part stays that of ``BINS`` bins.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, mix, partitions_for, shingle_hashes, slices, words

BINS, BITS, SHINGLE = 512, 4, 5
_FREE = np.uint64(2**64 - 1)


def shingle_arrays(hashes: list[np.ndarray], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of several texts and the text each belongs to."""
    n = np.array([len(h) for h in hashes], np.int64)
    long = np.flatnonzero(n >= size)
    flat = np.concatenate([hashes[i] for i in long]) if len(long) else np.zeros(0, np.uint64)
    of = np.repeat(long, n[long])
    grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(flat):
        grams = shingle_hashes(flat, size)
        inside = of[: len(grams)] == of[size - 1 :]
        grams, owner = grams[inside], of[: len(grams)][inside]
    short = [i for i in np.flatnonzero((n > 0) & (n < size))]
    if short:
        grams = np.concatenate([grams, *(shingle_hashes(hashes[i], size) for i in short)])
        owner = np.concatenate([owner, np.array(short, np.int64)])
    return grams, owner


def _orders(bins: int) -> np.ndarray:
    """For each bin, all bins in the order in which it asks them."""
    number = np.arange(bins, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.argsort(mix(mix((number + np.uint64(1)) * GOLDEN)[:, None] + (number + np.uint64(1)) * GOLDEN), axis=1).astype(np.int64)


ORDERS = _orders(BINS)
_BIN_SALT = mix(mix(np.arange(1, BINS + 1, dtype=np.uint64)))


def densify(values: np.ndarray) -> np.ndarray:
    """Fill empty bins of the rows that have any value; rows without one stay empty."""
    empty = values == _FREE
    row, bin_ = np.nonzero(empty & ~empty.all(1)[:, None])
    source = values.copy()
    for attempt in range(BINS):
        if not len(row):
            break
        got = source[row, ORDERS[bin_, attempt]]
        hit = got != _FREE
        values[row[hit], bin_[hit]] = got[hit]
        row, bin_ = row[~hit], bin_[~hit]
    return values


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` small integers for each text's word hashes; no words: all zero."""
    grams, owner = shingle_arrays(hashes)
    values = np.full(len(hashes) * BINS, _FREE)
    width = int(np.log2(BINS))
    bin_ = (grams >> np.uint64(64 - width)).astype(np.int64)
    np.minimum.at(values, owner * BINS + bin_, grams & np.uint64(2 ** (64 - width) - 1))
    values = densify(values.reshape(-1, BINS))
    low = (mix(values ^ _BIN_SALT) & np.uint64(2**BITS - 1)).astype(np.uint8)
    low[(values == _FREE).all(1)] = 0
    return low


def pack(low: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in low[:, ::2] << BITS | low[:, 1::2]]


def unpack(text: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([b >> BITS, b & (2**BITS - 1)], 1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows, from 0 to 1; equal rows give 1."""
    by_chance = 2.0**-BITS
    return np.clip(((a == b).mean(1) - by_chance) / (1 - by_chance), 0.0, 1.0)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row: the plain operator. Null text: empty; no shuffle."""

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([], (len(t or "") for t in texts), 1_000_000):
                low = fingerprints([memo.of(words(t)) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pack(low))], names=[id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def place_among(at: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``bounds`` are at most ``at``, a struct (k, h): a binary search over two constant arrays."""
    if not bounds:
        return F.lit(0)
    ks, hs = F.lit([k for k, _ in bounds]).cast("array<bigint>"), F.lit([h for _, h in bounds]).cast("array<bigint>")
    jumps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def jump(place: Column, by: Column) -> Column:
        to = place + by
        low = F.struct(F.get(ks, to - 1).alias("k"), F.get(hs, to - 1).alias("h"))
        return F.when((to <= len(bounds)) & (low <= at), to).otherwise(place)

    return F.aggregate(F.lit(jumps), F.lit(0), jump).cast("int")


def beside_next(df: DataFrame, partitions: int) -> DataFrame:
    """(bucket, extra, k, h, doc_id, text) so that every bucket, sorted, ends with a copy of what follows its last row.

    Rows stand in descending order of (k, h, text): k is the id, null ids last, and h the text's hash.
    Buckets are ranges of (k, h), so an id that many rows share is cut between its texts; only rows of
    one id and one text keep together. Each bucket's first place (two numbers a bucket) is collected.
    The copy of the first row overall follows the last one.
    """
    spark = df.sparkSession
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = df.select("doc_id", "text", k.alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    wanted = [i / partitions for i in range(1, partitions)]
    ids = Counter(rows.agg(F.percentile_approx("k", wanted, 10_000)).first()[0] or []) if wanted else Counter()
    bounds = [(i, -(2**63) + j * 2**64 // n) for i, n in sorted(ids.items()) for j in range(n)]
    at = F.struct("k", "h")
    rows_bucket = place_among(at, bounds)
    rows = rows.withColumn("bucket", rows_bucket)
    highest = sorted((r.bucket, tuple(r.at)) for r in rows.groupBy("bucket").agg(F.max(at).alias("at")).collect())
    if not highest:
        return rows.select("bucket", F.lit(0).alias("extra"), "k", "h", "doc_id", "text")
    following = [(low, above, 1) for (_, low), (above, _) in zip(highest, highest[1:])] + [(highest[-1][1], highest[0][0], 2)]
    extra = spark.createDataFrame([(*place, to, rank) for place, to, rank in following], "k long, h long, to int, extra int")
    first = rows.join(F.broadcast(extra), ["k", "h"]).groupBy("to", "extra", "k", "h").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("key"), "doc_id", "text")).alias("r"))
    copies = first.select(F.col("to").alias("bucket"), "extra", "k", "h", "r.doc_id", "r.text")
    return rows.select("bucket", F.lit(0).alias("extra"), "k", "h", "doc_id", "text").unionByName(copies)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of what follows, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(df: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with the likeness to that and to the next document.

    The next document has the next smaller doc_id (rows of equal id: by descending hash of the text, then
    text; null ids last; after the last comes the first). Null texts count as empty: fingerprint of zeros,
    alike only to one another (likeness 1); other columns are not read. A lone document is its own next. An empty table gives no rows.
    Texts are shuffled once, a range of places to a task, sorted there; a task streams its range and holds
    one slice of it. Only rows that repeat both id and text can make a range long.
    """
    partitions = partitions_for(df)
    rows = beside_next(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partitions)

    def run(batches):
        memo = WordHashes()
        last = None  # (bucket, id, text, fingerprint row) still waiting for what follows
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for a, b in slices([], (len(t or "") for t in cols[3]), 1_000_000):
                bucket, extra, ids, texts = (c[a:b] for c in cols)
                texts = [t or "" for t in texts]
                low = fingerprints([memo.of(words(t)) for t in texts])
                pairs = []
                for i in range(len(texts)):
                    if last is not None and last[0] == bucket[i]:
                        pairs.append((last, texts[i], low[i]))
                    last = (bucket[i], ids[i], texts[i], low[i]) if not extra[i] else None
                if not pairs:
                    continue
                new = [edited(p[0][2], p[1]) for p in pairs]
                own, changed, after = np.stack([p[0][3] for p in pairs]), fingerprints([memo.of(words(t)) for t in new]), np.stack([p[2] for p in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0][1] for p in pairs], pa.int64()),
                        pa.array([len(p[0][2]) for p in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                        pa.array(pack(own), pa.string()),
                        pa.array(pack(changed), pa.string()),
                        pa.array(likeness(own, changed)),
                        pa.array(likeness(own, after)),
                    ],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    spread = rows.repartitionById(partitions, "bucket").sortWithinPartitions("bucket", "extra", F.desc("k"), F.desc("h"), F.desc(F.coalesce("text", F.lit(""))))
    return spread.select("bucket", "extra", "doc_id", "text").mapInArrow(run, COLUMNS)
