"""Exact top-k by integer inner product: columnar branch and bound.

Candidates are cut into blocks stored by dimension (one contiguous column each). For a query,
partial products accumulate over one block of dimensions at a time, those with the largest query
entries first. After each step a candidate can reach at most partial + |query rest| * |candidate rest|
(Cauchy-Schwarz on the mass that remains), and the k-th best lower bound (the same with a minus)
is a floor: candidates below it are dropped and the survivors' columns compacted. While the products of
the largest norms stay below 2**52 all sums are of integers exact in doubles. Beyond that the doubles
only bound: margins grow by their rounding, and survivors are scored anew in Python's integers. Scores
outside a long saturate at its ends, and saturated ones tie.

Queries are the stated set (ids divisible by a number) against all rows, in blocks: a block of at most
``QUERY_BLOCK`` vectors is what is broadcast, whatever the table's size, and every block makes one pass
over the candidates. Each task keeps its k best a query; a window over these merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16_384
DIM_STEP = 16
#: Products of norms, and squares of candidates' norms, below this keep every partial sum an exact double.
EXACT = 2.0**52
_LONG = 2**63


def usable(col: Column) -> Column:
    """Whether a vector is there, has components, and all of them are present and finite."""
    return (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def quantise(matrix: np.ndarray) -> np.ndarray:
    """Components as integers; beyond 1e150 they count as that, so that squares stay finite."""
    return np.floor(np.clip(256.0 * np.clip(matrix.astype(np.float64), -1e150, 1e150), -1e150, 1e150))


class Block:
    """Candidates by dimension, with the norms of what follows each step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        self.squares = self.columns**2
        self.largest = float(np.sqrt(self.squares.sum(0).max(initial=0.0)))

    def whole(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of the candidates at ``places`` in integers of any size, held to a long."""
        q = [int(x) for x in query]
        full = [sum(a * int(b) for a, b in zip(q, self.columns[:, p])) for p in places]
        return np.array([min(_LONG - 1, max(-_LONG, x)) for x in full], np.int64)

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (as longs) that may be among the k best, given that scores below ``floor`` aren't."""
        order = np.argsort(-np.abs(query), kind="stable")
        reach_all = float(np.sqrt((query**2).sum())) * self.largest
        exact = max(reach_all, self.largest**2) < EXACT
        slack = 1e-6 if exact else reach_all * len(order) * 2.0**-24 + 1e-6  # what remains is a difference: half the digits
        held = lambda x: x if exact else -np.inf if x < slack - _LONG else min(x, _LONG - slack)  # noqa: E731  beyond a long all tie
        floor = held(float(floor) - (0 if exact else slack))
        partial = np.zeros(len(self.ids))
        rest = self.squares.sum(0)
        alive = np.flatnonzero(self.ids != own)
        partial, rest = partial[alive], rest[alive]
        for at in range(0, len(order), DIM_STEP):
            dims = order[at : at + DIM_STEP]
            part = self.columns[dims] if len(alive) == len(self.ids) else self.columns[np.ix_(dims, alive)]
            partial = partial + query[dims] @ part
            left = order[at + DIM_STEP :]
            if not len(left):
                break
            rest = rest - np.einsum("ij,ij->j", part, part)
            reach = np.sqrt(np.maximum(rest, 0.0)) * (np.sqrt((query[left] ** 2).sum()) * (1 + 1e-9)) + slack
            if len(alive) > k:
                low = partial - reach
                floor = max(floor, held(np.partition(low, len(low) - k)[len(low) - k]))
            keep = partial + reach >= floor
            if not keep.all():
                alive, partial, rest = alive[keep], partial[keep], rest[keep]
        return self.ids[alive], partial.astype(np.int64) if exact else self.whole(query, alive)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    take = np.lexsort((ids, ~scores))[:k]  # ~x is -x - 1, without overflow
    return ids[take], scores[take]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _pass(rows: DataFrame, q_ids: np.ndarray, q_matrix: np.ndarray, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q_matrix))

    def run(batches):
        ids, queries = shared.value
        width = queries.shape[1]
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

        def search(block: Block) -> None:
            for i, own in enumerate(ids):
                have, scores = top[i]
                floor = scores[-1] if len(scores) == k else -np.inf
                a, b = block.search(queries[i], int(own), k, floor)
                top[i] = best(np.concatenate([have, a]), np.concatenate([scores, b]), k)

        held, n = [], 0
        for batch in batches:
            values, size = _vectors(batch.column(1))
            fit = size == width
            if not fit.any():
                continue
            flat = values if fit.all() else values[np.repeat(fit, size)]
            held.append((batch.column(0).to_numpy()[fit], quantise(flat.reshape(-1, width))))
            n += int(fit.sum())
            if n >= CANDIDATE_BLOCK:
                search(Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
                held, n = [], 0
        if n:
            search(Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
        count = [len(t[0]) for t in top]
        if sum(count):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, count)), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))],
                names=["query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, every: int = 50, k: int = 5, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id.

    Queries are rows whose id is divisible by ``every``; candidates all rows but those of the query's
    own id. Vectors that are null, empty or hold null or non-finite components, and rows of null id, take no
    part; only vectors of a query's own length are compared with it, and of repeated query ids the
    first vector in ascending order asks (repeated candidate rows each count). A query without candidates, and an empty table, give no
    rows. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = shared_checkpoint(queries.withColumn("width", F.size("v")).orderBy("width", "id"))
    parts: list[DataFrame] = []
    held: list = []

    def flush() -> None:
        if held:
            ids = np.array([r.id for r in held], np.int64)
            matrix = quantise(np.array([r.v for r in held], np.float64).reshape(len(held), held[0].width))
            parts.append(_pass(rows, ids, matrix, k))
            held.clear()

    for r in queries.toLocalIterator():
        if held and (len(held) >= query_block or held[0].width != r.width):
            flush()
            if len(parts) >= 16:  # bounded plans and broadcasts: a finished run of blocks goes to shared storage
                done = parts[0]
                for p in parts[1:]:
                    done = done.unionByName(p)
                parts[:] = [shared_checkpoint(_ranked(done, k))]
        held.append(r)
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0].select("query_id", "vec_id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "vec_id", "score"))
    return _ranked(out, k)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same in DuckDB's SQL.
SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT vec_id AS query_id, min(v) AS q FROM rows WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, v), lambda p: p[1]::HUGEINT * p[2]::HUGEINT))::BIGINT AS score
  FROM queries JOIN rows ON vec_id <> query_id AND len(q) = len(v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
