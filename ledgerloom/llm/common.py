"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One step of the 64-bit mixing function used to combine and re-seed hashes.
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split between training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def doc_bucket_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in UTF-8 with A-Z lower-cased; null gives none.

    ``bytes.split`` separates on exactly the six ASCII blanks and ``bytes.lower`` maps A-Z alone.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an unsigned array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, filled on first sight; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of every run of ``size`` words, repeats included.

    A text of fewer words is one shingle, the whole sequence; no words give none.
    """
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k) * GOLDEN)
        for i in range(k):
            out = mix(out ^ word_hashes[i : n - k + 1 + i]) + GOLDEN
    return out


def slices(columns: list[list], weights: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut row numbers 0..n into runs whose summed weight stays near ``most`` (one row at least)."""
    start = total = 0
    i = -1
    for i, w in enumerate(weights):
        if total and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if i >= start:
        yield start, i + 1


def keyed_runs(batches, key: str, least: int = 200_000):
    """Arrow batches of one key-sorted partition, regrouped so that no key spans two tables."""
    import pyarrow as pa

    held: list = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        full = pa.Table.from_batches(held)
        keys = full.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield full.slice(0, cut)
            held = full.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty in a single-machine run, as in tests, a folder of our own is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables; raises on a cluster that names none."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """The session's shuffle partitions, or ``least`` if that is more."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: What this Python worker keeps from task to task, by owner, and how each lets it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Note that ``owner`` holds a model or a memo in this worker; tasks of another owner call ``forget``."""
    _KEPT[owner] = forget


def thrifty(run: Callable, owner: str = "") -> Callable:
    """``run`` for ``mapInArrow`` in a worker that Spark uses again for later stages.

    It begins without the models and memos of other owners, and when it ends, free memory goes back to the
    system: else a worker holds the peak of each stage it ever served, beside the next stage's.
    """

    def lean(batches):
        import pyarrow as pa

        for other in [o for o in _KEPT if o != owner]:
            _KEPT.pop(other)()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return lean
