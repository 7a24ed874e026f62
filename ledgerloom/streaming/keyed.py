"""Ledger streams whose state lives in the engine's state store, not in tables that every batch rewrites.

Two queries, joined by an append-only table, each resumed from its own checkpoint:

* ``route`` lets each id through once and marks rows behind the watermark. State is keyed by (unit, period of
  the row, bucket of the id) and holds that period's ids, a compressed block of them for each batch; a batch reads
  and appends only under the periods it has rows of, and a timer drops a period once the watermark has passed it.
  So work a batch doesn't grow with history, and neither does state beyond the horizon.
* ``wallet_totals`` is a streaming aggregation: sums and minima by wallet after partial sums, a hot
  address being one row a task and batch. The store keeps it; ``wallet_state`` reads it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.numbers import RAW
from ..operators.replay import legs
from ..sources.ledger import DAY
from .streams import lean

UNIT = ["product", "network"]
#: Buckets of a unit's period: how many tasks the ids of a busy one are spread over.
ID_BUCKETS = 64
#: Ids of one block of state, at most.
BLOCK_IDS = 50_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with a changelog in the checkpoint; stateful processors need it, large state wants it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def pack_ids(ids: list[str]) -> list[bytes]:
    """Blocks of the whole ids; in order their beginnings repeat, so that a block is a fraction of the text."""
    ids = sorted(ids, key=str)
    return [zlib.compress(json.dumps(ids[i : i + BLOCK_IDS], ensure_ascii=False, separators=(",", ":")).encode()) for i in range(0, len(ids), BLOCK_IDS)]


def unpack_ids(block: bytes) -> list[str]:
    return json.loads(zlib.decompress(block))


class _OncePerPeriod(StatefulProcessor):
    """Rows of one (unit, period, bucket): new ids pass, known ones don't, rows behind the watermark pass marked."""

    def __init__(self, columns: list[str], period: int) -> None:
        self.columns, self.period = columns, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", T.StructType([T.StructField("block", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        had = self.ids.exists()
        known = {i for x in self.ids.get() for i in unpack_ids(x[0])} if had else set()
        added: list[str] = []
        for batch in rows:
            late = batch["ts_unix"] * 1000 < mark
            keep = []
            for i, behind in zip(batch["id"], late):
                new = not behind and i not in known
                if new:
                    known.add(i)
                    added.append(i)
                keep.append(behind or new)
            some = batch.loc[keep, self.columns]
            if len(some):
                yield some.assign(late=late[keep])
        if added:
            self.ids.appendList([(block,) for block in pack_ids(added)])
            if not had:
                self.handle.registerTimer((int(key[2]) + 1) * self.period * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.ids.clear()
        return iter(())

    def close(self) -> None:
        pass


def route(stream: DataFrame, horizon_days: int, buckets: int = ID_BUCKETS, period_days: int = 1) -> DataFrame:
    """``stream`` with ``late``: each id once, and again whatever is more than ``horizon_days`` behind the latest row of earlier batches.

    A late row can't be told from one that was counted before: it is for a rebuild. An id always comes with the same unit and time.
    """
    use_rocksdb(stream.sparkSession)
    marked = stream.withColumn("_at", F.timestamp_seconds("ts_unix")).withWatermark("_at", f"{horizon_days} days").drop("_at")
    period = period_days * DAY
    keyed = marked.withColumns({"_period": F.floor(F.col("ts_unix") / period), "_bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")})
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in stream.schema.fields), T.StructField("late", T.BooleanType())])
    return keyed.groupBy(*UNIT, "_period", "_bucket").transformWithStateInPandas(_OncePerPeriod(stream.columns, period), out, "Append", "EventTime")


def write_routed(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table partitioned by ``late``; a batch that is run again replaces its own files."""
    writer = routed.writeStream.format("parquet").partitionBy("late").option("compression", "zstd").option("path", path)
    with lean(routed.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("late", F.col("late").cast("boolean"))


def read_routed(spark: SparkSession, path: str, late: bool) -> DataFrame:
    return routed(spark, path).where(F.col("late") == late).drop("late")


def stream_routed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows in time of a routed table, as a stream."""
    whole = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return spark.readStream.schema(whole).parquet(path).where(~F.col("late")).drop("late")


def wallet_totals(stream: DataFrame) -> DataFrame:
    """(product, network, address, balance, first_receipt), kept by the stream: zero rows stay, first receipts keep the minimum."""
    return legs(stream).groupBy(*UNIT, "address").agg(F.sum("amount").cast(RAW).alias("balance"), F.min(F.when(F.col("is_in"), F.col("ts_unix"))).alias("first_receipt"))


def maintain_wallets(stream: DataFrame, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Keep wallets in the state store; with ``path`` each batch's changed wallets are also written there, as ``batch=n``."""
    use_rocksdb(stream.sparkSession)
    writer = wallet_totals(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with lean(stream.sparkSession):
        if path is None:
            return writer.format("noop").start()
        return writer.foreachBatch(lambda changed, n: changed.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()


def wallet_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All wallets as of the last batch, from the state store."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    names = state.schema["value"].dataType.fieldNames()
    total, first = (next(n for n in names if n.startswith(kind)) for kind in ("sum", "min"))
    return state.select("key.*", F.col(f"value.{total}").cast(RAW).alias("balance"), F.col(f"value.{first}").alias("first_receipt"))
