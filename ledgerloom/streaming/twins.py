"""Twins across two live feeds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.incremental import TWIN, owned
from ..sources.ledger import DAY
from .keyed import use_rocksdb
from .streams import lean

#: Keys of state, each with the rows of its share of twins.
TWIN_BUCKETS = 2048
#: Rows of one block of state, at most.
BLOCK_ROWS = 50_000


def pack_rows(rows: pd.DataFrame, schema: pa.Schema) -> list[bytes]:
    """Compressed blocks of rows, by columns and in order, where neighbours are alike."""
    table = pa.Table.from_pandas(rows.sort_values([*TWIN, "id"]), schema, preserve_index=False)
    blocks = []
    for at in range(0, len(table), BLOCK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_table(table.slice(at, BLOCK_ROWS))
        blocks.append(zlib.compress(sink.getvalue()))
    return blocks


def unpack_rows(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(zlib.decompress(block)).read_all().to_pandas()


def chain(rows: pd.DataFrame, gap: int) -> pd.DataFrame:
    """``rows`` with ``_chain``, the number of their twins' chain, and ``_end``, when nothing can join it any more."""
    key = rows.groupby(list(TWIN), dropna=False, sort=False).ngroup()
    rows = rows.assign(_key=key).sort_values(["_key", "ts_unix"])
    starts = (rows["_key"] != rows["_key"].shift()) | (rows["ts_unix"].diff() > gap)
    rows = rows.assign(_chain=starts.cumsum()).drop(columns="_key")
    return rows.assign(_end=rows.groupby("_chain")["ts_unix"].transform("max") + gap)


class _HeldTwins(StatefulProcessor):
    """Rows of one bucket: appended by each batch, read when the watermark passes the end of one of their chains."""

    def __init__(self, schema: T.StructType, gap: int) -> None:
        self.columns, self.schema, self.gap = schema.names, to_arrow_schema(schema), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("rows", T.StructType([T.StructField("block", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([batch[self.columns] for batch in rows])
        self.held.appendList([(block,) for block in pack_rows(new, self.schema)])
        self._wake(new["ts_unix"].min() + self.gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.held.exists():
            return
        rows = chain(pd.concat([unpack_rows(x[0]) for x in self.held.get()]), self.gap)
        over = rows["_end"] * 1000 <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.held.clear()
        else:
            if over.any():
                self.held.put([(block,) for block in pack_rows(rows.loc[~over.to_numpy(), self.columns], self.schema)])
            self._wake(rows["_end"][~over.to_numpy()].min())
        if over.any():
            yield rows[over.to_numpy()].sort_values("id", kind="stable").drop_duplicates("_chain")[self.columns]

    def _wake(self, end: int) -> None:
        """At ``end``; a timer goes off once the watermark is beyond it."""
        self.handle.registerTimer(int(end) * 1000 - 1)

    def close(self) -> None:
        pass


def one_of_twins(feeds: list[DataFrame], owners: DataFrame, apart_days: int, delay_days: int, buckets: int = TWIN_BUCKETS) -> DataFrame:
    """Rows of several feeds (streams of hash, from_addr, to_addr, value_raw, id, ts_unix, ...), one of each twin.

    Twins are rows of equal hash, ends and value at most ``apart_days`` apart, chained; the smallest id stays. A
    row is held in the state store until the watermark (``delay_days`` behind the slowest feed) has passed its
    twins' last chance, and comes out once; state is as long as that, in compressed blocks of a bucket's rows. Each
    feed has a watermark of its own, and the slower one rules, so a feed that lags keeps the other's rows waiting
    instead of losing its twins. A row whose last chance has passed when it arrives is left out.
    """
    use_rocksdb(feeds[0].sparkSession)
    # the mark is told by rows' last chance, so that Spark leaves a row out by that and not by its own time
    marked = [f.withColumn("_until", F.timestamp_seconds(F.col("ts_unix") + apart_days * DAY)).withWatermark("_until", f"{delay_days + apart_days} days") for f in feeds]
    both = marked[0]
    for f in marked[1:]:
        both = both.unionByName(f)
    value, names = feeds[0].schema["value_raw"].dataType, feeds[0].columns
    rows = owned(both, owners).where("ts_unix is not null").select(*names, "_until").withColumn("value_raw", F.col("value_raw").cast("string"))
    out = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names])
    held = rows.withColumn("_bucket", F.pmod(F.xxhash64(*TWIN), F.lit(buckets)).cast("int")).groupBy("_bucket")
    one = held.transformWithStateInPandas(_HeldTwins(out, apart_days * DAY), out, "Append", "EventTime")
    return one.withColumn("value_raw", F.col("value_raw").cast(value))


def write_twins(resolved: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    use_rocksdb(resolved.sparkSession)
    writer = resolved.writeStream.format("parquet").outputMode("append").option("compression", "zstd").option("path", path)
    with lean(resolved.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
