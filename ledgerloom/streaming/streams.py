"""Streams of the ledger and of events.

Batch state lives in the versioned store, so balances, cursor and known ids commit together; the stream's
batch number is kept in the store's metadata and a batch seen before is skipped, which makes retries
harmless, and an id that comes again in a later batch is known, which makes redelivery harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import KEYS, deltas, merge, next_cursor
from ..sources.ledger import DAY
from ..sources.store import VersionedStore


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Writes run, and streams started, in here drop an exchange's files with the batch that made them, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ledger_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, consume: bool = False) -> DataFrame:
    """Files of ``path`` as a stream; with ``consume`` those of a committed batch are deleted, for copies that nothing else reads."""
    reader = spark.readStream.schema(schema)
    if consume:
        reader = reader.option("cleanSource", "delete")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def maintain_state(stream: DataFrame, store: VersionedStore, checkpoint: str, horizon_days: int | None = None) -> StreamingQuery:
    """Merge every micro-batch into the stored holder state; runs until what is available is consumed.

    Tables ``state``, ``cursor`` and ``seen`` (unit, id, ts_unix) change together. With ``horizon_days`` ids
    are remembered for so many days behind each unit's latest row, and older rows, which can't be told
    from known ones any more, go to the table ``late`` for a rebuild; without it all ids are remembered. Tables
    are rewritten whole by each batch: for state that outgrows that, see ``keyed`` and ``operators.state_table``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        at = store.version
        if store.meta.get("batch", -1) >= number:
            return
        state, cursor, seen, late = (store.read(t) for t in ("state", "cursor", "seen", "late"))
        fresh = batch.dropDuplicates([*KEYS, "id"])
        if seen is not None:
            fresh = fresh.join(seen.select(*KEYS, "id"), [*KEYS, "id"], "left_anti")
        tables: dict[str, DataFrame] = {}
        if horizon_days is not None and cursor is not None:
            floor = cursor.groupBy(*KEYS).agg((F.max("last_ts") - horizon_days * DAY).alias("_floor"))
            old = F.coalesce(F.col("ts_unix") < F.col("_floor"), F.lit(False))
            marked = fresh.join(floor, KEYS, "left")
            lost, fresh = marked.where(old).drop("_floor"), marked.where(~old).drop("_floor")
            tables["late"] = lost if late is None else late.unionByName(lost).dropDuplicates([*KEYS, "id"])
        fresh = fresh.persist()  # cursor, known ids and state all read it
        moved = next_cursor(fresh, cursor)
        known = fresh.select(*KEYS, "id", "ts_unix")
        known = known if seen is None else seen.unionByName(known)
        if horizon_days is not None:
            floor = moved.groupBy(*KEYS).agg((F.max("last_ts") - horizon_days * DAY).alias("_floor"))
            known = known.join(floor, KEYS).where("ts_unix >= _floor").drop("_floor")
        try:
            store.commit({"state": merge(state, deltas(fresh)), "cursor": moved, "seen": known, **tables}, {"batch": number}, expect=at)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_batches(rows: DataFrame, batches: Column, path: str) -> list[str]:
    """``rows`` written once by all tasks, each row into every batch of the array ``batches`` (text); the batches' names in order.

    What a batch holds is settled by its folder, not by a number of files, so no task has to write or read a batch alone.
    """
    with lean(rows.sparkSession):
        rows.withColumn("_batch", F.explode(batches)).write.partitionBy("_batch").option("compression", "zstd").parquet(f"{path}/staged")
    files = _files(rows.sparkSession, path)
    return sorted(s.getPath().getName().split("=")[1] for s in files.listStatus(_path(rows.sparkSession, f"{path}/staged")) if "=" in s.getPath().getName())


def arrive(spark: SparkSession, path: str, batch: str) -> None:
    """Move a staged batch's files to where a stream over ``path``/in finds them; one rename each, the batch leading its name. Of a batch without rows nothing arrives."""
    files, at, staged = _files(spark, path), _path(spark, f"{path}/in"), _path(spark, f"{path}/staged/_batch={batch}")
    files.mkdirs(at)
    for s in files.listStatus(staged) if files.exists(staged) else []:
        name = f"{batch}-{s.getPath().getName()}"
        if not files.rename(s.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, name)):
            raise RuntimeError(f"{name} can't be moved to {path}/in")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only log of rows that arrive."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, watermark: str | None = "1 day", width: str = "1 day") -> DataFrame:
    """Events and their value a type and window (an extension: batch and stream alike)."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = x.withWatermark("ts", watermark) if watermark and events.isStreaming else x
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents")).select(F.col("w.start").alias("start"), "event_type", "n", "value_cents")


def sessions(events: DataFrame, gap: str = "2 hours", watermark: str | None = "1 day") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart (an extension)."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    x = x.withWatermark("ts", watermark) if watermark and events.isStreaming else x
    return x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
