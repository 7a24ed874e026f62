"""Paged feeds as a Spark data source, and a cache with a time to live.

A feed is any picklable ``fetch(unit, page, since) -> list[dict]``; each unit (say asset and network) is one
input partition, read page by page on an executor with throttling and retries. A page shorter than the
page size ends a unit only after the next one proved empty, so a truncated answer can't pass for the end.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_WAITS = (1.0, 2.0, 4.0)
PROBES = 3


class Retryable(Exception):
    """A failure that another attempt may not meet."""


def with_retries(call: Callable[[], list], waits: tuple[float, ...] = RETRY_WAITS, sleep: Callable[[float], None] = time.sleep) -> list:
    for wait in waits:
        try:
            return call()
        except Retryable:
            sleep(wait)
    return call()


def read_unit(fetch: Callable, unit: str, since: str | None, page_size: int, max_pages: int | None = None, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All rows of a unit; raises if rows follow a short page or its end can't be verified."""
    page = 0
    while max_pages is None or page < max_pages:
        rows = with_retries(lambda: fetch(unit, page, since), sleep=sleep)
        yield from rows
        if pause:
            sleep(pause)
        if len(rows) < page_size:
            if rows:
                for attempt in range(PROBES):
                    try:
                        if fetch(unit, page + 1, since):
                            raise ValueError(f"{unit}: rows follow the short page {page}")
                        return
                    except Retryable:
                        if attempt == PROBES - 1:
                            raise ValueError(f"{unit}: the end after page {page} can't be verified") from None
                        sleep(RETRY_WAITS[attempt])
            return
        page += 1


class _Unit(InputPartition):
    def __init__(self, unit: str) -> None:
        super().__init__(unit)


def paged_source(name: str, fetch: Callable, schema: str = "unit string, body string") -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; options: units (comma-separated), since, pageSize, maxPages, pause."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.units = [u for u in options.get("units", "").split(",") if u]
            self.since, self.size = options.get("since"), int(options.get("pagesize", options.get("pageSize", 1000)))
            pages = options.get("maxpages", options.get("maxPages"))
            self.pages, self.pause = int(pages) if pages else None, float(options.get("pause", 0))

        def partitions(self):
            return [_Unit(u) for u in self.units]

        def read(self, partition):
            for row in read_unit(fetch, partition.value, self.since, self.size, self.pages, self.pause):
                yield partition.value, json.dumps(row, sort_keys=True)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    return Source


def write_cache(df: DataFrame, path: str, now_unix: int) -> None:
    df.withColumn("fetched_at", F.lit(now_unix).cast("long")).write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str, now_unix: int, ttl_seconds: int | None) -> DataFrame | None:
    """The cached rows if young enough (of any age without a ``ttl_seconds``), else None."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    df = spark.read.parquet(path)
    fetched = df.agg(F.max("fetched_at")).first()[0]
    if ttl_seconds is not None and (fetched is None or now_unix - fetched >= ttl_seconds):
        return None
    return df.drop("fetched_at")


def read_history(spark: SparkSession, path: str, schema) -> DataFrame:
    """Cached rows of any age; a cache that isn't there is an empty table."""
    found = read_cache(spark, path, 0, None)
    return spark.createDataFrame([], schema) if found is None else found


def clear_cache(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's checkpoint folder; a single machine may do with one in the warehouse."""
    named = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")
