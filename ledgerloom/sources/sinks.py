"""Several tables written in one pass, all of them or none.

Rows carry in ``sink`` which table they go to, and their columns as a struct of that name. Each task stages one
Parquet file a sink and reports it in its commit message; the driver moves the files of all sinks into
place once every task has ended well, and removes them if one hasn't. The folder is one that executors and
driver share, local or on any file system that Arrow knows by its address.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "ledgerloom_sinks"
ROWS_A_GROUP = 100_000


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (sink, staged path)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SinksWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sinks: list[str], overwrite: bool) -> None:
        self.path, self.sinks, self.overwrite, self.run = path.rstrip("/"), sinks, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = _at(self.path)
        staged: dict[str, tuple[str, pq.ParquetWriter]] = {}
        try:
            for batch in iterator:
                named = batch.column("sink").to_pylist()
                for sink in set(named):
                    if sink not in self.sinks:
                        raise ValueError(f"no sink {sink}")
                    rows = batch.column(sink).filter(pa.array([n == sink for n in named]))
                    table = pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])
                    if sink not in staged:
                        folder = f"{root}/_staged/{self.run}"
                        files.create_dir(folder, recursive=True)
                        target = f"{folder}/{sink}-{uuid.uuid4().hex}.parquet"
                        staged[sink] = target, pq.ParquetWriter(files.open_output_stream(target), table.schema)
                    staged[sink][1].write_table(table, ROWS_A_GROUP)
        finally:
            for _, writer in staged.values():
                writer.close()
        return Staged([(sink, target) for sink, (target, _) in staged.items()])

    def commit(self, messages: list) -> None:
        """Move what was staged into place; with overwrite, files of earlier writes go after the new ones are there."""
        files, root = _at(self.path)
        for sink in self.sinks:
            folder = f"{root}/{sink}"
            files.create_dir(folder, recursive=True)
            old = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.is_file] if self.overwrite else []
            for target in (t for m in messages if m for s, t in m.files if s == sink):
                files.move(target, f"{folder}/{target.rsplit('/', 1)[1]}")
            for f in old:
                files.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Remove this run's staged files, those of tasks that failed included."""
        files, root = _at(self.path)
        folder = f"{root}/_staged/{self.run}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class SinksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> SinksWriter:
        return SinksWriter(self.options["path"], [f.name for f in schema.fields if f.name != "sink"], overwrite)


def routed_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(sink, one struct a table): the rows of several tables as one frame."""
    out = None
    for name, df in tables.items():
        row = df.select(F.lit(name).alias("sink"), F.struct(*df.columns).alias(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def split_rows(df: DataFrame, routes: dict[str, list[str]]) -> DataFrame:
    """The same out of one frame that is read once: each row goes to every sink of ``routes`` (sink -> its columns)."""
    entry = lambda name: F.struct(F.lit(name).alias("sink"), *(F.struct(*cols).alias(s) if s == name else F.lit(None).cast(df.select(F.struct(*cols).alias("x")).schema["x"].dataType).alias(s) for s, cols in routes.items()))
    return df.select(F.explode(F.array(*map(entry, routes))).alias("r")).select("r.*")


def write_sinks(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows with ``sink`` and a struct a sink to ``path``/sink, all sinks or none."""
    rows.sparkSession.dataSource.register(SinksSource)
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()


def read_sink(spark: SparkSession, path: str, sink: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{sink}")
