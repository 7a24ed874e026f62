"""A versioned table store: all tables of a commit become visible through one manifest rename.

Each commit writes its tables under ``v=N+1``, claims the number by a file that can be created only once, and
then renames a small manifest naming the tables; a reader
resolves the newest manifest first. A crash before the rename leaves version N as it was, and any file
system that Spark can reach (with atomic rename) will do.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: After so long a claim without its manifest counts as left by a crash.
CLAIM_SECONDS = 600


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit())

    @property
    def version(self) -> int:
        return max(self._manifests(), default=0)

    def manifest(self) -> dict:
        n = self.version
        if not n:
            return {"version": 0, "tables": {}, "meta": {}}
        text = self.spark.read.text(f"{self.root}/manifest/{n}", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str) -> DataFrame | None:
        """A table as of the newest commit; None if no commit has it."""
        path = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(path) if path else None

    @property
    def meta(self) -> dict:
        return self.manifest()["meta"]

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None, expect: int | None = None) -> int:
        """Write ``tables`` and switch to them at once; tables not named stay as they are.

        ``expect`` is the version the new tables were derived from: if another commit came between, or
        wins the race for the same number, this one fails and nothing changes.
        """
        now = self.manifest()
        if expect is not None and now["version"] != expect:
            raise RuntimeError(f"the store is at version {now['version']}, not {expect}")
        n = now["version"] + 1
        paths = dict(now["tables"])
        for name, df in tables.items():
            paths[name] = f"{self.root}/data/{name}/v={n}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(paths[name])
        text = json.dumps({"version": n, "tables": paths, "meta": {**now["meta"], **(meta or {})}})
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        generation = self._claim(n)
        made = self._path(f"{self.root}/tmp/{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/manifest/{n}")
        if max(self._generations(n)) != generation or self._fs.exists(target) or not self._fs.rename(made, target):
            raise RuntimeError(f"version {n} was taken by another commit")
        return n

    def _generations(self, n: int) -> dict[int, float]:
        """generation -> when it was claimed, of the claims of number ``n``."""
        at = self._path(f"{self.root}/claim/{n}")
        if not self._fs.exists(at):
            return {}
        return {int(s.getPath().getName()): s.getModificationTime() / 1000 for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()}

    def _claim(self, n: int) -> int:
        """Take number ``n`` and return the claim's generation: a file created without overwrite, which only one writer can.

        A claim left by a crash goes stale after ``CLAIM_SECONDS``; the next generation takes over. No claim is
        ever deleted, so of several writers that find the same one stale a single one goes on, and an owner that was only slow
        finds the newer generation before it commits.
        """
        held = self._generations(n)
        newest = max(held, default=0)
        if held and time.time() - held[newest] <= CLAIM_SECONDS:
            raise RuntimeError(f"version {n} was taken by another commit")
        try:
            self._fs.create(self._path(f"{self.root}/claim/{n}/{newest + 1}"), False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"version {n} was taken by another commit") from e
        return newest + 1


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite exactly the partitions that ``df`` has rows of: upsert and removal of stale rows in one."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_units(spark: SparkSession, df: DataFrame, path: str, by: list[str], units: DataFrame) -> None:
    """The same for a run over ``units`` (a row each): a unit without new rows loses all its stale ones too. A run that stops between is run again."""
    df = df.persist()  # written, and asked for its units
    replace_partitions(df, path, by)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for r in units.select(*by).distinct().join(df.select(*by).distinct(), by, "left_anti").toLocalIterator():  # units are a dimension
        folder = "/".join(f"{c}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(r[c]))}" for c in by)
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        at.getFileSystem(conf).delete(at, True)
    df.unpersist()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Old rows replaced by new ones of the same key; columns in ``keep_if_null`` keep the old value where the new is null."""
    if old is None:
        return new
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new = F.col(f"n.{keys[0]}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null or c in keys else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(pick(c).alias(c) for c in new.columns))


def read_progress(store: VersionedStore, now_unix: int, ttl_seconds: int = 7 * 86_400) -> dict | None:
    """What a stopped run left in the manifest, unless it is too old to resume."""
    left = store.meta.get("progress")
    return left["state"] if left and now_unix - left["saved_at"] < ttl_seconds else None


def save_progress(store: VersionedStore, state: dict | None, now_unix: int) -> int:
    return store.commit({}, {"progress": {"state": state, "saved_at": now_unix} if state is not None else None})


def write_unit(tables: dict[str, DataFrame], product: str, network: str, aggregate_only: bool, store: VersionedStore, history: bool = True) -> int:
    """Commit those of a unit's tables that its route writes, each replacing the unit's rows of the stored one."""
    routes = write_routes(product, network, aggregate_only, history)
    out = {}
    for name, df in tables.items():
        if routes[name]:
            old = store.read(name)
            rest = old.where(~((F.col("product") == product) & (F.col("network") == network))) if old is not None else None
            out[name] = df if rest is None else rest.unionByName(df)
    return store.commit(out)


def write_routes(product: str, network: str, aggregate_only: bool, history: bool = True) -> dict[str, bool]:
    """Which outputs a unit's run writes: tags only per wallet on ethereum, wallets unless aggregate-only."""
    return {"tags": not aggregate_only and network == "ethereum", "classifications": not aggregate_only, "stats": True, "history": history}
