"""Holder state as a bucketed Spark table whose increments touch only the slots that change.

The table is partitioned by ``slot`` (a hash of the wallet) and ``batch``, and bucketed by (product,
network, address). A batch reads the newest partitions of the slots its changes fall into, joins them with
the changes (the bucketed side isn't shuffled), and writes those slots anew under its own number. The
cursor commits to a ``VersionedStore`` with that number, and only then do readers take the new partitions: state and
cursor move together, a batch that fails half way is invisible, and running it again replaces its own
partitions and adds nothing twice. Partitions that no reader needs any more are dropped after the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import RAW
from ..sources.store import VersionedStore
from .incremental import KEYS, deltas, drop_boundary, next_cursor, since_cursor

WALLET = [*KEYS, "address"]
STATE = [*WALLET, "balance", "first_receipt"]


def slot_of(slots: int) -> Column:
    """A wallet's slot; another hash than that of the buckets, or every slot would hold few of them."""
    return F.pmod(F.xxhash64(*WALLET), F.lit(slots)).cast("int")


class StateTable:
    """State under ``root``: the table's files, and a store for the cursor and the number of the last batch.

    ``slots`` is how finely rewriting is cut, ``buckets`` how wide the join is; both are fixed when the table is
    made. At scale some thousand of either: a slot of a bucket is a file.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, slots: int = 256, buckets: int = 32) -> None:
        self.spark, self.name, self.slots, self.buckets = spark, name, slots, buckets
        self.store = VersionedStore(spark, f"{root}/commits")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (product STRING, network STRING, address STRING, balance {RAW}, first_receipt BIGINT, slot INT, batch INT) "
            f"USING parquet PARTITIONED BY (slot, batch) CLUSTERED BY (product, network, address) INTO {buckets} BUCKETS LOCATION '{root}/state'"
        )
        self.folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.folder)
        spark.sql(f"MSCK REPAIR TABLE {name}")  # partitions that another session wrote

    @property
    def batch(self) -> int:
        """The last batch committed; -1 before the first."""
        return self.store.meta.get("batch", -1)

    def partitions(self) -> list[tuple[int, int]]:
        """(slot, batch) of every partition: metadata, at most a few a slot."""
        pairs = (dict(p.split("=") for p in r[0].split("/")) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())
        return sorted((int(p["slot"]), int(p["batch"])) for p in pairs)

    def current(self, batch: int | None = None) -> dict[int, int]:
        """slot -> the newest batch that wrote it, of those committed."""
        last = self.batch if batch is None else batch
        return {s: b for s, b in self.partitions() if b <= last}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        """Rows of the given partitions only; the filter is on partition values, so no other file is opened."""
        chosen = [f"{s}-{b}" for s, b in versions.items()]
        return self.spark.table(self.name).where(F.concat_ws("-", "slot", "batch").isin(chosen))

    def read(self) -> DataFrame:
        """(product, network, address, balance, first_receipt) as of the last commit."""
        return self._read(self.current()).select(STATE)

    def merged(self, change: DataFrame, touched: list[int]) -> DataFrame:
        """State of the touched slots with their changes: balances add up, first receipts keep the minimum, zero rows stay."""
        now = self.current()
        old = self._read({s: now[s] for s in touched if s in now}).select(*WALLET, F.col("balance").alias("_b"), F.col("first_receipt").alias("_f"))
        both = old.join(change.select(*WALLET, "balance", "first_receipt"), WALLET, "full_outer")
        zero = F.lit(0).cast(RAW)
        balance = (F.coalesce("_b", zero) + F.coalesce("balance", zero)).cast(RAW)
        return both.select(*WALLET, balance.alias("balance"), F.least("_f", "first_receipt").alias("first_receipt"), slot_of(self.slots).alias("slot"))

    def apply(self, change: DataFrame, cursor: DataFrame | None = None, batch: int | None = None) -> list[int]:
        """Merge changes (one row a wallet) as batch ``batch`` (the next one), commit them with the cursor; the slots rewritten.

        A batch that was committed before changes nothing.
        """
        done = self.batch
        n = done + 1 if batch is None else batch
        if n <= done:
            return []
        at = self.store.version
        path = f"{self.store.root}/changes/batch={n}"
        change.select(STATE).withColumn("slot", slot_of(self.slots)).write.mode("overwrite").parquet(path)
        change = self.spark.read.parquet(path)
        touched = sorted(r.slot for r in change.select("slot").distinct().collect())  # at most ``slots``
        if touched:
            self._drop([(s, b) for s, b in self.partitions() if b > done])  # left by a batch that failed
            key = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(key)
            self.spark.conf.set(key, "dynamic")
            try:
                self.merged(change, touched).withColumn("batch", F.lit(n)).write.insertInto(self.name, overwrite=True)
            finally:
                self.spark.conf.set(key, before)
        self.store.commit({"cursor": cursor} if cursor is not None else {}, {"batch": n}, expect=at)
        keep = self.current()
        self._drop([(s, b) for s, b in self.partitions() if b < keep.get(s, b)])
        return touched

    def _drop(self, partitions: list[tuple[int, int]]) -> None:
        """Take partitions out of the table and delete their files."""
        for at in range(0, len(partitions), 200):
            names = ", ".join(f"PARTITION (slot={s}, batch={b})" for s, b in partitions[at : at + 200])
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {names} PURGE")
        for s, b in partitions:  # an external table's files stay when a partition is dropped
            self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder, f"slot={s}/batch={b}"), True)

    def advance(self, ledger: DataFrame) -> list[int]:
        """One run over a ledger: rows from the cursor's day on, less those seen, merged; the slots rewritten."""
        cursor = self.store.read("cursor")
        fresh = drop_boundary(since_cursor(ledger, cursor), cursor)
        return self.apply(deltas(fresh), next_cursor(fresh, cursor))
