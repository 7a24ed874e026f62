"""A paged ledger feed as a Spark data source: filters go into its requests, and a stream resumes at the last block.

A feed is a picklable object with

* ``units() -> list[(product, network)]``,
* ``head(product, network) -> int | None``, the time of its newest row,
* ``fetch(product, network, since, before, page, size) -> list[tuple]``, rows in the order of ``LEDGER_SCHEMA`` with
  ``since <= ts_unix < before``, oldest first.

Equality on product and network chooses units, bounds on ``ts_unix`` become ``since`` and ``before``, and a
unit's span is cut into ranges of days, each an input partition read page by page. A page that is short
ends a range only once the next one proved empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .ledger import DAY, LEDGER_SCHEMA
from .paged import Retryable, with_retries

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PAGE, RANGE_DAYS = 1000, 30
_PROBES = 3


class Feed(Protocol):
    def units(self) -> list[tuple[str, str]]: ...

    def head(self, product: str, network: str) -> int | None: ...

    def fetch(self, product: str, network: str, since: int, before: int, page: int, size: int) -> list[tuple]: ...


class Span(InputPartition):
    """[since, before) of a unit."""

    def __init__(self, product: str, network: str, since: int, before: int) -> None:
        super().__init__((product, network, since, before))


def read_span(feed: Feed, span: Span, size: int) -> Iterator[tuple]:
    """A span's rows, page by page; an end that can't be verified, or rows behind a short page, raise."""
    product, network, since, before = span.value
    ask = lambda page: with_retries(lambda: feed.fetch(product, network, since, before, page, size))
    page = 0
    while True:
        rows = ask(page)
        yield from rows
        if len(rows) < size:
            break
        page += 1
    if rows:
        for attempt in range(_PROBES):
            try:
                if feed.fetch(product, network, since, before, page + 1, size):
                    raise ValueError(f"{product}/{network}: rows follow the short page {page}")
                return
            except Retryable:
                if attempt == _PROBES - 1:
                    raise ValueError(f"{product}/{network}: the end after page {page} can't be verified") from None


def ranges(product: str, network: str, since: int, before: int, days: int) -> list[Span]:
    """[since, before) cut at multiples of ``days`` days."""
    step, out, low = days * DAY, [], since
    while low < before:
        high = min(before, (low // step + 1) * step)
        out.append(Span(product, network, low, high))
        low = high
    return out


class FeedReader(DataSourceReader):
    def __init__(self, feed: Feed, size: int, days: int) -> None:
        self.feed, self.size, self.days = feed, size, days
        self.since, self.before = 0, 2**62
        self.only: dict[str, set[Any]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and IN on the unit, bounds on the time; what is left is Spark's."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in ("product", "network") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            elif column == "ts_unix" and isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                self.since = max(self.since, f.value + isinstance(f, GreaterThan))
            elif column == "ts_unix" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.before = min(self.before, f.value + isinstance(f, LessThanOrEqual))
            elif column == "ts_unix" and isinstance(f, EqualTo):
                self.since, self.before = max(self.since, f.value), min(self.before, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[Span]:
        out = []
        for product, network in self.feed.units():
            if product in self.only.get("product", (product,)) and network in self.only.get("network", (network,)):
                head = self.feed.head(product, network)
                if head is not None:
                    out += ranges(product, network, self.since, min(self.before, head + 1), self.days)
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(self.feed, partition, self.size)


class FeedStream(DataSourceStreamReader):
    """Offsets are, by unit, the time up to which rows were taken (exclusive).

    A batch ends ``lag`` seconds before a unit's head, so that a second still filling up is left for
    the next one; only rows between two offsets are asked for. A run resumes from its checkpoint.
    """

    def __init__(self, feed: Feed, size: int, days: int, lag: int) -> None:
        self.feed, self.size, self.days, self.lag = feed, size, days, lag

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        heads = {f"{p}/{n}": self.feed.head(p, n) for p, n in self.feed.units()}
        return {u: h + 1 - self.lag for u, h in sorted(heads.items()) if h is not None}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [s for u, before in end.items() for s in ranges(*u.split("/", 1), start.get(u, 0), before, self.days)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(self.feed, partition, self.size)


def feed_source(name: str, feed: Feed) -> type[DataSource]:
    """A source of ledger rows to register with ``spark.dataSource.register``; options: pageSize, rangeDays, lag."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return LEDGER_SCHEMA

        def _sizes(self) -> tuple[int, int]:
            return int(self.options.get("pageSize", PAGE)), int(self.options.get("rangeDays", RANGE_DAYS))

        def reader(self, schema: StructType) -> FeedReader:
            return FeedReader(feed, *self._sizes())

        def streamReader(self, schema: StructType) -> FeedStream:  # noqa: N802
            return FeedStream(feed, *self._sizes(), int(self.options.get("lag", 0)))

    return Source


def register_feed(spark: SparkSession, name: str, feed: Feed) -> None:
    """Register a feed's source and let Spark hand it filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(feed_source(name, feed))


class TableFeed:
    """A feed over ledger files at ``path``/product=…/network=…, which every executor can open (a shared folder). ``log`` counts requests: a file each."""

    def __init__(self, path: str, log: str | None = None) -> None:
        self.path, self.log = path.removeprefix("file://").removeprefix("file:"), log

    def _table(self, product: str, network: str):
        import pyarrow.dataset as ds

        return ds.dataset(f"{self.path}/product={product}/network={network}", format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."])

    def units(self) -> list[tuple[str, str]]:
        from pathlib import Path

        return sorted((p.parent.name.split("=", 1)[1], p.name.split("=", 1)[1]) for p in Path(self.path).glob("product=*/network=*"))

    def head(self, product: str, network: str) -> int | None:
        import pyarrow.compute as pc

        return pc.max(self._table(product, network).to_table(columns=["ts_unix"])["ts_unix"]).as_py()

    def fetch(self, product: str, network: str, since: int, before: int, page: int, size: int) -> list[tuple]:
        import pyarrow.compute as pc

        at = pc.field("ts_unix")
        found = self._table(product, network).to_table(filter=(at >= since) & (at < before)).sort_by([("ts_unix", "ascending"), ("id", "ascending")]).slice(page * size, size)
        rows = [(product, network, *(r[f.name] for f in LEDGER_SCHEMA.fields[2:])) for r in found.to_pylist()]
        if self.log:
            import os
            import uuid

            with open(os.path.join(self.log, f"{len(rows)}-{uuid.uuid4().hex}"), "w"):
                pass
        return rows
