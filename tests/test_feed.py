import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import feed as feeds
from ledgerloom.sources.ledger import DAY, LEDGER_SCHEMA, ZERO


def rows_of(n, start=0):
    rng = random.Random(n)
    return [(f"p{i % 3}", f"n{i % 2}", f"{i:05d}", f"h{i}", i * 9000 + 5, ZERO, rng.choice("abc"), Decimal(i)) for i in range(start, start + n)]


def store(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode(mode).partitionBy("product", "network").parquet(path)


@pytest.fixture
def served(spark, tmp_path):
    path, log, name = str(tmp_path / "t"), str(tmp_path / "log"), f"feed{random.getrandbits(40):x}"
    os.makedirs(log)
    store(spark, rows_of(600), path)
    feeds.register_feed(spark, name, feeds.TableFeed(path, log))
    return name, path, log


def fetched(log):
    total = sum(int(n.split("-")[0]) for n in os.listdir(log))
    for n in os.listdir(log):
        os.remove(os.path.join(log, n))
    return total


def test_filters_reach_the_requests(spark, served):
    name, _, log = served
    df = spark.read.format(name).option("pageSize", 7).option("rangeDays", 5).load()
    assert sorted(map(tuple, df.collect())) == sorted(rows_of(600))
    assert fetched(log) == 600
    some = df.where((F.col("product") == "p1") & F.col("network").isin("n0", "n9") & (F.col("ts_unix") >= 10 * DAY) & (F.col("ts_unix") < 20 * DAY) & (F.col("to_addr") != "zz"))
    want = [r for r in rows_of(600) if r[0] == "p1" and r[1] == "n0" and 10 * DAY <= r[4] < 20 * DAY]
    assert sorted(map(tuple, some.collect())) == sorted(want) and want
    assert fetched(log) == len(want)  # nothing else was asked for
    left = [x for x in some._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter " in x]
    assert len(left) == 1 and "to_addr" in left[0] and "ts_unix" not in left[0] and "network" not in left[0]  # the rest is the source's


def test_bounds_and_spans():
    r = feeds.FeedReader(feeds.TableFeed("/nowhere"), 10, 30)
    left = list(r.pushFilters([feeds.GreaterThan(("ts_unix",), 5), feeds.LessThanOrEqual(("ts_unix",), 9), feeds.EqualTo(("id",), "x"), feeds.In(("product",), ("a", "b")), feeds.EqualTo(("product",), "b")]))
    assert (r.since, r.before, r.only) == (6, 10, {"product": {"b"}}) and len(left) == 1
    spans = [s.value[2:] for s in feeds.ranges("p", "n", 3, 2 * DAY + 1, 1)]
    assert spans == [(3, DAY), (DAY, 2 * DAY), (2 * DAY, 2 * DAY + 1)] and feeds.ranges("p", "n", 9, 9, 1) == []


def test_short_pages_must_be_the_end():
    class Cut:
        def fetch(self, product, network, since, before, page, size):
            return [("x",)] * (1 if page in (0, 1) else 0)

    with pytest.raises(ValueError, match="short page"):
        list(feeds.read_span(Cut(), feeds.Span("p", "n", 0, 9), 5))

    class Silent(Cut):
        def fetch(self, product, network, since, before, page, size):
            if page:
                raise feeds.Retryable
            return [("x",)]

    with pytest.raises(ValueError, match="verified"):
        list(feeds.read_span(Silent(), feeds.Span("p", "n", 0, 9), 5))


def test_two_runs_of_the_stream_equal_one_scan(spark, served, tmp_path):
    name, path, log = served
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.format(name).option("pageSize", 50).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 600
    fetched(log)
    store(spark, rows_of(40, 600), path)
    run()
    assert sorted(map(tuple, spark.read.parquet(out).select(*LEDGER_SCHEMA.names).collect())) == sorted(rows_of(600) + rows_of(40, 600))
    assert fetched(log) == 40  # only what is new was asked for
