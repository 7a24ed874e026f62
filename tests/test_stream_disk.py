"""What streams leave on disk."""

import random
import time
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.plans import live
from ledgerloom.streaming import keyed, streams, twins

SF = "/root/testdata/sf0.001"


def exchange_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in Path(d).glob("*/shuffle_*")}


def test_blocks_hold_whole_ids_in_a_fraction_of_their_text():
    ids = [f"{i}-{i * 7919 % 20_000}-{i * 31 % 1000}-{i % 7}-{i % 50 * 100}-{i * 104_729 % 9_000_000}-5-2-N-O-{800_000_000 + i % 180 * 86_400}" for i in range(5_000)]
    odd = ["", "ü", 'a"b', "a\nb", "\\", None]
    blocks = keyed.pack_ids(ids + odd)
    assert sorted((i for b in blocks for i in keyed.unpack_ids(b)), key=str) == sorted(ids + odd, key=str)
    assert 2 * sum(map(len, blocks)) < sum(map(len, ids))
    assert keyed.pack_ids([]) == []


def test_wallet_stream_keeps_no_second_copy_of_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(live, "scratch", lambda spark, name: str(tmp_path / name))
    assert live.stream_wallet_state(spark, SF).count() > 0
    left = {f.name[0] for f in (tmp_path / "wallets/in").glob("*.parquet")}
    assert left == {"3"}  # batches that were read are gone
    routed = keyed.routed(spark, str(tmp_path / "wallets/routed"))
    assert "hash" not in routed.columns and routed.where("late or id is not null").count() == 0 and routed.count() > 5_000


def test_a_stream_drops_its_exchanges(spark, tmp_path):
    spark.range(1000).select(F.lit("p").alias("product"), F.lit("n").alias("network"), F.col("id").cast("string").alias("id"), F.col("id").alias("ts_unix")).write.parquet(str(tmp_path / "in"))
    before = exchange_files(spark)
    source = streams.ledger_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    keyed.write_routed(keyed.route(source, 90, buckets=2, period_days=60), str(tmp_path / "routed"), str(tmp_path / "ck")).awaitTermination()
    until = time.time() + 10
    while (left := exchange_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert keyed.routed(spark, str(tmp_path / "routed")).count() == 1000


def test_held_twins_take_a_fraction_of_their_text(spark, tmp_path):
    n, schema = 20_000, "hash string, from_addr string, to_addr string, value_raw decimal(38,0), id string, ts_unix long"
    k = F.col("id")
    for name, form in (("l", "2-h%d-0"), ("r", "2_h%d_1_0")):
        rows = spark.range(n).select(F.concat(F.lit("h"), k).alias("hash"), F.concat(F.lit("c"), k * 7919 % 15_000).alias("from_addr"), F.concat(F.lit("s"), k * 31 % 1000).alias("to_addr"), (k % 50 * 1_000_000).cast("decimal(38,0)").alias("value_raw"), F.format_string(form, k).alias("id"), (k % 2500 * 86_400).alias("ts_unix"))
        rows.write.parquet(str(tmp_path / name))
    feeds = [streams.ledger_stream(spark, str(tmp_path / name), schema) for name in "lr"]
    owners = spark.createDataFrame([("acc", "a")], "account string, owner string")
    twins.write_twins(twins.one_of_twins(feeds, owners, 4000, 4000, buckets=4), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    state = sum(f.stat().st_size for f in (tmp_path / "ck/state").rglob("*") if f.is_file())
    assert state < 30 * 2 * n  # all rows are held, as nothing has passed their last chance
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == 0


def test_chains_are_session_windows(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), "y", "5", f"i{i}", rng.randint(0, 400) * 10) for i in range(120)]
    columns = ["hash", "from_addr", "to_addr", "value_raw", "id", "ts_unix"]
    got = twins.chain(pd.DataFrame(rows, columns=columns), 50)
    ours = {(c["id"].min(), len(c), int(c["_end"].iloc[0])) for _, c in got.groupby("_chain")}
    window = F.session_window(F.timestamp_seconds("ts_unix"), "50 seconds").alias("w")
    spans = spark.createDataFrame(rows, "hash string, from_addr string, to_addr string, value_raw string, id string, ts_unix long").groupBy(*columns[:4], window).agg(F.min("id").alias("i"), F.count("*").alias("n"))
    assert ours == {(r.i, r.n, r.e) for r in spans.select("i", "n", F.unix_timestamp("w.end").alias("e")).collect()}


def test_blocks_give_rows_back(monkeypatch):
    monkeypatch.setattr(twins, "BLOCK_ROWS", 2)
    schema = pa.schema([("hash", pa.string()), ("from_addr", pa.string()), ("to_addr", pa.string()), ("value_raw", pa.string()), ("id", pa.string()), ("ts_unix", pa.int64())])
    rows = pd.DataFrame([("h", None, "ü", "1" + "0" * 37, f"i{i}", 2**60 + i) for i in range(5)], columns=schema.names)
    blocks = twins.pack_rows(rows, schema)
    assert len(blocks) == 3 and pd.concat(map(twins.unpack_rows, blocks), ignore_index=True).equals(rows)
