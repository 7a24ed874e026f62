import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import incremental, views
from ledgerloom.sources.ledger import LEDGER_SCHEMA, ZERO
from ledgerloom.sources.store import VersionedStore, append, replace_partitions, upsert
from ledgerloom.streaming import streams


def random_rows(seed, n=300):
    rng = random.Random(seed)
    who = [ZERO, *(f"w{i}" for i in range(12))]
    rows = []
    for i in range(n):
        a, b = rng.sample(who, 2)
        rows.append(("p", f"n{i % 2}", str(i), f"h{i}", i * 7000 + 5, a, b, rng.randint(0, 10**6) * 10**15))
    return rows


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(*r[:7], Decimal(r[7])) for r in rows], LEDGER_SCHEMA)


def replay(rows):
    out = defaultdict(int)
    for _, n, _, _, _, a, b, v in rows:
        if b != ZERO:
            out[n, b] += v
        if a != ZERO:
            out[n, a] -= v
    return dict(out)


def state_of(df):
    return {(r.network, r.address): int(r.balance) for r in df.collect()}


def test_runs_commit_atomically_and_equal_replay(spark, tmp_path):
    rows, store = random_rows(1), None
    store = VersionedStore(spark, str(tmp_path / "s"))
    for cut in (90, 91, 200, 300):
        incremental.run_increment(frame(spark, rows[:cut]), store)
        assert state_of(store.read("state")) == replay(rows[:cut])
    assert store.version == 4
    with pytest.raises(RuntimeError, match="at version 4"):
        store.commit({}, expect=3)
    incremental.run_increment(frame(spark, rows), store)
    assert state_of(store.read("state")) == replay(rows)


def test_rebuild_swaps_only_what_is_better(spark, tmp_path):
    rows, store = random_rows(2), VersionedStore(spark, str(tmp_path / "s"))
    incremental.run_increment(frame(spark, rows[:150]), store)
    held = defaultdict(int)
    for (n, _), v in replay(rows).items():
        held[n] += max(v, 0)
    supply = spark.createDataFrame([("p", n, 15, v / 10**15) for n, v in held.items()], "product string, network string, decimals int, supply_tokens double")
    assert incremental.rebuild(frame(spark, rows), supply, store) == 2
    assert state_of(store.read("state")) == replay(rows)
    assert incremental.rebuild(frame(spark, rows[:10]), supply, store) is None
    none = supply.withColumn("supply_tokens", F.lit(None).cast("double"))
    assert {r.decision for r in incremental.rebuild_gate(store.read("state"), store.read("state"), none).collect()} == {"skip"}


def test_backfill_lifecycle(spark, tmp_path):
    rows, store = random_rows(3), VersionedStore(spark, str(tmp_path / "s"))
    windows = [frame(spark, rows[:100]), frame(spark, []), frame(spark, rows[100:])]
    incremental.backfill(windows[:2], store, False)
    assert store.meta["lifecycle"] == "in_progress"
    incremental.backfill(windows[2:], store, True)
    assert store.meta["lifecycle"] == "complete" and state_of(store.read("state")) == replay(rows)


def test_units_have_their_own_lifecycle(spark, tmp_path):
    from ledgerloom.sources.ledger import DAY

    rows, store = random_rows(5), VersionedStore(spark, str(tmp_path / "s"))
    cut = 10 * DAY
    early, late = [r for r in rows if r[4] < cut], [r for r in rows if r[4] >= cut]
    incremental.backfill_unit("p", "n0", [(frame(spark, early), cut), (frame(spark, []), 11 * DAY)], store, False, 17)
    assert incremental.lifecycle(store) == {"p/n0": {"lifecycle": "in_progress", "span_days": 17}}
    ((last, i),) = [(r.last_ts, r.id) for r in store.read("cursor").collect()]
    assert (last, i) == (11 * DAY - 1, None)  # the empty window's end
    incremental.run_increment(frame(spark, rows), store)  # n0 is in progress: only n1 moves
    assert state_of(store.read("state")) == replay([r for r in rows if r[1] == "n1" or r in early])
    incremental.backfill_unit("p", "n0", [(frame(spark, [r for r in late if r[4] >= 11 * DAY]), 400 * DAY)], store, True)
    assert incremental.lifecycle(store)["p/n0"] == {"lifecycle": "complete", "span_days": 17}
    want = [r for r in rows if r[1] == "n1" or not cut <= r[4] < 11 * DAY]
    assert state_of(store.read("state")) == replay(want)
    incremental.run_increment(frame(spark, want), store)
    assert state_of(store.read("state")) == replay(want)


def test_ids_that_come_again_in_a_later_batch_count_once(spark, tmp_path):
    rows = random_rows(6, 60)
    for i, part in enumerate((rows[:40], rows[20:], rows[:5] + rows[55:])):
        append(frame(spark, part).coalesce(1), str(tmp_path / "in"))
    store = VersionedStore(spark, str(tmp_path / "s"))
    stream = streams.ledger_stream(spark, str(tmp_path / "in"), LEDGER_SCHEMA, 1)
    streams.maintain_state(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert store.version == 3 and state_of(store.read("state")) == replay(rows)
    last = {n: max(r[4] for r in rows if r[1] == n) for n in ("n0", "n1")}
    assert {(r.network, r.last_ts) for r in store.read("cursor").collect()} == set(last.items())


def test_rows_behind_the_horizon_are_kept_apart(spark, tmp_path):
    rows = random_rows(7, 200)  # 16 days
    for part in (rows[100:], rows[:10] + rows[150:]):
        append(frame(spark, part).coalesce(1), str(tmp_path / "in"))
    store = VersionedStore(spark, str(tmp_path / "s"))
    stream = streams.ledger_stream(spark, str(tmp_path / "in"), LEDGER_SCHEMA, 1)
    streams.maintain_state(stream, store, str(tmp_path / "ck"), horizon_days=6).awaitTermination()
    got = state_of(store.read("state"))
    first = {r.id for r in store.read("late").collect()}
    if store.read("late").count() == 10:  # the later rows came first
        assert first == {r[2] for r in rows[:10]} and got == replay(rows[100:])
    else:
        assert first == set() and got == replay(rows[:10] + rows[100:])
    top = max(r[4] for r in rows)
    assert store.read("seen").agg(F.min("ts_unix")).first()[0] >= top - 7 * 86_400


def test_stream_equals_batch_and_retries_are_harmless(spark, tmp_path):
    rows, store = random_rows(4), VersionedStore(spark, str(tmp_path / "s"))
    for a, b in ((0, 100), (100, 200), (200, 300)):
        append(frame(spark, rows[a:b]).coalesce(1), str(tmp_path / "in"))
    stream = streams.ledger_stream(spark, str(tmp_path / "in"), LEDGER_SCHEMA, 1)
    streams.maintain_state(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert state_of(store.read("state")) == replay(rows) and store.version == 3
    streams.maintain_state(stream, store, str(tmp_path / "ck2")).awaitTermination()
    assert state_of(store.read("state")) == replay(rows)
    streams.append_history(stream, str(tmp_path / "log"), str(tmp_path / "ck3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 300


def test_event_windows_stream_and_batch(spark, tmp_path):
    e = spark.createDataFrame([(i % 3, f"2024-01-0{1 + i % 4} 10:{i % 60:02d}:00", "ab"[i % 2], i / 4) for i in range(80)], "user_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = streams.tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in streams.tumbling_counts(e).collect()}
    assert streams.sessions(e).agg(F.sum("n")).first()[0] == 80


def test_upsert_and_partitions(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 6)], "k string, mv double, n int")
    new = spark.createDataFrame([("a", None, 7), ("c", 3.0, 8)], "k string, mv double, n int")
    got = {r.k: (r.mv, r.n) for r in upsert(old, new, ["k"], ("mv",)).collect()}
    assert got == {"a": (1.0, 7), "b": (2.0, 6), "c": (3.0, 8)}
    path = str(tmp_path / "t")
    replace_partitions(old.withColumn("g", F.col("k")), path, ["g"])
    replace_partitions(new.withColumn("g", F.col("k")), path, ["g"])
    assert {(r.k, r.n) for r in spark.read.parquet(path).collect()} == {("a", 7), ("b", 6), ("c", 8)}
    assert {(r.k, r.missing_from) for r in views.parity(old, new, ["k"]).collect()} == {("a", "differs"), ("b", "right"), ("c", "left")}


def test_units_without_new_rows_lose_their_stale_ones(spark, tmp_path):
    from ledgerloom.sources.store import replace_units

    schema, path = "product string, network string, n int", str(tmp_path / "t")
    replace_partitions(spark.createDataFrame([("p", "n0", 1), ("p", "n 1", 2), ("q", "n0", 3)], schema), path, ["product", "network"])
    run = spark.createDataFrame([("p", "n0"), ("p", "n 1")], "product string, network string")
    replace_units(spark, spark.createDataFrame([("p", "n0", 9)], schema), path, ["product", "network"], run)
    assert {(r["product"], r.network, r.n) for r in spark.read.parquet(path).collect()} == {("p", "n0", 9), ("q", "n0", 3)}


def test_routes_write_and_progress_expires(spark, tmp_path):
    from ledgerloom.sources.store import read_progress, save_progress, write_unit

    store = VersionedStore(spark, str(tmp_path / "s"))
    rows = lambda n, x: spark.createDataFrame([("p", n, x)], "product string, network string, x int")
    for n, only in (("ethereum", False), ("plume", False), ("solana", True)):
        write_unit({"tags": rows(n, 1), "classifications": rows(n, 2), "stats": rows(n, 3), "history": rows(n, 4)}, "p", n, only, store)
    write_unit({"stats": rows("plume", 8)}, "p", "plume", False, store)
    got = {t: {(r.network, r.x) for r in store.read(t).collect()} for t in ("tags", "classifications", "stats")}
    assert got == {"tags": {("ethereum", 1)}, "classifications": {("ethereum", 2), ("plume", 2)}, "stats": {("ethereum", 3), ("plume", 8), ("solana", 3)}}
    assert read_progress(store, 0) is None
    save_progress(store, {"page": 7}, 1000)
    assert read_progress(store, 1000 + 7 * 86_400 - 1) == {"page": 7} and read_progress(store, 1000 + 7 * 86_400) is None
    save_progress(store, None, 2000)
    assert read_progress(store, 2000) is None


def test_a_claimed_version_fails_the_second_writer(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import store as module

    store = VersionedStore(spark, str(tmp_path / "s"))
    store.commit({}, {"a": 1})
    store._claim(2)
    with pytest.raises(RuntimeError, match="version 2 was taken"):
        store.commit({}, {"a": 2})
    monkeypatch.setattr(module, "CLAIM_SECONDS", -1)  # the claim counts as left by a crash
    slow = VersionedStore(spark, str(tmp_path / "s"))
    assert slow._claim(2) == 2  # a writer that took the stale claim over and is slow
    assert store.commit({}, {"a": 3}) == 2 and store.meta == {"a": 3}
    assert max(slow._generations(2)) == 3  # the slow one would find a newer claim than its own, and fail
