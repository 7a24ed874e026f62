"""Bucketed state, keyed streams, daily series and ordered scans against plain replays."""

import datetime
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import incremental, sliding
from ledgerloom.operators.ordered import ordered_scan
from ledgerloom.operators.state_table import StateTable
from ledgerloom.sources.ledger import DAY, LEDGER_SCHEMA, ZERO
from ledgerloom.streaming import keyed


def rows_of(seed, n=300, wallets=40, every=7000):
    rng = random.Random(seed)
    who = [ZERO, *(f"w{i}" for i in range(wallets))]
    out = []
    for i in range(n):
        a, b = rng.sample(who, 2)
        out.append(("p", f"n{i % 2}", str(i), f"h{i}", i * every + 5, a, b, Decimal(rng.randint(0, 10**6))))
    return out


def replay(rows):
    balance, first = defaultdict(int), {}
    for _, n, _, _, t, a, b, v in rows:
        for who, sign in ((b, 1), (a, -1)):
            if who != ZERO:
                balance[n, who] += sign * int(v)
                if sign > 0:
                    first[n, who] = min(t, first.get((n, who), t))
    return {k: (v, first.get(k)) for k, v in balance.items()}


def held(df):
    return {(r.network, r.address): (int(r.balance), r.first_receipt) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    name = f"state_{random.getrandbits(40):x}"
    yield StateTable(spark, name, str(tmp_path / name), slots=16, buckets=4)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_increments_equal_replay_and_rewrite_only_their_slots(spark, table):
    rows = rows_of(1)
    frame = lambda x: spark.createDataFrame(x, LEDGER_SCHEMA)
    for cut in (150, 151, 300):
        table.advance(frame(rows[:cut]))
        assert held(table.read()) == replay(rows[:cut])
    before = table.current()
    few = [("p", "n0", "x1", "h", 300 * 7000, ZERO, "w1", Decimal(5)), ("p", "n0", "x2", "h", 300 * 7000, "w1", "w2", Decimal(2))]
    touched = table.advance(frame(rows + few))
    assert held(table.read()) == replay(rows + few) and 1 <= len(touched) <= 2
    assert {s: b for s, b in table.current().items() if s not in touched} == {s: b for s, b in before.items() if s not in touched}
    assert len(table.partitions()) == len(table.current())  # old versions are gone


def test_stored_side_is_not_shuffled(spark, table):
    frame = spark.createDataFrame(rows_of(2), LEDGER_SCHEMA)
    table.advance(frame)
    change = incremental.deltas(frame.limit(20))
    plan = table.merged(change, sorted(table.current()))._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :]
    lines = stored.split("\n")
    scan = next(i for i, x in enumerate(lines) if table.name in x and "Scan" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
    above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-*()0123456789")) < depth]
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x for x in above), stored


def test_batch_that_failed_or_comes_again_adds_nothing_twice(spark, table, monkeypatch):
    rows = rows_of(3)
    frame = lambda x: spark.createDataFrame(x, LEDGER_SCHEMA)
    table.advance(frame(rows[:200]))
    monkeypatch.setattr(table.store, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.advance(frame(rows))
    monkeypatch.undo()
    assert held(table.read()) == replay(rows[:200])  # partitions of the failed batch are invisible
    table.advance(frame(rows))
    assert held(table.read()) == replay(rows)
    assert table.apply(incremental.deltas(frame(rows)), batch=table.batch) == [] and held(table.read()) == replay(rows)
    again = StateTable(spark, table.name, table.store.root.rsplit("/", 1)[0], 16, 4)
    assert held(again.read()) == replay(rows)


def put(spark, rows, path):
    spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_ids_once_late_rows_apart_and_restarts(spark, tmp_path):
    rows, at = rows_of(4, 60, every=DAY // 2), lambda x: str(tmp_path / x)
    first, second = rows[10:40], rows[:4] + rows[30:40] + rows[36:60]
    put(spark, first, at("in"))
    run = lambda: keyed.write_routed(keyed.route(source(spark, at("in")), 6, 2), at("out"), at("ck")).awaitTermination()
    run()
    put(spark, second, at("in"))
    run()  # another run, from the checkpoint
    mark = first[-1][4] - 6 * DAY
    fresh = sorted(r.id for r in keyed.read_routed(spark, at("out"), False).collect())
    late = sorted(r.id for r in keyed.read_routed(spark, at("out"), True).collect())
    assert fresh == sorted({r[2] for r in first} | {r[2] for r in second if r[4] >= mark})
    assert late == sorted(r[2] for r in second if r[4] < mark)
    put(spark, [("p", "n0", "z", "h", 300 * DAY, ZERO, "w1", Decimal(1))], at("in"))
    run()
    put(spark, [("p", "n0", "zz", "h", 301 * DAY, ZERO, "w1", Decimal(1))], at("in"))
    run()
    state = spark.read.format("statestore").option("path", at("ck")).option("stateVarName", "ids").load()
    assert state.count() <= 2  # days behind the mark were dropped

    wallets = lambda: keyed.maintain_wallets(keyed.stream_routed(spark, at("out"), LEDGER_SCHEMA), at("ck2"), at("changed")).awaitTermination()
    wallets()
    kept = [r for r in rows if r[2] in set(fresh)] + [("p", "n0", "z", "h", 300 * DAY, ZERO, "w1", Decimal(1)), ("p", "n0", "zz", "h", 301 * DAY, ZERO, "w1", Decimal(1))]
    assert held(keyed.wallet_state(spark, at("ck2"))) == replay(kept)
    put(spark, [("p", "n1", "out", "h", 302 * DAY, "w3", ZERO, Decimal(9))], at("in"))
    run()
    wallets()
    assert held(keyed.wallet_state(spark, at("ck2"))) == replay([*kept, ("p", "n1", "out", "h", 302 * DAY, "w3", ZERO, Decimal(9))])
    last = max(int(x.name.split("=")[1]) for x in (tmp_path / "changed").iterdir())
    assert [r.address for r in spark.read.parquet(at(f"changed/batch={last}")).collect()] == ["w3"]


@pytest.mark.parametrize("every", [DAY, DAY // 7, 5 * DAY])
def test_daily_mix_equals_a_replay_of_every_day(spark, every):
    rows = [r if i % 9 else (*r[:7], Decimal(0)) for i, r in enumerate(rows_of(5, 90, 6, every))]
    rows += [("q", "n0", "q1", "h", 3 * DAY - 1, ZERO, "x", Decimal(4)), ("q", "n0", "q2", "h", 3 * DAY, "x", ZERO, Decimal(4))]
    last = max(r[4] for r in rows) // DAY
    want = {}
    for p in ("p", "q"):
        mine = [r for r in rows if r[0] == p]
        for day in range(min(r[4] for r in mine) // DAY, last + 1):
            now = day * DAY + DAY - 1
            balance, flow = Counter(), defaultdict(lambda: [0, 0])
            for _, _, _, _, t, a, b, v in mine:
                if t <= now:
                    for who, side in ((b, 0), (a, 1)):
                        if who != ZERO:
                            balance[who] += int(v) * (1 - 2 * side)
                            if t >= now - 90 * DAY:
                                flow[who][side] += int(v)
            count = Counter()
            for who, v in balance.items():
                if v > 0:
                    i, o = flow[who]
                    count["active" if i and o else "accumulating" if i else "distributing" if o else "dormant"] += 1
            want[p, day] = tuple(count[x] for x in ("dormant", "active", "accumulating", "distributing"))
    got = {(r["product"], (r.day - datetime.date(1970, 1, 1)).days): (r.dormant, r.active, r.accumulating, r.distributing) for r in sliding.daily_mix(spark.createDataFrame(rows, LEDGER_SCHEMA)).collect()}
    assert got == want
    assert sliding.daily_mix(spark.createDataFrame([], LEDGER_SCHEMA)).count() == 0


@pytest.mark.parametrize("piece", [3, 50, 10**6])
def test_ordered_scan_equals_one_window(spark, piece):
    from pyspark.sql import Window

    rng = random.Random(6)
    data = [(rng.choice("aaaaab"), rng.randrange(40), i, rng.choice([None, *range(-5, 9)])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, i int, v long")
    v = F.col("v").cast("decimal(38,0)")
    got = ordered_scan(df, ["k"], "t", ["i"], "n", {"s": v}, {"l": F.col("v")}, step=5, piece=piece)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.count("*").over(w).alias("n"), F.coalesce(F.sum(v).over(w), F.lit(0)).cast("decimal(38,0)").alias("s"), F.last("v", True).over(w).alias("l"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    if piece == 3:
        steps = got._jdf.queryExecution().toString()
        assert "_piece" in steps


def test_stream_batches_are_staged_by_many_tasks(spark, tmp_path):
    """Every row in each of its batches, each batch in a file of every task, and a batch without rows brings nothing."""
    from ledgerloom.streaming import streams

    rows = spark.range(0, 400, numPartitions=4)
    some = F.array_compact(F.array(F.when(F.col("id") < 300, "1"), F.when(F.col("id") % 2 == 0, "2")))
    base = str(tmp_path / "feed")
    assert streams.stage_batches(rows, some, base) == ["1", "2"]
    for batch, count in (("1", 300), ("2", 500), ("3", 500)):
        streams.arrive(spark, base, batch)
        assert spark.read.parquet(f"{base}/in").count() == count
    files = [f.rsplit("/", 1)[1][0] for f in spark.read.parquet(f"{base}/in").inputFiles()]
    assert (files.count("1"), files.count("2")) == (3, 4)


def test_daily_mix_shuffles_transfers_before_they_double(spark):
    """One exchange by wallet feeds the sums by day and the running sum."""
    days = sliding.wallet_days(spark.createDataFrame(rows_of(3), LEDGER_SCHEMA))
    physical = days._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_months_shuffle_transfers_once(spark):
    """One exchange by wallet feeds the sums by month and the running sum over them."""
    from pyspark.sql import Window

    from ledgerloom.operators import index

    w = Window.partitionBy("product", "address").orderBy("month")
    changes = index.month_changes(spark.createDataFrame(rows_of(4), LEDGER_SCHEMA)).withColumn("balance", F.sum("net").over(w))
    assert changes._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
