"""Golden values of the ledger operators, by fixture number."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import formats, schedule
from ledgerloom.functions.numbers import integer_text, integer_text_or_zero, permyriad, to_raw_units, tokens
from ledgerloom.functions.scores import FACTORS, factor_score, normalize
from ledgerloom.operators import behaviour, incremental, index, replay
from ledgerloom.sources import dimensions
from ledgerloom.sources.ledger import DAY, ZERO, canonical, normalise_vendor, VENDOR_SCHEMA, explode_supply, SUPPLY_SCHEMA
from ledgerloom.sources.store import write_routes

LEDGER = "product string, network string, id string, hash string, ts_unix long, from_addr string, to_addr string, value_raw decimal(38,0)"


def ledger(spark, rows):
    return spark.createDataFrame([("p", "n", i, f"h{i}", ts, f, t, v) for i, ts, f, t, v in rows], LEDGER.replace("decimal(38,0)", "long")).withColumn("value_raw", F.col("value_raw").cast("decimal(38,0)"))


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_g1_to_g3_scores(spark):
    raw = [(x,) for x in (-0.5, -0.4, -0.2, 0.0, 0.325, 0.65, 1.0)]
    assert values(spark, factor_score(FACTORS[0], F.col("x")), raw, "x double") == [0, 0, 25, 50, 75, 100, 100]
    assert values(spark, factor_score(FACTORS[5], F.col("x")), [(x,) for x in (0.0, 1.0, 3.5, 6.0, 10.0)], "x double") == [0, 0, 50, 100, 100]
    assert values(spark, factor_score(FACTORS[2], F.col("x")), [(-0.15,), (0.0,), (0.15,)], "x double") == [100, 50, 0]
    assert values(spark, factor_score(FACTORS[3], F.col("x")), [(-0.35,), (0.35,), (None,)], "x double") == [100, 0, None]
    assert values(spark, normalize(F.col("x"), 1.0, 1.0, 1.0), [(0.5,), (2.0,)], "x double") == [50, 50]


def readings(spark, **given):
    row = {"month": 1, "month_end": "2024-01-31", **{f.key: None for f in FACTORS}, **given}
    return index.composite(spark.createDataFrame([tuple(row.values())], "month int, month_end string, " + ", ".join(f"{f.key} double" for f in FACTORS)))


def test_g4_to_g8_composite(spark):
    neutral = dict(aumGrowth3m=0.0, holderGrowth3m=0.0, concentrationDelta3m=0.0, dormancyDelta3m=0.0, transferActivityRatio=1.0, breadth=3.5)
    r = readings(spark, **neutral).first()
    assert (r.composite, r.is_partial, r.partial_reason) == (50, False, None)
    r = readings(spark, breadth=6.0).first()
    assert r.composite == 100 and r.is_partial and r.partial_reason.startswith("5 factor(s)") and list(r.factors) == ["breadth"]
    r = readings(spark, aumGrowth3m=0.65, holderGrowth3m=0.0, concentrationDelta3m=0.0, dormancyDelta3m=0.0).first()
    assert abs(r.composite - 65.63) <= 0.01 and r.factors["aumGrowth3m"].score == 100
    best = dict(aumGrowth3m=1.0, holderGrowth3m=1.0, concentrationDelta3m=-1.0, dormancyDelta3m=-1.0, transferActivityRatio=9.0, breadth=6.0)
    assert readings(spark, **best).first().composite == 100
    assert readings(spark, **{k: -v for k, v in best.items()}).first().composite == 0
    with pytest.raises(Exception, match="no factors available"):
        readings(spark).collect()


def test_window_edges_exits_and_self_transfer(spark):
    now = 2_000_000_000
    edge = now - replay.WINDOW
    rows = [("1", edge - 10, ZERO, "A", 100), ("2", edge, "a", "B", 100), ("3", edge - 1, ZERO, "D", 70), ("4", edge - 5, ZERO, "F", 50), ("5", now, "f", "F", 20), ("6", edge - 9, ZERO, "E", 5), ("7", edge - 8, "E", ZERO, 5)]
    w = replay.wallets(replay.legs(ledger(spark, rows)), now)
    got = {r.address: (int(r.balance), r.behavior) for r in behaviour.classify(w).collect()}
    assert got == {"b": (100, "Accumulating"), "d": (70, "Dormant"), "f": (50, "Active")}
    s = behaviour.stats(w, now, ["product"]).first()
    assert (s.holder_count, s.net_new_wallets_90d, s.exited_wallets_90d) == (3, 1, 1)
    assert s.dormancy_share_pct == 77.27 and s.net_accumulation_ratio == 1.0


STREAM = [(f"{i}", d * DAY + h * 3600, f, t, v) for i, d, h, f, t, v in [
    (1, 1, 0, ZERO, "A", 100), (2, 1, 5, ZERO, "B", 200), (3, 2, 0, "A", "C", 30), (4, 3, 0, "B", "D", 50), (5, 4, 1, "C", "E", 10), (6, 5, 0, ZERO, "A", 40), (7, 6, 0, "A", "B", 25),
    (8, 7, 0, "D", ZERO, 5), (9, 8, 0, "B", "C", 35), (10, 9, 2, "E", "A", 10), (11, 9, 6, "C", "D", 15), (12, 9, 9, "A", "E", 20), (13, 11, 1, "E", "B", 5), (14, 11, 6, "D", "C", 5)]]


@pytest.mark.parametrize("cut", [1, 5, 11, 12, 14])
def test_g11_to_g13_increments_equal_one_replay(spark, cut):
    full = ledger(spark, STREAM)
    first = ledger(spark, STREAM[:cut])
    state, cursor = incremental.merge(None, incremental.deltas(first)), incremental.next_cursor(first, None)
    fetched = incremental.since_cursor(full, cursor)
    fresh = incremental.drop_boundary(fetched, cursor)
    assert sorted(int(r.id) for r in fresh.collect()) == list(range(cut + 1, 15))
    both = {tuple(r) for r in incremental.merge(state, incremental.deltas(fresh)).collect()}
    assert both == {tuple(r) for r in incremental.merge(None, incremental.deltas(full)).collect()}
    assert {(c.last_ts, c.id) for c in incremental.next_cursor(fresh, cursor).collect()} == {(11 * DAY + 6 * 3600, i) for i in ("13", "14")}
    if cut == 11:
        assert sorted(c.id for c in cursor.collect()) == ["10", "11"]
        assert (fetched.count(), fetched.count() - fresh.count(), fresh.count()) == (5, 2, 3)


def test_same_day_ids_are_carried_forward(spark):
    rows = [("1", DAY, ZERO, "A", 9), ("2", 2 * DAY + 1, "A", "B", 1), ("3", 2 * DAY + 2, "A", "B", 1)]
    c1 = incremental.next_cursor(ledger(spark, rows), None)
    again = ledger(spark, [*rows, ("4", 2 * DAY + 2, "B", "A", 1)])
    f = incremental.drop_boundary(incremental.since_cursor(again, c1), c1)
    c2 = incremental.next_cursor(f, c1)
    assert [r.id for r in f.collect()] == ["4"] and sorted(r.id for r in c2.collect()) == ["2", "3", "4"]
    f = incremental.drop_boundary(incremental.since_cursor(again, c2), c2)
    assert f.count() == 0 and sorted(incremental.next_cursor(f, c2).collect()) == sorted(c2.collect())
    assert incremental.drop_boundary(again, None).count() == 4


def test_g14_reentry_keeps_first_receipt(spark):
    d = DAY
    rows = [("1", d, ZERO, "X", 100), ("2", 2 * d, "X", "Y", 100), ("3", 10 * d, ZERO, "Z", 30), ("4", 12 * d, "Z", "Y", 30), ("5", 150 * d, "Y", "X", 40), ("6", 201 * d, ZERO, "W", 30)]
    state = {r.address: r for r in incremental.merge(incremental.merge(None, incremental.deltas(ledger(spark, rows[:4]))), incremental.deltas(ledger(spark, rows[4:]))).collect()}
    assert int(state["x"].balance) == 40 and state["x"].first_receipt == d
    assert int(state["z"].balance) == 0 and state["z"].first_receipt == 10 * d


def test_g15_case(spark):
    rows = [("1", 1, ZERO, "AbC", 70), ("2", 2, ZERO, "abc", 40)]
    assert sorted(int(r.balance) for r in replay.balances(ledger(spark, rows), case_sensitive=True).collect()) == [40, 70]
    assert [int(r.balance) for r in replay.balances(ledger(spark, rows)).collect()] == [110]
    assert values(spark, canonical(F.col("a"), dimensions.is_case_sensitive(F.col("n"))), [("Ab", 2), ("Ab", 1)], "a string, n int") == ["Ab", "ab"]


def test_g16_g17_numbers(spark):
    got = values(spark, to_raw_units(F.col("a"), F.col("d")), [("1", 6), ("1.5", 6), ("1", 18), ("-0.000001", 6), ("399584954.82", 18)], "a string, d int")
    assert [int(x) for x in got] == [1000000, 1500000, 10**18, -1, 399584954820000000000000000]
    assert [int(x) for x in values(spark, integer_text(F.col("t")), [("449946534147315186905",), ("100.000",)], "t string")] == [449946534147315186905, 100]
    with pytest.raises(Exception, match="not an integer"):
        values(spark, integer_text(F.col("t")), [("100.5",)], "t string")
    assert [int(x) for x in values(spark, integer_text_or_zero(F.col("t")), [("12",), ("x",), (None,)], "t string")] == [12, 0, 0]
    big = spark.createDataFrame([(10**17 - 1, 10**17)], "a long, b long").select(F.col("a").cast("decimal(38,0)").alias("a"), F.col("b").cast("decimal(38,0)").alias("b"))
    assert big.select(permyriad(F.col("a"), F.col("b"))).first()[0] == 9999
    assert values(spark, tokens(F.col("r").cast("decimal(38,0)"), F.col("d")), [("1500000000000000000000000001", 18), ("-5", 6)], "r string, d int") == [1500000000.0, -0.000005]


def test_g19_twins(spark):
    rows = ledger(spark, [("2-h-0", 1, "ata1", "x", 5), ("2_h_1_0", 1, "own", "x", 5), ("2_h2_1_0", 1, "ata2", "y", 7), ("2-h3-0", 1, ZERO, "z", 1)]).withColumn("hash", F.regexp_extract("id", "h[0-9]*", 0))
    owners = spark.createDataFrame([("ata1", "own"), ("ata2", None)], "account string, owner string")
    got = {r.id: r.from_addr for r in incremental.resolve_twins(rows, owners).collect()}
    assert got == {"2-h-0": "own", "2_h2_1_0": "ata2", "2-h3-0": ZERO}
    bad = spark.createDataFrame([("ata1", None)], "account string, owner string")
    with pytest.raises(Exception, match="no owner"):
        incremental.resolve_twins(rows, bad).collect()


def test_g20_to_g23_schedule(spark):
    assert values(spark, schedule.halved_span(F.col("x")), [(x,) for x in (30, 60, 15, 7, 2, 1)], "x int") == [15, 30, 7, 3, 1, 1]
    assert values(spark, schedule.next_span(F.col("d"), F.col("p")), [(30, 90), (30, 10), (30, 40), (10, 0), (40, 0)], "d int, p int") == [13, 60, 30, 20, 60]
    rows = [(20, 15, 45, 80), (20, 15, 45, 9), (5, 15, 45, 80), (30, 0, 0, 80), (20, 15, 45, 1)]
    assert values(spark, schedule.capped_span(F.col("c"), F.col("d"), F.col("p"), F.col("b")), rows, "c int, d int, p int, b int") == [13, 3, 5, 30, 1]
    items = [("1", i, c) for i, c in enumerate([10, 10, 10])] + [("2", i, 40) for i in range(3)] + [("3", i, 50) for i in range(3)]
    got = schedule.sequential_budget(spark.createDataFrame(items, "g string, i int, c int"), "i", "c", 80, ["g"]).groupBy("g").agg(F.count_if("runs")).collect()
    assert {r[0]: r[1] for r in got} == {"1": 3, "2": 2, "3": 2}
    http = [(500, ""), (400, "read ECONNRESET"), (400, "bad filter"), (429, "")]
    assert values(spark, schedule.http_retryable(F.col("s"), F.col("b")), http, "s int, b string") == [True, True, False, False]
    assert values(spark, schedule.rate_limited(F.col("m")), [("HTTP 429 slow",), ("HTTP 4290",), (None,)], "m string") == [True, False, False]


def test_g24_routes():
    assert write_routes("usdy", "solana", True) == {"tags": False, "classifications": False, "stats": True, "history": True}
    assert write_routes("ustb", "plume", False)["tags"] is False and write_routes("ustb", "ethereum", False)["tags"] is True


def test_vendor_rows(spark):
    from decimal import Decimal

    rows = [("1", None, "0xB", Decimal("1.5"), "2024-01-02T03:04:05Z", "h1", ("token_mint",), ("0xTok", 6)), ("2", "0xB", None, Decimal("1"), "2024-01-03T00:00:00Z", "h2", ("burn",), ("0xtok", 6)), ("3", "a", "b", Decimal("9"), "2024-01-03T00:00:00Z", "h3", None, ("0xother", 2))]
    df = spark.createDataFrame(rows, VENDOR_SCHEMA)
    got = normalise_vendor(df, "p", "n", 6, ["0xTOK"]).orderBy("id").collect()
    assert [(r.from_addr, r.to_addr, int(r.value_raw)) for r in got] == [(ZERO, "0xB", 1500000), ("0xB", ZERO, 1000000)]
    assert normalise_vendor(df, "p", "n", 6, ["0xtok"], since="2024-01-03").count() == 1
    with pytest.raises(Exception, match="decimals"):
        normalise_vendor(df, "p", "n", 6).collect()
    lost = spark.createDataFrame([("4", None, "x", Decimal("1"), "2024-01-03T00:00:00Z", "h", ("transfer",), ("0xtok", 6))], VENDOR_SCHEMA)
    with pytest.raises(Exception, match="missing sender"):
        normalise_vendor(lost, "p", "n", 6).collect()


def test_supply_pages(spark):
    pages = spark.createDataFrame([([([("0xA", 6, 1, "e", (5.0,)), ("0xb", 6, 1, "e", None)],)],)], SUPPLY_SCHEMA)
    assert [tuple(r) for r in explode_supply(pages).collect()] == [("0xa", 1, 6, 5.0)]
    from ledgerloom.operators.supply import supply_by_network

    want = spark.createDataFrame([("p", 1, "0xA", 6), ("p", 1, "0xB", 6), ("q", 2, "0xC", 6)], "product string, network_id int, address string, decimals int")
    got = {r.product: (r.supply, r.missing) for r in supply_by_network(want, explode_supply(pages)).collect()}
    assert got == {"p": (5.0, ["0xb"]), "q": (None, ["0xc"])}


def test_dimensions(spark):
    assert values(spark, dimensions.is_custodian(F.col("t")), [("Coinbase 3",), ("a Gnosis Safe",), ("alice",), (None,)], "t string") == [True, True, False, False]
    toks = [(1, "eth", "0xA", True, 6), (1, "eth", "0xB", True, None), (2, "sol", "S", False, 6)]
    df = spark.createDataFrame([("p", 6, 1.0, None, toks)], dimensions.PRODUCT_SCHEMA)
    assert [tuple(r) for r in dimensions.observable_networks(df).collect()] == [("p", 1, "eth", ["0xa", "0xb"], 6)]
    with pytest.raises(Exception, match="conflicting decimals"):
        dimensions.observable_networks(spark.createDataFrame([("p", 18, 1.0, None, toks)], dimensions.PRODUCT_SCHEMA)).collect()
    with pytest.raises(Exception, match="without nav_usd"):
        dimensions.active(spark.createDataFrame([("p", None, None)], "slug string, nav_usd double, active boolean")).collect()


def test_formats(spark):
    f = lambda c, rows, schema="x double": values(spark, c(F.col("x")), rows, schema)
    assert f(formats.usd, [(2.5e9,), (1.25e6,), (1500.0,), (12.0,)]) == ["$2.50B", "$1.3M", "$2K", "$12"]
    assert f(formats.percent, [(0.1234,), (None,)]) == ["12.3%", "—"]
    assert f(formats.token_amount, [(1234567.0,), (1500.0,), (12.5,), (3.0,)]) == ["1.23M", "1.5K", "12.5", "3"]
    assert f(formats.short_address, [("0x1234567890abcd",)], "x string") == ["0x1234…abcd"]
    assert f(formats.key_label, [("someNewFactor2m",)], "x string") == ["Some New Factor 2m"]
    assert values(spark, formats.factor_raw(F.col("k"), F.col("x")), [("aumGrowth3m", 0.1), ("dormancyDelta3m", -0.02), ("transferActivityRatio", 1.0), ("breadth", 6.0)], "k string, x double") == ["+10.0%", "-2.0pp", "×1.00", "6"]


def test_month_blocks_tile_their_interval(spark):
    import random

    rng = random.Random(3)
    pairs = [(a, a + rng.choice([0, 1, 5, 40, 300, 9000])) for a in (rng.randint(0, 30_000) for _ in range(120))]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", F.filter(index.blocks(F.col("a"), F.col("b")), lambda t: t.isNotNull()).alias("t"))
    for r in df.collect():
        months = [m for t in r.t for m in range(t.block << t.level, (t.block + 1) << t.level)]
        assert sorted(months) == list(range(r.a, r.b + 1)) and len(r.t) <= 26


def test_display_rounding_is_that_of_sql(spark):
    """Products with a power of ten that fall just short of a half, where digits of the decimal text would round up."""
    import duckdb

    f = lambda c, rows: values(spark, c(F.col("x")), [(x,) for x in rows], "x double")
    sql = lambda form, scale, digits, rows: [duckdb.connect().execute(f"SELECT printf('{form}', round({x!r}::DOUBLE / {scale}, {digits}))").fetchone()[0] for x in rows]
    billions, millions = [1.005e9, 1.015e9, 1.025e9, 2.5e9, 1e20], [520675000.0, 147855000.0, 565935000.0, 1.25e6]
    assert f(formats.usd, billions) == sql("$%.2fB", "1e9", 2, billions)
    assert f(formats.usd, billions[:1]) == ["$1.00B"]
    assert f(formats.token_amount, millions) == sql("%.2fM", "1e6", 2, millions)
    assert f(formats.token_amount, billions) == sql("%.2fB", "1e9", 2, billions)
