"""Registered queries of maintained state, streams, sliding series, guards and dynamic records, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.numbers import tokens
from ..functions.scores import FACTORS
from ..operators import behaviour, factor_records, holders, index, replay, sliding, supply
from ..sources.dimensions import DECIMALS, NAVS
from ..sources.ledger import DAY, LEDGER_SCHEMA, LEDGER_SQL, day_of, derived_ledger, unix
from ..sources.paged import shared_folder
from .catalog import _SCORES_SQL, _TOP_SQL, _TWINS_SQL, D38, LEGS_SQL, PN, W, _day, _first_run, _readings, ledger_at, query, r, rs


#: Days of ids that are one state key (in each of a unit's buckets) where the stream's horizon is all of history.
ID_DAYS = 180


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rows(spark, sf_dir) -> DataFrame:
    return derived_ledger(spark, sf_dir).select([f.name for f in LEDGER_SCHEMA.fields])


_REPLAY_SQL = f"WITH {LEDGER_SQL}, {LEGS_SQL} SELECT product, network, address, sum(amount)::{D38} AS balance, min(ts_unix) FILTER (is_in) AS first_receipt FROM legs GROUP BY product, network, address"


@query(_REPLAY_SQL)
def bucketed_state_merge(spark, sf_dir):
    """Two runs over the bucketed state table, the first ending inside a day; each rewrites only the slots that change."""
    from ..operators.state_table import StateTable

    base = scratch(spark, "state")
    table = StateTable(spark, f"state_{uuid.uuid4().hex}", base, slots=8, buckets=4)
    ledger = derived_ledger(spark, sf_dir)
    table.advance(_first_run(ledger))
    table.advance(ledger)
    return table.read()


@query(_REPLAY_SQL)
def stream_wallet_state(spark, sf_dir):
    """The ledger in three batches of which each repeats rows of the one before; ids once, wallets kept by the state store.

    Disk: a batch that was read is deleted, and ids are state; the routed table keeps them for late rows only, which a rebuild would ask for.
    """
    from ..streaming import keyed, streams

    base = scratch(spark, "wallets")
    part = F.pmod(F.xxhash64("id"), F.lit(9))
    batches = F.array_compact(F.array(F.when(part < 4, "1"), F.when(part.between(3, 6), "2"), F.when(part >= 6, "3")))
    rows = _rows(spark, sf_dir).drop("hash")
    for batch in streams.stage_batches(rows, batches, base):
        streams.arrive(spark, base, batch)
        source = streams.ledger_stream(spark, f"{base}/in", rows.schema, consume=True)
        routed = keyed.route(source, 10_000, period_days=ID_DAYS).withColumn("id", F.when(F.col("late"), F.col("id")))
        keyed.write_routed(routed, f"{base}/routed", f"{base}/ck1").awaitTermination()
    keyed.maintain_wallets(keyed.stream_routed(spark, f"{base}/routed", rows.schema), f"{base}/ck2").awaitTermination()
    return keyed.wallet_state(spark, f"{base}/ck2")


_B0, _B1, _B1_END, _AGAIN, _B2_END = unix(1995, 1, 1), unix(1996, 1, 1), unix(1996, 7, 1), unix(1996, 2, 1), unix(1997, 1, 1)


@query(f"""WITH {LEDGER_SQL},
early AS (SELECT * FROM ledger WHERE ts_unix < {_B0} OR (ts_unix >= {_B1} AND ts_unix < {_B1_END})),
mark AS (SELECT max(ts_unix) - 90 * {DAY} AS mark FROM early),
third AS (SELECT * FROM ledger WHERE (ts_unix >= {_B0} AND ts_unix < {_B1}) OR (ts_unix >= {_AGAIN} AND ts_unix < {_B2_END}))
SELECT product, network, id, FALSE AS late FROM early
UNION ALL SELECT product, network, id, ts_unix < mark FROM third, mark WHERE ts_unix < mark OR ts_unix >= {_B1_END}""")
def stream_late_rows(spark, sf_dir):
    """Three batches under a watermark of 90 days: the third brings a year that is late, and half a year again."""
    from ..streaming import keyed, streams

    base, t = scratch(spark, "late"), F.col("ts_unix")
    parts = (t < _B0, (t >= _B1) & (t < _B1_END), ((t >= _B0) & (t < _B1)) | ((t >= _AGAIN) & (t < _B2_END)))
    batches = F.array_compact(F.array(*(F.when(some, str(i)) for i, some in enumerate(parts, 1))))
    for batch in streams.stage_batches(_rows(spark, sf_dir), batches, base):
        streams.arrive(spark, base, batch)
        source = streams.ledger_stream(spark, f"{base}/in", LEDGER_SCHEMA, consume=True)
        keyed.write_routed(keyed.route(source, 90, period_days=60), f"{base}/routed", f"{base}/ck").awaitTermination()
    return keyed.routed(spark, f"{base}/routed").select(*PN, "id", "late")


_LABEL = "CASE WHEN inflow = 0 AND outflow = 0 THEN 'dormant' WHEN inflow > 0 AND outflow > 0 THEN 'active' WHEN inflow > 0 THEN 'accumulating' ELSE 'distributing' END"


@query(f"""WITH {LEDGER_SQL}, {LEGS_SQL},
span AS (SELECT product, min(ts_unix) // {DAY} AS a, (SELECT max(ts_unix) // {DAY} FROM ledger) AS b FROM ledger GROUP BY product),
days AS (SELECT product, unnest(range(a, b + 1)) AS d FROM span),
points AS (SELECT DISTINCT product, address, unnest([ts_unix // {DAY}, (ts_unix + 1) // {DAY} + 90]) AS d FROM legs),
states AS (
  SELECT p.product, p.address, p.d, sum(amount) AS balance, coalesce(sum(amount) FILTER (is_in AND ts_unix >= p.d * {DAY} + {DAY - 1 - W}), 0) AS inflow,
    coalesce(sum(-amount) FILTER (NOT is_in AND ts_unix >= p.d * {DAY} + {DAY - 1 - W}), 0) AS outflow
  FROM points p JOIN legs l ON l.product = p.product AND l.address = p.address AND l.ts_unix <= p.d * {DAY} + {DAY - 1} GROUP BY ALL),
spans AS (SELECT product, d, coalesce(lead(d) OVER (PARTITION BY product, address ORDER BY d) - 1, 1000000) AS until, balance, {_LABEL} AS label FROM states),
counts AS (SELECT y.product, y.d, label, count(*) AS n FROM days y JOIN spans s ON s.product = y.product AND y.d BETWEEN s.d AND s.until WHERE balance > 0 GROUP BY ALL)
SELECT y.product, (DATE '1970-01-01' + y.d::INT)::VARCHAR AS day, {", ".join(f"coalesce(sum(n) FILTER (label = '{x.lower()}'), 0)::BIGINT AS {x.lower()}" for x in behaviour.LABELS)}, coalesce(sum(n), 0)::BIGINT AS total
FROM days y LEFT JOIN counts c ON c.product = y.product AND c.d = y.d GROUP BY y.product, y.d""")
def daily_behavior_mix(spark, sf_dir):
    """Holders by behaviour at the end of every day; the SQL evaluates the window anew at each of a wallet's days."""
    return sliding.daily_mix(_rows(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def _vendor_rows(spark, sf_dir) -> DataFrame:
    """Vendor rows of the ledger with faults planted by id, and what is configured of their tokens."""
    x = derived_ledger(spark, sf_dir)
    k = F.length("id") * 31 + F.floor(F.col("ts_unix") / DAY)
    lost = lambda n, c: F.when(k % n != 0, c)
    amount = tokens(F.col("value_raw"), F.col("decimals")).cast("decimal(38,18)").cast("string")
    rows = x.select(
        "id", lost(101, F.when(F.col("kind") != "mint", F.col("from_addr"))).alias("from_address"), lost(103, F.when(F.col("kind") != "burn", F.col("to_addr"))).alias("to_address"),
        F.when(k % 107 == 0, "n/a").otherwise(amount).alias("amount"), lost(109, F.concat(day_of(F.col("ts_unix")).cast("string"), F.lit("T00:00:00Z"))).alias("timestamp"),
        F.struct(F.col("kind").alias("slug")).alias("transaction_type"), F.struct(F.col("product").alias("address"), (F.col("decimals") + F.when(k % 113 == 0, 1).otherwise(0)).alias("decimals")).alias("token"),
    )
    configured = spark.createDataFrame([(p, d, None if p == "p3" else NAVS[p]) for p, d in DECIMALS.items()], "product string, configured int, nav_usd double")
    return rows.join(F.broadcast(configured), F.col("token.address") == F.col("product"))  # five rows


_KEY_SQL = f"(length(id) * 31 + ts_unix // {DAY})"


@query(f"""WITH {LEDGER_SQL}, k AS (SELECT *, {_KEY_SQL} AS k FROM ledger)
SELECT unnest(['rows', 'missing_sender', 'missing_receiver', 'token_decimals', 'amount_text', 'missing_nav', 'missing_time']) AS guard,
  unnest([count(*), count(*) FILTER (k % 101 = 0 AND kind <> 'mint'), count(*) FILTER (k % 103 = 0 AND kind <> 'burn'), count(*) FILTER (k % 113 = 0), count(*) FILTER (k % 107 = 0), count(*) FILTER (product = 'p3'), count(*) FILTER (k % 109 = 0)]) AS violations
FROM k""")
def guard_violations(spark, sf_dir):
    """How many rows break each guard, observed in the one pass that stages them."""
    from ..sources.guards import observed, vendor_guards

    rows, seen = observed(_vendor_rows(spark, sf_dir), vendor_guards())
    rows.write.parquet(scratch(spark, "guarded"))
    return spark.createDataFrame(list(seen.get.items()), "guard string, violations long")


@query(f"""WITH {LEDGER_SQL}, k AS (SELECT *, {_KEY_SQL} AS k FROM ledger)
SELECT id, array_to_string(list_filter([CASE WHEN k % 101 = 0 AND kind <> 'mint' THEN 'missing_sender' END, CASE WHEN k % 103 = 0 AND kind <> 'burn' THEN 'missing_receiver' END, CASE WHEN k % 113 = 0 THEN 'token_decimals' END,
  CASE WHEN k % 107 = 0 THEN 'amount_text' END, CASE WHEN product = 'p3' THEN 'missing_nav' END, CASE WHEN k % 109 = 0 THEN 'missing_time' END], lambda x: x IS NOT NULL), ',') AS broken
FROM k WHERE (k % 101 = 0 AND kind <> 'mint') OR (k % 103 = 0 AND kind <> 'burn') OR k % 113 = 0 OR k % 107 = 0 OR product = 'p3' OR k % 109 = 0""")
def broken_rows(spark, sf_dir):
    """Rows set aside by an ingest that doesn't refuse, with what they break."""
    from ..sources.guards import split_broken, vendor_guards

    return split_broken(_vendor_rows(spark, sf_dir), vendor_guards())[1].select("id", F.array_join("broken", ",").alias("broken"))


_KNOWN_SQL = " UNION ALL ".join(f"SELECT month_end::VARCHAR AS month_end, '{f.key}' AS factor, {rs(f.key, 6)} AS raw, {rs(f'{f.key}_score')} AS score, {rs(f'{f.key}_score * {f.weight}::DOUBLE / present')} AS contribution FROM readings WHERE {f.key} IS NOT NULL" for f in FACTORS)


@query(f"WITH {_SCORES_SQL} {_KNOWN_SQL} UNION ALL SELECT month_end::VARCHAR, 'sentiment', i::DOUBLE / 4, 50.0::DOUBLE, NULL FROM readings WHERE i % 2 = 0")
def factor_records_roundtrip(spark, sf_dir):
    """Readings written with their factors as VARIANT, some with a factor that the code doesn't know, and read again."""
    x = _readings(spark, sf_dir)
    first = x.agg(F.min("month").alias("_first"))
    i = F.col("month") - F.col("_first") + 1
    more = F.when(i % 2 == 0, F.to_json(F.create_map(F.lit("sentiment"), F.struct((i / 4).alias("raw"), F.lit(50.0).alias("score")))))
    path = scratch(spark, "readings")
    x.join(F.broadcast(first)).select("month_end", factor_records.record_of_reading(more).alias("factors")).write.parquet(path)  # one row
    rows = factor_records.contributions(spark.read.parquet(path), ["month_end"])
    return rows.select(_day(), "factor", r(F.col("raw"), 6).alias("raw"), r(F.col("score")).alias("score"), r(F.col("contribution")).alias("contribution"))


@query(f"WITH {LEDGER_SQL}, {_TWINS_SQL} SELECT hash, replace(f, 'ata-', '') AS from_addr, replace(t, 'ata-', '') AS to_addr, value_raw::{D38} AS value_raw, min(id) AS id FROM feed GROUP BY ALL")
def stream_twin_dedup(spark, sf_dir):
    """The two feeds of ``twin_dedup`` as live streams, each in two batches, one behind the other; a last row each moves the watermark to the end."""
    from ..streaming import streams, twins

    base = scratch(spark, "twins")
    ledger, end = derived_ledger(spark, sf_dir), unix(2030, 1, 1)
    account = lambda c: F.when(F.col(c).startswith("s"), F.concat(F.lit("ata-"), c)).otherwise(F.col(c)).alias(c)
    cols = ["hash", "from_addr", "to_addr", "value_raw", "id", "ts_unix"]
    feeds = {
        "dash": ledger.select("hash", account("from_addr"), account("to_addr"), "value_raw", F.concat(F.lit("2-"), "hash", F.lit("-0")).alias("id"), "ts_unix"),
        "under": ledger.where(F.length("id") % 2 == 0).select("hash", "from_addr", "to_addr", "value_raw", F.concat(F.lit("2_"), "hash", F.lit("_1_"), (F.col("value_raw") % 3).cast("string")).alias("id"), "ts_unix"),
    }
    last = spark.createDataFrame([("end", "x", "y", 0, "end", end)], "hash string, from_addr string, to_addr string, value_raw long, id string, ts_unix long").withColumn("value_raw", F.col("value_raw").cast("decimal(38,0)"))
    for name, rows in feeds.items():
        half = unix(1996, 1, 1) if name == "dash" else unix(1995, 1, 1)
        batch = F.when(F.col("ts_unix") < half, "1").when(F.col("ts_unix") < end, "2").otherwise("3")
        streams.stage_batches(rows.select(cols).unionByName(last.select(cols)), F.array(batch), f"{base}/{name}")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("owner"))
    owners = s.select(F.concat(F.lit("ata-"), "owner").alias("account"), "owner")
    for batch in "123":
        for name in feeds:
            streams.arrive(spark, f"{base}/{name}", batch)
        live = [streams.ledger_stream(spark, f"{base}/{name}/in", last.select(cols).schema, consume=True) for name in feeds]
        twins.write_twins(twins.one_of_twins(live, owners, apart_days=4000, delay_days=4000), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").where("hash <> 'end'").select("hash", "from_addr", "to_addr", "value_raw", "id")


@query(f"""WITH {LEDGER_SQL}
SELECT 'transfers' AS sink, product, count(*) AS n, sum(value_raw)::{D38} AS value_raw FROM ledger GROUP BY product
UNION ALL SELECT 'days', product, count(*), NULL FROM ledger GROUP BY product
UNION ALL SELECT 'mints', product, count(*), sum(value_raw)::{D38} FROM ledger WHERE kind = 'mint' GROUP BY product""")
def routed_sinks(spark, sf_dir):
    """The ledger written to three tables in one pass and one commit, then counted in each."""
    from ..sources import sinks

    path = scratch(spark, "sinks")
    rows = derived_ledger(spark, sf_dir).select("product", "network", "ts_unix", "kind", "value_raw")
    routed = sinks.split_rows(rows, {"transfers": ["product", "network", "value_raw"], "days": ["product", "ts_unix"], "mints": ["product", "kind", "value_raw"]})
    sinks.write_sinks(routed.where("sink <> 'mints' or mints.kind = 'mint'"), path)
    count = lambda sink, value: sinks.read_sink(spark, path, sink).groupBy("product").agg(F.count("*").alias("n"), value.cast("decimal(38,0)").alias("value_raw")).select(F.lit(sink).alias("sink"), "product", "n", "value_raw")
    return count("transfers", F.sum("value_raw")).unionByName(count("days", F.max(F.lit(None)))).unionByName(count("mints", F.sum("value_raw")))


_CELLS_SQL = " || '  ' || ".join(f"CASE WHEN {f.key} IS NULL THEN rpad('-', 16, ' ') ELSE rpad(printf('%.3f(%.0f)', {rs(f.key, 3)}, {rs(f.key + '_score', 0)}), 16, ' ') END" for f in FACTORS)


@query(f"WITH {_SCORES_SQL} SELECT month_end::VARCHAR AS month_end, month_end::VARCHAR || '  ' || printf('%6.2f', composite) || '  ' || CASE WHEN len(missing) > 0 THEN '*' ELSE ' ' END || '  ' || {_CELLS_SQL} AS line FROM readings")
def calibration_lines(spark, sf_dir):
    """The printed calibration table."""
    return index.calibration_rows(_readings(spark, sf_dir)).select(_day(), "line")


@query(f"WITH {_TOP_SQL}, outside AS (SELECT product, 2 * sum(value_raw) AS supply FROM ledger WHERE kind = 'mint' GROUP BY product) SELECT product, rank::INT AS rank, address, ((balance * 10000) // supply)::DOUBLE / 100 AS share_of_supply_pct FROM ranked JOIN outside USING (product) WHERE rank <= 10")
def holder_stats_read_supply(spark, sf_dir):
    """Holders against total supplies that are read from a saved query's results, some of them in scientific notation."""
    ledger = derived_ledger(spark, sf_dir)
    raw = ledger.where("kind = 'mint'").groupBy("product").agg((F.sum("value_raw") * 2).cast("decimal(38,0)").alias("s"))
    text = F.when(F.col("product").isin("p1", "p3"), F.concat(F.col("s").cast("string"), F.lit("E0"))).otherwise(F.col("s").cast("string"))
    page = lambda day, value: F.struct(F.upper("product").alias("contract_address"), F.lit(f"{day} 00:00:00.000 UTC").alias("day"), value.alias("supply_raw"))
    rows = raw.select(F.explode(F.array(page("2001-06-29", F.lit("1")), page("2001-06-30", text), page("2001-07-01", F.lit("n/a")))).alias("r"))
    path = scratch(spark, "results")
    rows.groupBy(F.lit(1)).agg(F.collect_list("r").alias("rows")).select(F.struct("rows").alias("result")).write.json(path)  # three rows a product
    known = supply.latest_supply(supply.read_saved_results(spark, path)).withColumnRenamed("contract", "product")
    x = holders.holder_stats(replay.balances(ledger_at(spark, sf_dir), ("product",)), known)
    return x.select("product", F.col("rank").cast("int").alias("rank"), "address", "share_of_supply_pct")


_V = "(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 100.0 ELSE 100000.0 END::DOUBLE)"
_F = "((o_orderkey % 2001 - 1000)::DOUBLE / 997)"


@query(f"""SELECT o_orderkey, printf('%.1f%%', round({_F} * 100, 1)) AS percent, CASE WHEN {_F} >= 0 THEN '+' ELSE '' END || printf('%.1fpp', round({_F} * 100, 1)) AS points, '×' || printf('%.2f', round({_F}, 2)) AS ratio,
  CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE format('{{:,}}', o_custkey * 1000) END AS count,
  CASE WHEN {_V} >= 1e9 THEN printf('%.2fB', round({_V} / 1e9, 2)) WHEN {_V} >= 1e6 THEN printf('%.2fM', round({_V} / 1e6, 2)) WHEN {_V} >= 1e3 THEN printf('%.1fK', round({_V} / 1e3, 1)) END AS amount,
  strftime(o_orderdate, '%b %Y') AS month, strftime(o_orderdate, '%b %-d') AS day, substr('0x' || md5(o_orderkey::VARCHAR), 1, 6) || '…' || right(md5(o_orderkey::VARCHAR), 4) AS short FROM orders""")
def display_rules(spark, sf_dir):
    """How a page shows shares, points, ratios, counts, amounts, months, days and addresses."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    v = F.col("o_totalprice") * F.when(k % 4 == 0, 0.001).when(k % 4 == 1, 1.0).when(k % 4 == 2, 100.0).otherwise(100000.0)
    f = (k % 2001 - 1000).cast("double") / 997.0
    return o.select(
        "o_orderkey", formats.percent(f).alias("percent"), formats.signed(f, "pp").alias("points"), formats.ratio(f).alias("ratio"), formats.count(F.when(k % 7 != 0, F.col("o_custkey") * 1000)).alias("count"),
        F.when(v >= 1000, formats.token_amount(v)).alias("amount"), formats.month_year(F.col("o_orderdate")).alias("month"), formats.short_date(F.col("o_orderdate")).alias("day"),
        formats.short_address(F.concat(F.lit("0x"), F.md5(k.cast("string").cast("binary")))).alias("short"),
    )
