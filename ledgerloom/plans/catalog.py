"""Every registered ledger query with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, schedule
from ..functions.numbers import RAW, dollars, half_up, tokens
from ..functions.scores import FACTORS, normalize_sql
from ..operators import behaviour, holders, incremental, index, replay, supply, views
from ..sources.dimensions import KNOWN_ADDRESSES, PRODUCTS_SQL, is_custodian, products
from ..sources.ledger import DAY, LEDGER_SQL, NOW, NOW_EARLY, ZERO, day_of, derived_ledger, unix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PN = ["product", "network"]
W = replay.WINDOW


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(x, digits: int = 4):
    return half_up(x, digits)


def rs(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE"


def fd(x: str, d: str) -> str:
    """floor(x / d) of HUGEINTs."""
    return f"((({x}) - (((({x}) % ({d})) + ({d})) % ({d}))) // ({d}))"


def micro_sql(raw: str, decimals: str, nav: str) -> str:
    """Millionths of a dollar in integers, as ``numbers.usd_micro``."""
    scale, price = f"pow(10, {decimals})::HUGEINT", f"round({nav} * 1000000)::HUGEINT"
    rest = f"((({raw}) % {scale}) + {scale}) % {scale}"
    return f"((({raw}) - ({rest})) // {scale} * {price} + {fd(f'({rest}) * {price} * 2 + {scale}', f'2 * {scale}')})"


def dollars_sql(micro: str, digits: int = 2) -> str:
    step = 10 ** (6 - digits)
    return f"{fd(f'{micro} + {step // 2}', str(step))}::DOUBLE / {10**digits}::DOUBLE"


def ledger_at(spark: SparkSession, sf_dir: str, now: int = NOW) -> DataFrame:
    return derived_ledger(spark, sf_dir).where(F.col("ts_unix") <= now)


def wallets_at(spark: SparkSession, sf_dir: str, now: int = NOW, keys: tuple[str, ...] = ("product", "network")) -> DataFrame:
    return replay.wallets(replay.legs(ledger_at(spark, sf_dir, now), keys), now, keys)


LEGS_SQL = f"""legs AS (
  SELECT product, network, ts_unix, to_addr AS address, value_raw AS amount, TRUE AS is_in FROM ledger WHERE to_addr <> '{ZERO}'
  UNION ALL SELECT product, network, ts_unix, from_addr, -value_raw, FALSE FROM ledger WHERE from_addr <> '{ZERO}')"""


def wallets_sql(now: int = NOW, keys: str = "product, network") -> str:
    return f"""{LEDGER_SQL}, {LEGS_SQL},
wallets AS (
  SELECT {keys}, address, sum(amount) AS balance,
    coalesce(sum(amount) FILTER (is_in AND ts_unix >= {now - W}), 0) AS inflow,
    coalesce(sum(-amount) FILTER (NOT is_in AND ts_unix >= {now - W}), 0) AS outflow,
    min(ts_unix) FILTER (is_in) AS first_receipt
  FROM legs WHERE ts_unix <= {now} GROUP BY {keys}, address),
labelled AS (
  SELECT *, CASE WHEN inflow = 0 AND outflow = 0 THEN 'Dormant' WHEN inflow > 0 AND outflow > 0 THEN 'Active' WHEN inflow > 0 THEN 'Accumulating' ELSE 'Distributing' END AS behavior
  FROM wallets WHERE balance > 0)"""


D38 = "DECIMAL(38,0)"

# ---- ledger, balances, behaviour ---------------------------------------------------------------


@query(f"WITH {LEDGER_SQL} SELECT product, network, id, hash, ts_unix, kind, from_addr, to_addr, value_raw::{D38} AS value_raw FROM ledger")
def ledger_normalised(spark, sf_dir):
    return derived_ledger(spark, sf_dir).drop("decimals")


@query(f"WITH {LEDGER_SQL}, {LEGS_SQL} SELECT product, network, address, ts_unix, is_in, amount::{D38} AS amount FROM legs")
def ledger_legs(spark, sf_dir):
    return replay.legs(derived_ledger(spark, sf_dir))


@query(f"WITH {wallets_sql(keys='product')} SELECT product, address, balance::{D38} AS balance FROM wallets WHERE balance > 0")
def balances_asof(spark, sf_dir):
    return replay.balances(ledger_at(spark, sf_dir), ("product",))


@query(f"WITH {wallets_sql()} SELECT product, network, address, inflow::{D38} AS inflow, outflow::{D38} AS outflow FROM wallets WHERE inflow > 0 OR outflow > 0")
def holder_flows_90d(spark, sf_dir):
    return wallets_at(spark, sf_dir).where("inflow > 0 or outflow > 0").select(*PN, "address", "inflow", "outflow")


@query(f"WITH {wallets_sql()} SELECT product, network, address, behavior, balance::{D38} AS balance, inflow::{D38} AS inflow, outflow::{D38} AS outflow FROM labelled")
def holder_labels(spark, sf_dir):
    return behaviour.classify(wallets_at(spark, sf_dir)).select(*PN, "address", "behavior", "balance", "inflow", "outflow")


@query(f"WITH {wallets_sql()} SELECT product, network, address, behavior FROM labelled")
def holder_labels_joined(spark, sf_dir):
    """Labels from balances and window flows kept as separate tables."""
    ledger = ledger_at(spark, sf_dir)
    flows = wallets_at(spark, sf_dir).where("inflow > 0 or outflow > 0").select(*PN, "address", "inflow", "outflow")
    return behaviour.classify_joined(replay.balances(ledger), flows, [*PN, "address"]).select(*PN, "address", "behavior")


_MIX = ", ".join(f"count(*) FILTER (behavior = '{x}') AS {x.lower()}" for x in behaviour.LABELS)


@query(f"WITH {wallets_sql(keys='product')} SELECT product, {_MIX}, count(*) AS total FROM labelled GROUP BY product")
def behavior_mix(spark, sf_dir):
    return behaviour.mix(behaviour.classify(wallets_at(spark, sf_dir, keys=("product",))), ["product"])


@query(f"WITH {wallets_sql(keys='product')} SELECT product, " + ", ".join(rs(f"100.0::DOUBLE * count(*) FILTER (behavior = '{x}') / count(*)") + f" AS {x.lower()}_pct" for x in behaviour.LABELS) + " FROM labelled GROUP BY product")
def behavior_mix_percent(spark, sf_dir):
    x = behaviour.mix_percent(behavior_mix(spark, sf_dir))
    return x.select("product", *(r(F.col(f"{c.lower()}_pct")).alias(f"{c.lower()}_pct") for c in behaviour.LABELS))


@query(f"WITH {wallets_sql()} SELECT product, network, coalesce(((sum(balance) FILTER (outflow = 0)) * 10000) // sum(balance), 0)::DOUBLE / 100 AS dormancy_share_pct FROM labelled GROUP BY product, network")
def dormancy_share(spark, sf_dir):
    return behaviour.stats(wallets_at(spark, sf_dir), NOW, PN).select(*PN, "dormancy_share_pct")


@query(f"WITH {wallets_sql(NOW_EARLY)} SELECT product, network, count(*) FILTER (balance > 0 AND first_receipt >= {NOW_EARLY - W}) AS net_new_wallets_90d, count(*) FILTER (balance <= 0 AND outflow - inflow > 0) AS exited_wallets_90d FROM wallets GROUP BY product, network")
def net_new_exited(spark, sf_dir):
    return behaviour.stats(wallets_at(spark, sf_dir, NOW_EARLY), NOW_EARLY, PN).select(*PN, "net_new_wallets_90d", "exited_wallets_90d")


@query(f"WITH {wallets_sql(NOW_EARLY)} SELECT product, network, address FROM wallets WHERE outflow - inflow > 0 AND balance <= 0")
def exited_addresses(spark, sf_dir):
    w = wallets_at(spark, sf_dir, NOW_EARLY)
    return behaviour.exited_addresses(w.select(*PN, "address", "inflow", "outflow"), w.where("balance > 0").select(*PN, "address"), [*PN, "address"]).select(*PN, "address")


def _stats_select(now: int, keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (balance > 0) AS holder_count,
  count(*) FILTER (balance > 0 AND inflow = 0 AND outflow = 0) AS behavior_dormant, count(*) FILTER (balance > 0 AND inflow > 0 AND outflow > 0) AS behavior_active,
  count(*) FILTER (balance > 0 AND inflow > 0 AND outflow = 0) AS behavior_accumulating, count(*) FILTER (balance > 0 AND inflow = 0 AND outflow > 0) AS behavior_distributing,
  count(*) FILTER (balance > 0 AND first_receipt >= {now - W}) AS net_new_wallets_90d, count(*) FILTER (balance <= 0 AND outflow - inflow > 0) AS exited_wallets_90d,
  coalesce(((sum(balance) FILTER (balance > 0 AND outflow = 0)) * 10000) // sum(balance) FILTER (balance > 0), 0)::DOUBLE / 100 AS dormancy_share_pct,
  {rs("count(*) FILTER (balance > 0 AND inflow > 0 AND outflow = 0)::DOUBLE / nullif(count(*) FILTER (balance > 0 AND (inflow > 0) <> (outflow > 0)), 0)", 6)} AS net_accumulation_ratio
FROM wallets GROUP BY {keys}"""


@query(f"WITH {wallets_sql(NOW_EARLY)} {_stats_select(NOW_EARLY, 'product, network')}")
def aggregate_stats(spark, sf_dir):
    x = behaviour.stats(wallets_at(spark, sf_dir, NOW_EARLY), NOW_EARLY, PN)
    return x.withColumn("net_accumulation_ratio", r(F.col("net_accumulation_ratio"), 6))


@query(f"WITH {wallets_sql(keys='product')} SELECT product, {rs('count(*) FILTER (behavior = ' + chr(39) + 'Accumulating' + chr(39) + ')::DOUBLE / nullif(count(*) FILTER (behavior IN (' + chr(39) + 'Accumulating' + chr(39) + ', ' + chr(39) + 'Distributing' + chr(39) + ')), 0)', 6)} AS net_accumulation_ratio FROM labelled GROUP BY product")
def net_accumulation_ratio(spark, sf_dir):
    return behaviour.stats(wallets_at(spark, sf_dir, keys=("product",)), NOW, ["product"]).select("product", r(F.col("net_accumulation_ratio"), 6).alias("net_accumulation_ratio"))


@query(f"WITH {LEDGER_SQL}, {LEGS_SQL} SELECT product, address, min(ts_unix) AS first_receipt FROM legs WHERE is_in GROUP BY product, address")
def first_receipt(spark, sf_dir):
    w = replay.wallets(replay.legs(derived_ledger(spark, sf_dir), ("product",)), NOW, ("product",))
    return w.where("first_receipt is not null").select("product", "address", "first_receipt")


# ---- holders -----------------------------------------------------------------------------------

_TOP_SQL = f"""{wallets_sql(keys='product')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY balance DESC, address) AS rank, sum(balance) OVER (PARTITION BY product) AS total FROM labelled)"""


@query(f"WITH {_TOP_SQL} SELECT product, rank::INT AS rank, address, balance::{D38} AS balance, ((balance * 10000) // total)::DOUBLE / 100 AS share_pct FROM ranked WHERE rank <= 10")
def top_holders(spark, sf_dir):
    return holders.top_holders(replay.balances(ledger_at(spark, sf_dir), ("product",)), 10, ["product"]).select("product", F.col("rank").cast("int").alias("rank"), "address", "balance", "share_pct")


@query(f"WITH {_TOP_SQL} SELECT product, " + ", ".join(f"((sum(balance) FILTER (rank <= {k}) * 10000) // max(total))::DOUBLE / 100 AS top{k}_pct" for k in holders.TOP) + " FROM ranked GROUP BY product")
def concentration_topn(spark, sf_dir):
    return holders.concentration(replay.balances(ledger_at(spark, sf_dir), ("product",)), ["product"])


@query(f"WITH {_TOP_SQL}, outside AS (SELECT product, 2 * sum(value_raw) AS supply FROM ledger WHERE kind = 'mint' GROUP BY product), n AS (SELECT product, count(*) AS holder_count FROM labelled GROUP BY product) SELECT product, rank::INT AS rank, address, balance::{D38} AS balance, holder_count, ((balance * 10000) // supply)::DOUBLE / 100 AS share_of_supply_pct FROM ranked JOIN outside USING (product) JOIN n USING (product) WHERE rank <= 10")
def holder_stats_ext_supply(spark, sf_dir):
    outside = derived_ledger(spark, sf_dir).where("kind = 'mint'").groupBy("product").agg((F.sum("value_raw") * 2).cast(RAW).alias("supply_raw"))
    return holders.holder_stats(replay.balances(ledger_at(spark, sf_dir), ("product",)), outside).withColumn("rank", F.col("rank").cast("int"))


_TAG_SQL = "CASE s_suppkey % 5 WHEN 0 THEN 'Coinbase Prime ' || s_suppkey WHEN 1 THEN 'Some Vault' WHEN 2 THEN NULL WHEN 3 THEN 'Gnosis Safe Proxy' ELSE s_name END"


def _tags(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    tag = F.when(k % 5 == 0, F.concat(F.lit("Coinbase Prime "), k)).when(k % 5 == 1, "Some Vault").when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, "Gnosis Safe Proxy").otherwise(F.col("s_name"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), k).alias("address"), tag.alias("name_tag"))


@query(f"""WITH {wallets_sql(keys='product')}, tags AS (SELECT 's' || s_suppkey AS address, {_TAG_SQL} AS name_tag FROM supplier)
SELECT product, address, name_tag, coalesce(regexp_matches(lower(name_tag), 'coinbase|binance|exchange|custodian|custody|gnosis safe|multisig|vault|treasury|kraken|gemini|bitfinex|okx|bybit|huobi'), FALSE) AS is_labeled_custodian
FROM labelled LEFT JOIN tags USING (address)""")
def custodian_flag(spark, sf_dir):
    x = behaviour.classify(wallets_at(spark, sf_dir, keys=("product",))).join(_tags(spark, sf_dir), "address", "left")
    return x.select("product", "address", "name_tag", is_custodian(F.col("name_tag")).alias("is_labeled_custodian"))


@query(f"WITH {wallets_sql()} SELECT product, network, address, balance::{D38} AS balance FROM wallets WHERE balance < 0")
def negative_balances(spark, sf_dir):
    return replay.negative_balances(wallets_at(spark, sf_dir)).select(*PN, "address", "balance")


def _held(spark, sf_dir) -> DataFrame:
    """Positive balances in tokens against the ledger's own net supply, both from one replay.

    A transfer's two legs cancel unless it mints or burns, so all balances of a unit add up to its net supply.
    """
    p = products(spark).select("product", "decimals", "nav_usd")
    raw = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(RAW)
    x = wallets_at(spark, sf_dir).groupBy(*PN).agg(raw(F.when(F.col("balance") > 0, F.col("balance"))).alias("positive_raw"), raw("balance").alias("supply_raw")).join(F.broadcast(p), "product")
    return x.withColumns({"positive_tokens": tokens(F.col("positive_raw"), F.col("decimals")), "supply_tokens": tokens(F.col("supply_raw"), F.col("decimals"))})


@query(f"""WITH {wallets_sql()}, {PRODUCTS_SQL},
held AS (SELECT product, network, coalesce(sum(balance) FILTER (balance > 0), 0) AS raw FROM wallets GROUP BY product, network),
net AS (SELECT product, network, sum(CASE WHEN kind = 'mint' THEN value_raw WHEN kind = 'burn' THEN -value_raw ELSE 0 END) AS raw FROM ledger WHERE ts_unix <= {NOW} GROUP BY product, network),
x AS (SELECT h.product, h.network, h.raw::DOUBLE / pow(10, decimals) AS positive_tokens, n.raw::DOUBLE / pow(10, decimals) AS supply_tokens, nav_usd
      FROM held h JOIN net n ON h.product = n.product AND h.network = n.network JOIN products p ON h.product = p.product)
SELECT product, network, {rs('positive_tokens')} AS positive_tokens, {rs('supply_tokens')} AS supply_tokens,
  CASE WHEN supply_tokens <= 0 THEN 'skipped: supply not positive' WHEN supply_tokens * nav_usd < 1000000 THEN 'skipped: below floor' WHEN abs(positive_tokens - supply_tokens) / supply_tokens > 0.05 THEN 'deviates' ELSE 'ok' END AS status FROM x""")
def reconcile_supply(spark, sf_dir):
    return incremental.reconcile(_held(spark, sf_dir)).select(*PN, r(F.col("positive_tokens")).alias("positive_tokens"), r(F.col("supply_tokens")).alias("supply_tokens"), "status")


@query(f"""WITH {wallets_sql()}, {PRODUCTS_SQL},
net AS (SELECT product, network, sum(CASE WHEN kind = 'mint' THEN value_raw WHEN kind = 'burn' THEN -value_raw ELSE 0 END) AS raw FROM ledger WHERE ts_unix <= {NOW} GROUP BY product, network),
old AS (SELECT product, network, address, sum(amount) AS balance FROM legs WHERE ts_unix <= {NOW_EARLY} GROUP BY product, network, address),
a AS (SELECT product, network, coalesce(sum(balance) FILTER (balance > 0), 0) AS raw FROM old GROUP BY product, network),
b AS (SELECT product, network, coalesce(sum(balance) FILTER (balance > 0), 0) AS raw FROM wallets GROUP BY product, network),
x AS (SELECT n.product, n.network, n.raw::DOUBLE / pow(10, decimals) AS s, coalesce(a.raw, 0)::DOUBLE / pow(10, decimals) AS p, coalesce(b.raw, 0)::DOUBLE / pow(10, decimals) AS q
      FROM net n JOIN products d ON d.product = n.product LEFT JOIN a ON a.product = n.product AND a.network = n.network LEFT JOIN b ON b.product = n.product AND b.network = n.network)
SELECT product, network, {rs('CASE WHEN s > 0 THEN abs(p - s) / s END')} AS stored_deviation, {rs('CASE WHEN s > 0 THEN abs(q - s) / s END')} AS candidate_deviation,
  CASE WHEN s <= 0 THEN 'skip' WHEN abs(q - s) / s <= abs(p - s) / s + 0.005 THEN 'swap' ELSE 'keep' END AS decision FROM x""")
def rebuild_gate(spark, sf_dir):
    """Gate between the state of 1996 as stored and that of 2001 as candidate."""
    ledger = derived_ledger(spark, sf_dir)
    state = lambda now: incremental.merge(None, incremental.deltas(ledger.where(F.col("ts_unix") <= now)))
    s = _held(spark, sf_dir).select(*PN, "decimals", "supply_tokens")
    return incremental.rebuild_gate(state(NOW_EARLY), state(NOW), s).select(*PN, r(F.col("stored_deviation")).alias("stored_deviation"), r(F.col("candidate_deviation")).alias("candidate_deviation"), "decision")


# ---- supply and AUM ----------------------------------------------------------------------------

_SUPPLY_SQL = f"""{LEDGER_SQL}, {PRODUCTS_SQL},
days AS (SELECT product, DATE '1970-01-01' + (ts_unix // {DAY})::INT AS day, sum(CASE WHEN kind = 'mint' THEN value_raw ELSE -value_raw END) AS net FROM ledger WHERE kind IN ('mint', 'burn') GROUP BY ALL),
points AS (SELECT product, day, sum(net) OVER (PARTITION BY product ORDER BY day) AS supply_raw FROM days),
calendar AS (SELECT product, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM points GROUP BY product),
filled AS (SELECT c.product, c.day, last_value(p.supply_raw IGNORE NULLS) OVER (PARTITION BY c.product ORDER BY c.day) AS supply_raw FROM calendar c LEFT JOIN points p ON p.product = c.product AND p.day = c.day),
micros AS (SELECT f.product, f.day, f.supply_raw, {micro_sql('f.supply_raw', 'decimals', 'nav_usd')} AS aum_micro FROM filled f JOIN products d ON d.product = f.product),
aum AS (SELECT *, aum_micro::DOUBLE / 1000000 AS aum_usd FROM micros)"""


def _aum(spark, sf_dir) -> DataFrame:
    points = supply.daily_supply(derived_ledger(spark, sf_dir).where("kind in ('mint', 'burn')"))  # others leave supply alone
    return supply.with_aum(supply.gap_fill(points, ["product"], "day", "supply_raw"), products(spark))


@query(f"WITH {_SUPPLY_SQL} SELECT product, day::VARCHAR AS day, supply_raw::{D38} AS supply_raw FROM points")
def supply_daily(spark, sf_dir):
    return supply.daily_supply(derived_ledger(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_SUPPLY_SQL} SELECT product, day::VARCHAR AS day, supply_raw::{D38} AS supply_raw, {dollars_sql('aum_micro')} AS aum_usd FROM aum")
def supply_gap_filled(spark, sf_dir):
    return _aum(spark, sf_dir).select("product", F.col("day").cast("string").alias("day"), "supply_raw", dollars(F.col("aum_micro")).alias("aum_usd"))


@query(f"WITH {_SUPPLY_SQL} SELECT day::VARCHAR AS day, sum(aum_micro)::HUGEINT::DOUBLE / 1000000 AS total_aum_usd, count(*) AS products FROM aum GROUP BY day")
def aum_daily_total(spark, sf_dir):
    return supply.daily_total(_aum(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "total_aum_usd", "products")


_CALENDAR_SQL = f"""months AS (
  SELECT last_day(m)::DATE AS month_end, epoch(last_day(m))::BIGINT + {DAY - 1} AS month_ts, row_number() OVER (ORDER BY m) AS i
  FROM (SELECT unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS m
        FROM (SELECT to_timestamp(min(ts_unix))::TIMESTAMP AS a, to_timestamp(max(ts_unix))::TIMESTAMP AS b FROM ledger)), (SELECT max(ts_unix) AS top FROM ledger)
  WHERE last_day(m)::DATE <= (DATE '1970-01-01' + (top // {DAY})::INT))"""


@query(f"WITH {LEDGER_SQL}, {_CALENDAR_SQL} SELECT month_end::VARCHAR AS month_end FROM months")
def month_end_calendar(spark, sf_dir):
    return index.month_calendar(derived_ledger(spark, sf_dir)).select(F.col("month_end").cast("string").alias("month_end"))


def _month_aum(spark, ledger: DataFrame, calendar: DataFrame) -> DataFrame:
    """AUM as of every month-end; looked up among the days that have mints or burns, not among all days."""
    dates = calendar.select(F.col("month_end").alias("day")).crossJoin(F.broadcast(products(spark).select("product")))
    return supply.as_of(dates, supply.with_aum(supply.daily_supply(ledger), products(spark)), ["product"], "day", "aum_micro")


_ASOF_SQL = "month_aum AS (SELECT p.product, m.month_end, m.month_ts, m.i, p.decimals, p.nav_usd, arg_max(a.aum_micro, a.day) AS aum_micro FROM months m CROSS JOIN products p LEFT JOIN aum a ON a.product = p.product AND a.day <= m.month_end GROUP BY ALL)"


@query(f"WITH {_SUPPLY_SQL}, {_CALENDAR_SQL}, {_ASOF_SQL} SELECT product, month_end::VARCHAR AS day, {dollars_sql('aum_micro')} AS aum_usd FROM month_aum")
def aum_asof_month_end(spark, sf_dir):
    ledger = derived_ledger(spark, sf_dir)
    return _month_aum(spark, ledger, index.month_calendar(ledger)).select("product", F.col("day").cast("string").alias("day"), dollars(F.col("aum_micro")).alias("aum_usd"))


# ---- index -------------------------------------------------------------------------------------

_METRICS_SQL = f"""{_SUPPLY_SQL}, {_CALENDAR_SQL}, {_ASOF_SQL}, {LEGS_SQL},
held AS (
  SELECT m.month_end, product, address, sum(amount) AS balance, bool_or(NOT is_in AND ts_unix >= month_ts - {index.DAYS_90}) AS moved
  FROM months m JOIN legs ON ts_unix <= month_ts GROUP BY m.month_end, product, address HAVING sum(amount) > 0),
sized AS (SELECT *, row_number() OVER (PARTITION BY month_end, product ORDER BY balance DESC, address) AS rn FROM held),
sums AS (SELECT month_end, product, count(*) AS holders, sum(balance) AS total, sum(balance) FILTER (rn <= 5) AS top5, coalesce(sum(balance) FILTER (NOT moved), 0) AS dormant FROM sized GROUP BY month_end, product),
vols AS (SELECT m.month_end, product, sum(value_raw) AS volume FROM months m JOIN ledger ON ts_unix <= month_ts AND ts_unix >= month_ts - {index.DAYS_30} WHERE from_addr <> '{ZERO}' AND to_addr <> '{ZERO}' GROUP BY m.month_end, product),
metrics AS (
  SELECT g.i, g.month_end, g.product, coalesce(g.aum_micro, 0)::HUGEINT AS aum_micro, coalesce(g.aum_micro, 0)::HUGEINT::DOUBLE / 1000000 AS aum_usd, coalesce(s.holders, 0) AS holder_count,
    coalesce((s.top5 * 10000) // s.total, 0)::DOUBLE / 10000 AS top5_share, coalesce((s.dormant * 10000) // s.total, 0)::DOUBLE / 10000 AS dormancy_share,
    ((coalesce(v.volume, 0) // (CASE WHEN decimals = 18 THEN 1000000000000 ELSE 1 END))::HUGEINT) AS volume_tokens, nav_usd
  FROM month_aum g LEFT JOIN sums s ON s.month_end = g.month_end AND s.product = g.product LEFT JOIN vols v ON v.month_end = g.month_end AND v.product = g.product),
volumes AS (SELECT *, {micro_sql('volume_tokens', '6', 'nav_usd')} AS volume_micro FROM metrics),
product_months AS (SELECT *, volume_micro::DOUBLE / 1000000 AS volume_30d_usd, CASE WHEN aum_micro > 0 THEN (volume_micro::DOUBLE / 1000000) / aum_usd ELSE 0 END AS velocity FROM volumes),
rolled AS (
  SELECT i, month_end, sum(aum_micro)::HUGEINT AS total_micro, sum(aum_micro)::HUGEINT::DOUBLE / 1000000 AS total_aum, sum(holder_count)::BIGINT AS total_holders, coalesce(avg(top5_share) FILTER (holder_count > 0), 0) AS avg_top5_share,
    coalesce(sum(dormancy_share * aum_usd) FILTER (aum_usd > 0) / nullif(sum(aum_usd) FILTER (aum_usd > 0), 0), 0) AS avg_dormancy_share,
    sum(velocity * aum_usd) AS total_volume_30d, count(*) FILTER (aum_usd > 0 OR holder_count > 0) AS live_products
  FROM product_months GROUP BY i, month_end),
month_rows AS (SELECT *, CASE WHEN total_aum > 0 THEN total_volume_30d / total_aum ELSE 0 END AS velocity FROM rolled),
lagged AS (SELECT *, lag(total_aum, 3) OVER w AS a3, lag(total_holders, 3) OVER w AS h3, lag(avg_top5_share, 3) OVER w AS t3, lag(avg_dormancy_share, 3) OVER w AS d3,
    CASE WHEN lag(velocity, 3) OVER w IS NOT NULL THEN (lag(velocity, 3) OVER w + lag(velocity, 2) OVER w + lag(velocity, 1) OVER w) / 3 END AS v3 FROM month_rows WINDOW w AS (ORDER BY i)),
factors AS (
  SELECT i, month_end, CASE WHEN a3 > 0 THEN (total_aum - a3) / a3 END AS aumGrowth3m, CASE WHEN h3 > 0 THEN (total_holders - h3) / h3::DOUBLE END AS holderGrowth3m, avg_top5_share - t3 AS concentrationDelta3m,
    avg_dormancy_share - d3 AS dormancyDelta3m, CASE WHEN v3 > 0 THEN velocity / v3 END AS transferActivityRatio, (live_products + 1)::DOUBLE AS breadth FROM lagged)"""

_SCORES_SQL = f"""{_METRICS_SQL},
scored AS (SELECT *, {", ".join(f"{normalize_sql(f.key, f)} AS {f.key}_score" for f in FACTORS)}, ({" + ".join(f"CASE WHEN {f.key} IS NOT NULL THEN {f.weight}::DOUBLE ELSE 0 END" for f in FACTORS)}) AS present FROM factors),
readings AS (SELECT *, {rs(" + ".join(f"coalesce({f.weight}::DOUBLE / present * {f.key}_score, 0)" for f in FACTORS), 2)} AS composite,
  list_filter([{", ".join(f"CASE WHEN {f.key} IS NULL THEN '{f.key}' END" for f in FACTORS)}], lambda x: x IS NOT NULL) AS missing FROM scored)"""


def _product_months(spark, sf_dir) -> DataFrame:
    return index.product_months(derived_ledger(spark, sf_dir), products(spark))


def _factors(spark, sf_dir) -> DataFrame:
    return index.factor_inputs(index.month_rollup(_product_months(spark, sf_dir)))


def _readings(spark, sf_dir) -> DataFrame:
    return index.composite(_factors(spark, sf_dir))


def _day(c: str = "month_end"):
    return F.col(c).cast("string").alias(c)


_VOLUME_SQL = dollars_sql("CASE WHEN aum_micro > 0 THEN volume_micro ELSE 0 END")


@query(f"WITH {_METRICS_SQL} SELECT month_end::VARCHAR AS month_end, product, {dollars_sql('aum_micro')} AS aum_usd, holder_count, top5_share, dormancy_share, {_VOLUME_SQL} AS volume_30d_usd, {rs('velocity', 6)} AS velocity FROM product_months")
def month_product_metrics(spark, sf_dir):
    volume = F.when(F.col("aum_micro") > 0, F.col("volume_micro")).otherwise(F.lit(0).cast(RAW))
    return _product_months(spark, sf_dir).select(_day(), "product", dollars(F.col("aum_micro")).alias("aum_usd"), "holder_count", "top5_share", "dormancy_share", dollars(volume).alias("volume_30d_usd"), r(F.col("velocity"), 6).alias("velocity"))


@query(f"WITH {_METRICS_SQL} SELECT month_end::VARCHAR AS month_end, {dollars_sql('total_micro')} AS total_aum, total_holders, {rs('avg_top5_share', 6)} AS avg_top5_share, {rs('avg_dormancy_share', 6)} AS avg_dormancy_share, {rs('velocity', 6)} AS velocity, live_products FROM month_rows")
def month_rollup(spark, sf_dir):
    x = index.month_rollup(_product_months(spark, sf_dir))
    return x.select(_day(), dollars(F.col("total_micro")).alias("total_aum"), "total_holders", *(r(F.col(c), 6).alias(c) for c in ("avg_top5_share", "avg_dormancy_share", "velocity")), "live_products")


@query(f"WITH {_METRICS_SQL} SELECT month_end::VARCHAR AS month_end, {', '.join(rs(f.key, 6) + f' AS {f.key}' for f in FACTORS)} FROM factors")
def factor_inputs(spark, sf_dir):
    return _factors(spark, sf_dir).select(_day(), *(r(F.col(f.key), 6).alias(f.key) for f in FACTORS))


@query(f"WITH {_SCORES_SQL} SELECT month_end::VARCHAR AS month_end, {', '.join(rs(f.key + '_score') + f' AS {f.key}_score' for f in FACTORS)} FROM scored")
def factor_scores(spark, sf_dir):
    return _readings(spark, sf_dir).select(_day(), *(r(F.col(f"{f.key}_score")).alias(f"{f.key}_score") for f in FACTORS))


@query(f"WITH {_SCORES_SQL} SELECT month_end::VARCHAR AS month_end, composite, len(missing) > 0 AS is_partial, CASE WHEN len(missing) > 0 THEN len(missing) || ' factor(s) unavailable: ' || array_to_string(missing, ', ') END AS partial_reason, '1.1' AS methodology_version FROM readings")
def index_composite(spark, sf_dir):
    return _readings(spark, sf_dir).select(_day(), "composite", "is_partial", "partial_reason", "methodology_version")


@query(f"WITH {_SCORES_SQL} " + " UNION ALL ".join(f"SELECT month_end::VARCHAR AS month_end, '{f.key}' AS factor, {rs(f'{f.key}_score * {f.weight}::DOUBLE / present')} AS contribution FROM readings WHERE {f.key} IS NOT NULL" for f in FACTORS))
def factor_contributions(spark, sf_dir):
    return index.contributions(_readings(spark, sf_dir)).select(_day(), "factor", r(F.col("contribution")).alias("contribution"))


@query(f"WITH {_SCORES_SQL} SELECT month_end::VARCHAR AS month_end, composite, {rs('composite - lag(composite) OVER (ORDER BY i)', 2)} AS delta FROM readings")
def history_mom_delta(spark, sf_dir):
    return views.month_deltas(_readings(spark, sf_dir)).select(_day(), "composite", r(F.col("delta"), 2).alias("delta"))


@query(f"WITH {LEDGER_SQL}, {_CALENDAR_SQL} SELECT month_end::VARCHAR AS month_end, (lag(month_end) OVER (ORDER BY i))::VARCHAR AS prev_month, (lead(month_end) OVER (ORDER BY i))::VARCHAR AS next_month FROM months")
def history_nav(spark, sf_dir):
    x = views.month_navigation(index.month_calendar(derived_ledger(spark, sf_dir)))
    return x.select(_day(), _day("prev_month"), _day("next_month"))


# ---- read-side views ---------------------------------------------------------------------------


def _network_stats(spark, sf_dir) -> DataFrame:
    """Network statistics with market values; network n1 of p3 has none."""
    s = behaviour.stats(wallets_at(spark, sf_dir), NOW, PN)
    m = _held(spark, sf_dir).select(*PN, F.when((F.col("product") == "p3") & (F.col("network") == "n1"), None).otherwise(F.col("supply_tokens") * F.col("nav_usd")).alias("market_value_usd"))
    return s.join(m, PN, "left")


@query(f"""WITH {wallets_sql()}, {PRODUCTS_SQL}, stats AS ({_stats_select(NOW, 'product, network')}),
net AS (SELECT product, network, sum(CASE WHEN kind = 'mint' THEN value_raw WHEN kind = 'burn' THEN -value_raw ELSE 0 END) AS raw FROM ledger WHERE ts_unix <= {NOW} GROUP BY product, network),
x AS (SELECT s.*, CASE WHEN NOT (s.product = 'p3' AND s.network = 'n1') THEN n.raw::DOUBLE / pow(10, decimals) * nav_usd END AS mv FROM stats s JOIN products p ON p.product = s.product LEFT JOIN net n ON n.product = s.product AND n.network = s.network)
SELECT product, sum(holder_count)::BIGINT AS holder_count, sum(net_new_wallets_90d)::BIGINT AS net_new_wallets_90d, sum(exited_wallets_90d)::BIGINT AS exited_wallets_90d, (sum(net_new_wallets_90d) - sum(exited_wallets_90d))::BIGINT AS net_change, count(*) AS networks,
  {rs('sum(behavior_accumulating)::DOUBLE / nullif(sum(behavior_accumulating) + sum(behavior_distributing), 0)', 6)} AS net_accumulation_ratio,
  {rs('CASE WHEN count(*) = 1 THEN min(dormancy_share_pct) WHEN count(mv) = count(*) AND sum(mv) > 0 THEN sum(dormancy_share_pct * mv) / sum(mv) END')} AS dormancy_share_pct
FROM x GROUP BY product""")
def fund_network_rollup(spark, sf_dir):
    x = behaviour.aggregate_networks(_network_stats(spark, sf_dir))
    return x.select("product", "holder_count", "net_new_wallets_90d", "exited_wallets_90d", "net_change", "networks", r(F.col("net_accumulation_ratio"), 6).alias("net_accumulation_ratio"), r(F.col("dormancy_share_pct")).alias("dormancy_share_pct"))


def _latest_aum(spark, sf_dir) -> DataFrame:
    return _aum(spark, sf_dir).groupBy("product").agg(F.max_by("aum_usd", "day").alias("aum_usd"), F.max_by("aum_micro", "day").alias("aum_micro"))


@query(f"""WITH {_SUPPLY_SQL}, {LEGS_SQL},
wallets AS (SELECT product, address, sum(amount) AS balance, coalesce(sum(-amount) FILTER (NOT is_in AND ts_unix >= {NOW - W}), 0) AS outflow FROM legs WHERE ts_unix <= {NOW} GROUP BY product, address),
stats AS (SELECT product, count(*) FILTER (balance > 0) AS holders, coalesce(((sum(balance) FILTER (balance > 0 AND outflow = 0)) * 10000) // sum(balance) FILTER (balance > 0), 0)::DOUBLE / 100 AS d FROM wallets GROUP BY product),
top AS (SELECT product, arg_max(aum_micro, day) AS m, arg_max(aum_usd, day) AS a FROM aum GROUP BY product)
SELECT {dollars_sql('(sum(m) FILTER (m > 0))::HUGEINT')} AS total_aum_usd, sum(holders)::BIGINT AS total_holders, count(*) FILTER (m > 0) AS products_live, {rs('sum(d * a) FILTER (m > 0) / nullif(sum(a) FILTER (m > 0 AND d IS NOT NULL), 0)')} AS dormancy_pct
FROM products LEFT JOIN top USING (product) LEFT JOIN stats USING (product)""")
def homepage_summary(spark, sf_dir):
    s = behaviour.stats(wallets_at(spark, sf_dir, keys=("product",)), NOW, ["product"]).select("product", "holder_count", "dormancy_share_pct")
    x = views.homepage(products(spark).select("product"), _latest_aum(spark, sf_dir), s)
    return x.select(dollars(F.col("total_aum_micro")).alias("total_aum_usd"), "total_holders", "products_live", r(F.col("dormancy_pct")).alias("dormancy_pct"))


_LARGE_SQL = f"""{LEDGER_SQL}, {PRODUCTS_SQL},
seen AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts_unix DESC, id) AS n FROM ledger),
big AS (SELECT s.product, s.n, s.id, s.ts_unix, s.from_addr, s.to_addr, s.value_raw::DOUBLE / pow(10, p.decimals) AS amount, {micro_sql('s.value_raw', 'p.decimals', 'nav_usd')} AS value_micro, nav_usd FROM seen s JOIN products p ON p.product = s.product WHERE n <= 200),
large AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n) AS rank FROM big WHERE amount > 30.0 / nav_usd)"""


@query(f"WITH {_LARGE_SQL} SELECT product, rank::INT AS rank, id, ts_unix, from_addr, to_addr, amount, {dollars_sql('value_micro', 4)} AS value_usd, from_addr = '{ZERO}' AS is_mint, to_addr = '{ZERO}' AS is_burn FROM large WHERE rank <= 10")
def recent_large_transfers(spark, sf_dir):
    """The largest of the latest 200 transfers; the derived ledger's amounts are small, so the floor is 30 USD."""
    x = views.recent_large_transfers(derived_ledger(spark, sf_dir), products(spark), 30.0)
    return x.withColumn("rank", F.col("rank").cast("int")).withColumn("value_usd", dollars(F.col("value_micro"), 4)).drop("value_micro")


@query(f"""WITH {_LARGE_SQL}, tags AS (SELECT 's' || s_suppkey AS address, {_TAG_SQL} AS name_tag FROM supplier)
SELECT product, rank::INT AS rank, id, a.name_tag AS from_tag, b.name_tag AS to_tag FROM large LEFT JOIN tags a ON a.address = from_addr LEFT JOIN tags b ON b.address = to_addr WHERE rank <= 10""")
def large_transfers_tagged(spark, sf_dir):
    x = views.recent_large_transfers(derived_ledger(spark, sf_dir), products(spark), 30.0)
    return views.with_tags(x, _tags(spark, sf_dir)).select("product", F.col("rank").cast("int").alias("rank"), "id", "from_tag", "to_tag")


# ---- incremental maintenance -------------------------------------------------------------------

CUT = unix(1998, 6, 30, 23, 59, 59)
#: The first run of the two ends inside a day at which ids are split by parity, so the boundary is exercised.
CUT_DAY = CUT // DAY * DAY
_FIRST_SQL = f"(ts_unix < {CUT_DAY} OR (ts_unix <= {CUT} AND l_odd))"


def _first_run(ledger: DataFrame) -> DataFrame:
    odd = F.length("id") % 2 == 1
    return ledger.where((F.col("ts_unix") < CUT_DAY) | ((F.col("ts_unix") <= CUT) & odd))


_CUT_LEDGER = f"{LEDGER_SQL}, marked AS (SELECT *, length(id) % 2 = 1 AS l_odd FROM ledger), run1 AS (SELECT * FROM marked WHERE {_FIRST_SQL})"
_CURSOR1 = f"last1 AS (SELECT product, network, max(ts_unix) AS last_ts FROM run1 GROUP BY product, network), cursor1 AS (SELECT l.product, l.network, l.last_ts, list_sort(list(r.id)) AS ids FROM last1 l JOIN run1 r ON r.product = l.product AND r.network = l.network AND r.ts_unix // {DAY} = l.last_ts // {DAY} GROUP BY ALL)"


@query(f"WITH {_CUT_LEDGER}, {_CURSOR1} SELECT m.product, m.network, m.id FROM marked m JOIN cursor1 c ON c.product = m.product AND c.network = m.network WHERE m.ts_unix >= c.last_ts // {DAY} * {DAY} AND NOT list_contains(c.ids, m.id)")
def boundary_dedup(spark, sf_dir):
    """What the second run finds new: rows from the cursor's day on, less the ids it has seen."""
    ledger = derived_ledger(spark, sf_dir)
    cursor = incremental.next_cursor(_first_run(ledger), None)
    return incremental.drop_boundary(incremental.since_cursor(ledger, cursor), cursor).select(*PN, "id")


@query(f"WITH {_CUT_LEDGER}, {_CURSOR1} SELECT product, network, last_ts, unnest(ids) AS id FROM cursor1")
def cursor_next(spark, sf_dir):
    return incremental.next_cursor(_first_run(derived_ledger(spark, sf_dir)), None)


@query(f"""WITH {LEDGER_SQL}, slice AS (SELECT * FROM ledger WHERE ts_unix <= {unix(1998, 6, 30, 23, 59, 59)}), last AS (SELECT product, network, max(ts_unix) AS last_ts FROM slice GROUP BY product, network)
SELECT s.product, s.network, l.last_ts, s.id FROM slice s JOIN last l ON l.product = s.product AND l.network = s.network AND s.ts_unix // {DAY} = l.last_ts // {DAY}""")
def cursor_after_second_run(spark, sf_dir):
    """The cursor of a second run that ends inside the first one's boundary day: its ids join the earlier ones."""
    ledger = derived_ledger(spark, sf_dir)
    cursor = incremental.next_cursor(_first_run(ledger), None)
    fresh = incremental.drop_boundary(incremental.since_cursor(ledger.where(F.col("ts_unix") <= CUT), cursor), cursor)
    return incremental.next_cursor(fresh, cursor)


@query(f"WITH {LEDGER_SQL}, {LEGS_SQL} SELECT product, network, address, sum(amount)::{D38} AS balance, min(ts_unix) FILTER (is_in) AS first_receipt FROM legs GROUP BY product, network, address")
def incremental_merge(spark, sf_dir):
    """Two increments with a split boundary day; the SQL replays everything at once."""
    ledger = derived_ledger(spark, sf_dir)
    first = _first_run(ledger)
    state, cursor = incremental.merge(None, incremental.deltas(first)), incremental.next_cursor(first, None)
    fresh = incremental.drop_boundary(incremental.since_cursor(ledger, cursor), cursor)
    return incremental.merge(state, incremental.deltas(fresh)).select(*PN, "address", "balance", "first_receipt")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN least(60, greatest(1, 2 * d)) ELSE least(60, greatest(1, floor(40 * d::DOUBLE / p_size + 0.5))) END::INT AS next_span, greatest(1, d // 2)::INT AS halved_span,
  CASE WHEN p_size % 7 = 0 THEN 20 ELSE greatest(1, least(20, floor(least(40, p_partkey % 90) / (p_size::DOUBLE / d)))) END::INT AS capped_span
FROM (SELECT *, (p_partkey % 60 + 1)::INT AS d FROM part)""")
def backfill_span(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    days, pages = (F.col("p_partkey") % 60 + 1).cast("int"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size"))
    return p.select("p_partkey", schedule.next_span(days, pages).alias("next_span"), schedule.halved_span(days).alias("halved_span"), schedule.capped_span(F.lit(20), days, pages, F.col("p_partkey") % 90).alias("capped_span"))


@query("""SELECT c_nationkey, c_custkey, remaining, remaining > 0 AS runs FROM (
  SELECT c_nationkey, c_custkey, 80 - coalesce(sum(c_custkey % 37) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining FROM customer)""")
def budget_allocation(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 37).alias("cost"))
    return schedule.sequential_budget(c, "c_custkey", "cost", schedule.RUN_BUDGET, ["c_nationkey"]).drop("cost")


_TWINS_SQL = """feed AS (
  SELECT '2-' || hash || '-0' AS id, hash, CASE WHEN from_addr LIKE 's%' THEN 'ata-' || from_addr ELSE from_addr END AS f, CASE WHEN to_addr LIKE 's%' THEN 'ata-' || to_addr ELSE to_addr END AS t, value_raw FROM ledger
  UNION ALL SELECT '2_' || hash || '_1_' || (value_raw % 3), hash, from_addr, to_addr, value_raw FROM ledger WHERE length(id) % 2 = 0)"""


@query(f"WITH {LEDGER_SQL}, {_TWINS_SQL} SELECT hash, replace(f, 'ata-', '') AS from_addr, replace(t, 'ata-', '') AS to_addr, value_raw::{D38} AS value_raw, min(id) AS id FROM feed GROUP BY ALL")
def twin_dedup(spark, sf_dir):
    """Two feeds of one chain, one of them naming suppliers' accounts in place of the suppliers."""
    ledger = derived_ledger(spark, sf_dir)
    account = lambda c: F.when(F.col(c).startswith("s"), F.concat(F.lit("ata-"), c)).otherwise(F.col(c))
    dash = ledger.select(F.concat(F.lit("2-"), "hash", F.lit("-0")).alias("id"), "hash", account("from_addr").alias("from_addr"), account("to_addr").alias("to_addr"), "value_raw")
    under = ledger.where(F.length("id") % 2 == 0).select(F.concat(F.lit("2_"), "hash", F.lit("_1_"), (F.col("value_raw") % 3).cast("string")).alias("id"), "hash", "from_addr", "to_addr", "value_raw")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("owner"))
    owners = s.select(F.concat(F.lit("ata-"), "owner").alias("account"), "owner")
    return incremental.resolve_twins(dash.unionByName(under), owners).select("hash", "from_addr", "to_addr", "value_raw", "id")


# ---- display and extensions --------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('$%.2fB', round(v / 1e9, 2)) WHEN v >= 1e6 THEN printf('$%.1fM', round(v / 1e6, 1)) WHEN v >= 1e3 THEN printf('$%.0fK', round(v / 1e3, 0)) ELSE printf('$%.0f', round(v, 0)) END AS usd
FROM (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 ELSE 100000.0 END::DOUBLE AS v FROM orders)""")
def format_usd(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 3
    v = F.col("o_totalprice") * F.when(k == 0, 1.0).when(k == 1, 100.0).otherwise(100000.0)
    return o.select("o_orderkey", formats.usd(v).alias("usd"))


_ADDRESSES_SQL = ", ".join(f"('{a}', '{t}')" for a, t in KNOWN_ADDRESSES.items())
_KNOWN_KEYS = list(KNOWN_ADDRESSES)
_ADDRESS_SQL = f"CASE WHEN c_custkey % 50 < {len(_KNOWN_KEYS)} THEN [" + ", ".join(f"'{a}'" for a in _KNOWN_KEYS) + "][(c_custkey % 50 + 1)::INT] ELSE '0x' || md5(c_custkey::VARCHAR) || lpad(c_custkey::VARCHAR, 8, '0') END"


@query(f"SELECT c_custkey, substr(x.address, 1, 6) || '…' || right(x.address, 4) AS short, tag FROM (SELECT c_custkey, {_ADDRESS_SQL} AS address FROM customer) x LEFT JOIN (VALUES {_ADDRESSES_SQL}) AS t(address, tag) ON t.address = x.address")
def short_addresses(spark, sf_dir):
    """Addresses of all customers as a page shows them, with the tags of well-known ones."""
    from ..sources.dimensions import known_addresses

    k = F.col("c_custkey")
    made = F.concat(F.lit("0x"), F.md5(k.cast("string").cast("binary")), F.lpad(k.cast("string"), 8, "0"))
    address = F.when(k % 50 < len(_KNOWN_KEYS), F.get(F.array(*map(F.lit, _KNOWN_KEYS)), (k % 50).cast("int"))).otherwise(made)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", address.alias("address"))
    return c.join(F.broadcast(known_addresses(spark)), "address", "left").select("c_custkey", formats.short_address(F.col("address")).alias("short"), "tag")  # some ten rows


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS value_cents FROM events GROUP BY ALL")
def events_daily_tumbling(spark, sf_dir):
    """Extension: tumbling windows, here as a batch; ``streaming`` runs the same plan on a stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("date").alias("day"), "event_type", "value")
    return e.groupBy(F.col("day").cast("string").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))


@query("""WITH marked AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(t) AS start_unix, max(t) + 7200 AS end_unix, count(*) AS n FROM numbered GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    """Extension: sessions of a user, closed by two hours without an event."""
    from pyspark.sql import Window

    from ..sources.ledger import seconds

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", seconds(F.col("ts")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    e = e.withColumn("new", F.when(gap.isNull() | (gap >= 7200), 1).otherwise(0))
    e = e.withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "s").agg(F.min("t").alias("start_unix"), (F.max("t") + 7200).alias("end_unix"), F.count("*").alias("n")).drop("s")


# ---- ingest, records and the stream ------------------------------------------------------------


@query(f"WITH {LEDGER_SQL} SELECT product, network, id, hash, ts_unix, from_addr, to_addr, value_raw::{D38} AS value_raw FROM ledger WHERE product <> 'p4'")
def vendor_json_normalise(spark, sf_dir):
    """The ledger written as vendor JSON, parsed with the nested schema and normalised in one pass; the token of p4 isn't allowed."""
    from ..sources.dimensions import DECIMALS
    from ..sources.ledger import VENDOR_SCHEMA, normalise_vendor

    x = derived_ledger(spark, sf_dir)
    amount = tokens(F.col("value_raw"), F.col("decimals")).cast("decimal(38,18)")
    stamp = F.concat(day_of(F.col("ts_unix")).cast("string"), F.lit("T00:00:00Z"))
    row = F.struct("id", F.when(F.col("kind") != "mint", F.col("from_addr")).alias("from_address"), F.when(F.col("kind") != "burn", F.col("to_addr")).alias("to_address"), amount.alias("amount"), stamp.alias("timestamp"), F.col("hash").alias("transaction_hash"),
                   F.struct(F.col("kind").alias("slug")).alias("transaction_type"), F.struct(F.concat(F.lit("0xTOK"), "product").alias("address"), "decimals").alias("token"))
    parsed = x.select("network", F.from_json(F.to_json(row), VENDOR_SCHEMA).alias("r")).select("network", "r.*")
    configured = spark.createDataFrame([(f"0xTOK{p}", p, d) for p, d in DECIMALS.items()], "address string, product string, configured int")
    known = parsed.join(F.broadcast(configured), F.col("token.address") == F.col("address")).drop("address")  # five rows
    return normalise_vendor(known, F.col("product"), F.col("network"), F.col("configured"), [f"0xtok{p}" for p in DECIMALS if p != "p4"])


@query("SELECT lower('0xTok' || p_partkey) AS address, (p_size % 3)::INT AS network_id, 6 AS decimals, p_retailprice AS supply FROM part WHERE p_partkey % 4 <> 0")
def asset_supply_explode(spark, sf_dir):
    """Nested supply pages built from the part table, read back through the schema; tokens without a supply are left out."""
    from ..sources.ledger import SUPPLY_SCHEMA, explode_supply

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    supply_of = F.when(F.col("p_partkey") % 4 != 0, F.struct(F.col("p_retailprice").alias("val")))
    token = F.struct(F.concat(F.lit("0xTok"), F.col("p_partkey")).alias("address"), F.lit(6).alias("decimals"), (F.col("p_size") % 3).cast("int").alias("network_id"), F.lit("n").alias("network_name"), supply_of.alias("total_supply_token"))
    pages = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("page")).agg(F.collect_list(token).alias("tokens")).select(F.to_json(F.struct(F.array(F.struct("tokens")).alias("results"))).alias("j"))
    return explode_supply(pages.select(F.from_json("j", SUPPLY_SCHEMA).alias("r")).select("r.*"))


@query(f"WITH {LEDGER_SQL}, {_CALENDAR_SQL} SELECT month_end::VARCHAR AS month_end FROM months WHERE month(month_end) IN (1, 4, 7, 10)")
def quarter_ticks(spark, sf_dir):
    """Month-ends that a chart labels."""
    x = index.month_calendar(derived_ledger(spark, sf_dir))
    return x.where(F.month("month_end").isin(1, 4, 7, 10)).select(_day())


@query(f"WITH {LEDGER_SQL} SELECT product, network, min(DATE '1970-01-01' + (ts_unix // {DAY})::INT)::VARCHAR AS first_day FROM ledger GROUP BY product, network")
def earliest_transfer_day(spark, sf_dir):
    from ..sources.ledger import earliest_day

    return earliest_day(derived_ledger(spark, sf_dir))


@query(f"""WITH {LEDGER_SQL}, who AS (SELECT from_addr AS address FROM ledger UNION SELECT to_addr FROM ledger), known AS (SELECT * FROM (VALUES {_ADDRESSES_SQL}) AS t(address, tag)), contracts AS (SELECT 's' || s_suppkey AS address, s_name AS contract_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT address, coalesce(tag, contract_name) AS name_tag, CASE WHEN tag IS NOT NULL THEN 'known' WHEN contract_name IS NOT NULL THEN 'contract' END AS tag_source FROM who LEFT JOIN known USING (address) LEFT JOIN contracts USING (address)""")
def name_tag_lookup(spark, sf_dir):
    """Every address of the ledger against the known ones and contract names."""
    from ..sources.dimensions import known_addresses, name_tags

    x = derived_ledger(spark, sf_dir)
    who = x.select(F.explode(F.array("from_addr", "to_addr")).alias("address")).distinct()
    contracts = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("address"), F.col("s_name").alias("contract_name"))
    return name_tags(who, known_addresses(spark), contracts)


@query(f"""WITH {_TOP_SQL}, seen AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts_unix DESC, id) AS n FROM ledger), {PRODUCTS_SQL},
big AS (SELECT s.product, count(*) AS c FROM seen s JOIN products p ON p.product = s.product WHERE n <= 200 AND s.value_raw::DOUBLE / pow(10, p.decimals) > 30.0 / nav_usd GROUP BY s.product)
SELECT r.product, count(*) AS holder_count, max(address) FILTER (rank = 1) AS largest, least(10, any_value(coalesce(c, 0))) AS large_transfers FROM ranked r LEFT JOIN big USING (product) GROUP BY r.product""")
def fund_record(spark, sf_dir):
    """One record a product; the arrays of the record are reduced to what SQL shows."""
    p = products(spark)
    held = replay.balances(ledger_at(spark, sf_dir), ("product",))
    stats = behaviour.stats(wallets_at(spark, sf_dir, keys=("product",)), NOW, ["product"])
    large = views.recent_large_transfers(derived_ledger(spark, sf_dir), p, 30.0)
    x = views.fund_records(p, stats, _latest_aum(spark, sf_dir), holders.top_holders(held, 10, ["product"]), large)
    return x.select("product", "holder_count", F.col("top_holders")[0]["address"].alias("largest"), F.coalesce(F.size("large_transfers"), F.lit(0)).cast("long").alias("large_transfers"))


@query(f"WITH {LEDGER_SQL}, {LEGS_SQL} SELECT product, network, address, sum(amount)::{D38} AS balance, min(ts_unix) FILTER (is_in) AS first_receipt FROM legs GROUP BY product, network, address")
def stream_incremental_state(spark, sf_dir):
    """The ledger streamed in three batches through the versioned store; the SQL replays it at once."""
    import uuid

    from ..sources.ledger import LEDGER_SCHEMA
    from ..sources.paged import shared_folder
    from ..sources.store import VersionedStore
    from ..streaming.streams import arrive, ledger_stream, maintain_state, stage_batches

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = derived_ledger(spark, sf_dir).select([f.name for f in LEDGER_SCHEMA.fields])
    store = VersionedStore(spark, f"{base}/store")
    for batch in stage_batches(rows, F.array(F.pmod(F.xxhash64("id"), F.lit(3)).cast("string")), base):
        arrive(spark, base, batch)
        maintain_state(ledger_stream(spark, f"{base}/in", LEDGER_SCHEMA), store, f"{base}/checkpoint").awaitTermination()
    return store.read("state").select(*PN, "address", "balance", "first_receipt")


# ---- scans, filters, routes and display rules that no query above shows ------------------------


@query(f"WITH {LEDGER_SQL} SELECT product, network, id FROM ledger WHERE product IN ('p0', 'p2') AND network IN ('n1')")
def scoped_ledger(spark, sf_dir):
    """A run limited to two products, its backfill allowed on one network."""
    from ..sources.ledger import in_scope

    return in_scope(derived_ledger(spark, sf_dir), ["p0", "p2"], ["n1"]).select(*PN, "id")


_SPAN = (unix(1995, 1, 1), unix(1995, 7, 1))


@query(f"WITH {LEDGER_SQL} SELECT greatest(1, ceil(count(*) / 1000.0))::BIGINT AS pages FROM ledger WHERE ts_unix >= {_SPAN[0]} AND ts_unix < {_SPAN[1]}")
def window_pages(spark, sf_dir):
    from ..sources.ledger import windowed

    return windowed(derived_ledger(spark, sf_dir), *_SPAN, 1000)[1]


@query(f"WITH {LEDGER_SQL} SELECT product, network, id, row_number() OVER (PARTITION BY product, network ORDER BY ts_unix, id)::INT AS place FROM ledger")
def feed_order(spark, sf_dir):
    from ..sources.ledger import in_feed_order

    return in_feed_order(derived_ledger(spark, sf_dir).select(*PN, "id", "ts_unix"), PN, "id").select(*PN, "id", F.col("place").cast("int").alias("place"))


@query(f"WITH {_SUPPLY_SQL} SELECT least((SELECT min(day) FROM points), (SELECT min(DATE '1970-01-01' + (ts_unix // {DAY})::INT) FROM ledger))::VARCHAR AS first_day")
def earliest_of_sources(spark, sf_dir):
    """The earlier of the first day with AUM and the first transfer."""
    from ..sources.ledger import earliest_of

    ledger = derived_ledger(spark, sf_dir)
    return earliest_of((supply.daily_supply(ledger), "day"), (ledger.select(day_of(F.col("ts_unix")).alias("day")), "day"))


@query("SELECT epoch_us(ts) // 1000000 AS fetched_at, event_id FROM events WHERE epoch_us(ts) // 1000000 > (SELECT max(epoch_us(ts) // 1000000) FROM events) - 86400")
def fresh_rows(spark, sf_dir):
    """Rows fetched within a day of the latest."""
    from ..sources.ledger import fresh, seconds

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(seconds(F.col("ts")).alias("fetched_at"), "event_id")
    return fresh(e, e.agg(F.max("fetched_at")).first()[0], 86_400)


@query(f"""WITH {wallets_sql()} SELECT product, network, count(*) AS holder_count, count(*) FILTER (behavior = 'Dormant') AS behavior_dormant, count(*) FILTER (behavior = 'Active') AS behavior_active,
  count(*) FILTER (behavior = 'Accumulating') AS behavior_accumulating, count(*) FILTER (behavior = 'Distributing') AS behavior_distributing, 0::BIGINT AS net_new_wallets_90d, 0::BIGINT AS exited_wallets_90d,
  ((coalesce(sum(balance) FILTER (behavior IN ('Dormant', 'Accumulating')), 0) * 10000) // sum(balance))::DOUBLE / 100 AS dormancy_share_pct, max({NOW} - length(address))::BIGINT AS classified_at,
  {rs("count(*) FILTER (behavior = 'Accumulating')::DOUBLE / nullif(count(*) FILTER (behavior IN ('Accumulating', 'Distributing')), 0)", 6)} AS net_accumulation_ratio FROM labelled GROUP BY product, network""")
def stats_from_classifications(spark, sf_dir):
    """Aggregates rebuilt from stored classifications; each row was classified at a time of its own."""
    stored = behaviour.classify(wallets_at(spark, sf_dir)).withColumn("classified_at", (F.lit(NOW) - F.length("address")).cast("long"))
    return behaviour.stats_from_classifications(stored, PN).withColumn("net_accumulation_ratio", r(F.col("net_accumulation_ratio"), 6))


@query(f"""WITH {wallets_sql()}, units AS (SELECT product, network, max({NOW} - length(address))::BIGINT AS t FROM labelled GROUP BY product, network)
SELECT product, max(t) AS classified_at, (SELECT max(t) FROM units) AS latest FROM units GROUP BY product""")
def classification_times(spark, sf_dir):
    """When each fund was last classified over its networks, beside the latest of all funds."""
    stored = behaviour.classify(wallets_at(spark, sf_dir)).withColumn("classified_at", (F.lit(NOW) - F.length("address")).cast("long"))
    rows = behaviour.stats_from_classifications(stored, PN).withColumn("market_value_usd", F.lit(1.0))
    funds = behaviour.aggregate_networks(rows).select("product", "classified_at")
    return funds.crossJoin(F.broadcast(behaviour.latest_classification(rows).withColumnRenamed("classified_at", "latest")))  # one row


@query(f"""WITH configured AS (SELECT 'p' || (p_partkey % 5) AS product, (p_size % 3)::INT AS network_id, lower('0xTok' || p_partkey) AS address FROM part),
found AS (SELECT c.*, p_retailprice AS supply FROM configured c LEFT JOIN part ON address = lower('0xTok' || p_partkey) AND p_partkey % 4 <> 0)
SELECT product, network_id, {rs('sum(supply)', 2)} AS supply, count(*) FILTER (supply IS NULL) AS missing FROM found GROUP BY product, network_id""")
def supply_by_network(spark, sf_dir):
    """Configured tokens against the reported supply, summed by network, with the number of tokens that have none."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    configured = p.select(F.concat(F.lit("p"), F.col("p_partkey") % 5).alias("product"), (F.col("p_size") % 3).cast("int").alias("network_id"), F.concat(F.lit("0xTok"), "p_partkey").alias("address"), F.lit(6).alias("decimals"))
    x = supply.supply_by_network(configured, asset_supply_explode(spark, sf_dir).select("address", "decimals", "supply"))
    return x.select("product", "network_id", r(F.col("supply"), 2).alias("supply"), F.size("missing").cast("long").alias("missing"))


@query("SELECT p_partkey, 'p' || (p_partkey % 7) AS product, p_retailprice AS supply FROM part WHERE p_partkey % 7 < 5")
def supply_by_contract(spark, sf_dir):
    """Supply rows joined to products by contract in whatever case; contracts of no product are left out."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("0XAbC"), F.col("p_partkey") % 7).alias("contract"), F.col("p_retailprice").alias("supply"))
    configured = spark.createDataFrame([(f"0xaBc{i}", f"p{i}") for i in range(5)], "contract string, product string")
    return supply.by_contract(p, configured).select("p_partkey", "product", "supply")


@query("""WITH t AS (SELECT 'f' || n_regionkey AS slug, n_nationkey % 4 AS network_id, lower('0xNAT' || n_nationkey) AS address FROM nation WHERE n_nationkey % 3 <> 0)
SELECT slug, network_id::INT AS network_id, 'net' || network_id AS network_slug, array_to_string(list_sort(list(address)), ',') AS addresses, 6 AS decimals FROM t GROUP BY slug, network_id""")
def observable_networks(spark, sf_dir):
    """Networks of each fund that behaviour can be replayed on; tokens that can't be observed are left out."""
    from ..sources.dimensions import observable_networks as networks

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey").cast("int")
    token = F.struct((k % 4).alias("network_id"), F.concat(F.lit("net"), k % 4).alias("network_slug"), F.concat(F.lit("0xNAT"), k).alias("address"), (k % 3 != 0).alias("behaviorally_observable"), F.when(k % 2 == 0, 6).alias("decimals"))
    funds = n.groupBy(F.concat(F.lit("f"), "n_regionkey").alias("slug")).agg(F.collect_list(token).alias("tokens")).withColumn("decimals", F.lit(6))
    return networks(funds).select("slug", "network_id", "network_slug", F.array_join("addresses", ",").alias("addresses"), "decimals")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 ELSE c_nationkey END::BIGINT AS n, CASE WHEN c_custkey % 4 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS mv FROM customer
UNION ALL SELECT -c_custkey - 1, 7, NULL FROM customer WHERE c_custkey % 50 = 0""")
def upsert_keeping_nulls(spark, sf_dir):
    """New rows replace old ones of their key, but a missing value leaves the stored one; new keys are added."""
    from ..sources.store import upsert

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.select("c_custkey", F.col("c_nationkey").cast("long").alias("n"), F.col("c_acctbal").alias("mv"))
    new = old.where("c_custkey % 2 = 0").select("c_custkey", (F.col("n") + 100).alias("n"), F.when(F.col("c_custkey") % 4 == 2, F.col("mv") + 1).alias("mv"))
    more = old.where("c_custkey % 50 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit(7).cast("long").alias("n"), F.lit(None).cast(old.schema["mv"].dataType).alias("mv"))
    return upsert(old, new.unionByName(more), ["c_custkey"], ("mv",))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'left' WHEN c_custkey % 5 = 0 THEN 'right' ELSE 'differs' END AS missing_from FROM customer
WHERE (c_custkey % 7 = 0) <> (c_custkey % 5 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 0)""")
def parity_diff(spark, sf_dir):
    """Two versions of a table: rows that one lacks, and rows that differ."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    return views.parity(c.where(k % 7 != 0), c.where(k % 5 != 0).select("c_custkey", F.when(k % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey")), ["c_custkey"])


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def last_fourteen_days(spark, sf_dir):
    """Tail slice of a daily series."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return views.latest(e, "day", 14)


_KEYS_SHOWN = [*formats.FACTOR_META, "zeta", "alpha"]
_KEY_OF_PART = "[" + ", ".join(f"'{k}'" for k in _KEYS_SHOWN) + f"][(p_partkey % {len(_KEYS_SHOWN)} + 1)::INT]"


@query(f"SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY pos, key)::INT AS place FROM (SELECT DISTINCT p_brand, {_KEY_OF_PART} AS key FROM part) JOIN (VALUES " + ", ".join(f"('{k}', {i if k in formats.FACTOR_META else 999})" for i, k in enumerate(_KEYS_SHOWN)) + ") AS t(key, pos) USING (key)")
def factor_order(spark, sf_dir):
    """Factor keys of every brand's parts in display order, unknown ones last by name."""
    from pyspark.sql import Window

    key = F.get(F.array(*map(F.lit, _KEYS_SHOWN)), (F.col("p_partkey") % len(_KEYS_SHOWN)).cast("int"))
    x = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", key.alias("key")).distinct().withColumn("_rank", formats.factor_rank(F.col("key")))
    return x.select("p_brand", "key", F.row_number().over(Window.partitionBy("p_brand").orderBy("_rank", "key")).alias("place"))


@query(f"WITH {wallets_sql(keys='product')} SELECT to_json({{'product': product, 'holders': count(*), 'dormant': count(*) FILTER (behavior = 'Dormant')}})::VARCHAR AS json FROM labelled GROUP BY product")
def diagnostics_json(spark, sf_dir):
    x = behaviour.mix(behaviour.classify(wallets_at(spark, sf_dir, keys=("product",))), ["product"])
    return views.diagnostics(x.select("product", F.col("total").alias("holders"), "dormant"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT::DECIMAL(38,0) AS units, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END::DECIMAL(38,0) AS lenient FROM orders")
def integer_texts(spark, sf_dir):
    """Integer text read strictly (zero decimals allowed), and leniently: what is no integer counts as 0."""
    from ..functions.numbers import integer_text, integer_text_or_zero

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", integer_text(F.when(F.col("o_orderkey") % 2 == 0, F.concat(cents, F.lit(".00"))).otherwise(cents)).alias("units"), integer_text_or_zero(text).alias("lenient"))


@query("""SELECT p_partkey, status >= 500 OR (status = 400 AND body = 'reason: connect ETIMEDOUT') AS retryable, p_size % 6 = 1 AS rate_limited
FROM (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 502 ELSE 404 END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'reason: connect ETIMEDOUT' ELSE 'bad request' END AS body FROM part)""")
def retry_rules(spark, sf_dir):
    """Which answers of a feed are asked for again, and which say that the rate was too high."""
    size = F.col("p_size")
    status = F.when(size % 4 == 0, 200).when(size % 4 == 1, 400).when(size % 4 == 2, 502).otherwise(404)
    body = F.when(F.col("p_partkey") % 2 == 0, "reason: connect ETIMEDOUT").otherwise("bad request")
    message = F.when(size % 6 == 1, "GET /x: HTTP 429 slow down").when(size % 6 == 2, "HTTP 4290").otherwise(F.lit(None))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", schedule.http_retryable(status, body).alias("retryable"), schedule.rate_limited(message).alias("rate_limited"))


@query(f"WITH {_SCORES_SQL} SELECT month_end::VARCHAR AS month_end, composite, row_number() OVER (ORDER BY month_end DESC)::INT AS shown FROM readings")
def history_newest_first(spark, sf_dir):
    """Readings in the order a page shows them: stored oldest first, shown newest first."""
    from pyspark.sql import Window

    x = views.month_deltas(_readings(spark, sf_dir))
    return x.select(_day(), "composite", F.row_number().over(Window.orderBy(F.desc("month_end"))).alias("shown"))
