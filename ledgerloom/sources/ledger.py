"""The transfer ledger: its schema, the view derived from an order table, and ingest of vendor rows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import RAW, to_raw_units

ZERO = "0x" + "0" * 40
DAY = 86_400

LEDGER_SCHEMA = T.StructType([
    T.StructField("product", T.StringType(), False), T.StructField("network", T.StringType(), False), T.StructField("id", T.StringType(), False), T.StructField("hash", T.StringType()),
    T.StructField("ts_unix", T.LongType(), False), T.StructField("from_addr", T.StringType(), False), T.StructField("to_addr", T.StringType(), False), T.StructField("value_raw", T.DecimalType(38, 0), False),
])

VENDOR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("from_address", T.StringType()), T.StructField("to_address", T.StringType()), T.StructField("amount", T.DecimalType(38, 18)), T.StructField("timestamp", T.StringType()), T.StructField("transaction_hash", T.StringType()),
    T.StructField("transaction_type", T.StructType([T.StructField("slug", T.StringType())])), T.StructField("token", T.StructType([T.StructField("address", T.StringType()), T.StructField("decimals", T.IntegerType())])),
])

VENDOR_PAGE_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(VENDOR_SCHEMA))])

SUPPLY_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([T.StructField("tokens", T.ArrayType(T.StructType([
    T.StructField("address", T.StringType()), T.StructField("decimals", T.IntegerType()), T.StructField("network_id", T.IntegerType()), T.StructField("network_name", T.StringType()), T.StructField("total_supply_token", T.StructType([T.StructField("val", T.DoubleType())])),
])))])))])


def unix(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> int:
    return int(datetime(year, month, day, hour, minute, second, tzinfo=UTC).timestamp())


NOW = unix(2001, 6, 30, 23, 59, 59)
NOW_EARLY = unix(1996, 6, 30, 23, 59, 59)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def day_of(ts_unix: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_unix / DAY).cast("int"))


def canonical(address: Column, case_sensitive: Column | bool = False) -> Column:
    """Lower case unless the network's encoding tells case apart."""
    flag = F.lit(case_sensitive) if isinstance(case_sensitive, bool) else case_sensitive
    return F.when(flag, address).otherwise(F.lower(address))


def derived_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger out of order lines: mints, customer-supplier transfers both ways and burns over five products.

    One equi-join on the order key; both sides large, so the strategy is left to adaptive execution. What
    the ledger needs of a line is made small before the join's exchange: the product's number in place of the part,
    a code for the kind, a supplier only where one takes part; the line's own columns travel only where ids are asked for.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.when(flag == "N", 0).when(flag == "A", 1).when(status == "F", 2).otherwise(3).cast("byte")
    li = li.withColumns({"_part": F.pmod(F.col("l_partkey"), F.lit(5)).cast("byte"), "_code": code, "_supplier": F.when(code.isin(1, 2), F.col("l_suppkey")), "_ts": seconds(F.col("l_shipdate"))})
    x = li.join(orders, li.l_orderkey == orders.o_orderkey)
    part, ts = F.col("_part"), F.col("_ts")
    decimals = F.when(part.isin(1, 2), 18).otherwise(6)
    kind = F.when(F.col("_code") == 0, "mint").when(F.col("_code") == 1, "sell").when(F.col("_code") == 2, "return").otherwise("burn")
    customer, supplier = F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("s"), F.col("_supplier"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    row_id = F.concat_ws("-", *(F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), flag, status, ts)
    return x.select(
        F.concat(F.lit("p"), part).alias("product"),
        F.concat(F.lit("n"), F.pmod(F.col("l_orderkey"), F.lit(2))).alias("network"),
        row_id.alias("id"),
        F.concat(F.lit("h"), F.col("l_orderkey")).alias("hash"),
        ts.alias("ts_unix"),
        kind.alias("kind"),
        F.when(kind == "mint", ZERO).when(kind == "return", supplier).otherwise(customer).alias("from_addr"),
        F.when(kind == "burn", ZERO).when(kind == "sell", supplier).otherwise(customer).alias("to_addr"),
        decimals.cast("int").alias("decimals"),
        (F.col("l_quantity").cast("decimal(18,0)") * F.when(decimals == 18, F.lit(10**18).cast("decimal(19,0)")).otherwise(F.lit(10**6).cast("decimal(19,0)"))).cast(RAW).alias("value_raw"),
    )


#: The same as a DuckDB table expression.
LEDGER_SQL = f"""ledger AS (
  SELECT 'p' || (l_partkey % 5) AS product, 'n' || (l_orderkey % 2) AS network,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT,
      round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, epoch(l_shipdate)::BIGINT) AS id,
    'h' || l_orderkey AS hash, epoch(l_shipdate)::BIGINT AS ts_unix,
    CASE WHEN l_returnflag = 'N' THEN 'mint' WHEN l_returnflag = 'A' THEN 'sell' WHEN l_linestatus = 'F' THEN 'return' ELSE 'burn' END AS kind,
    CASE WHEN l_returnflag = 'N' THEN '{ZERO}' WHEN l_returnflag = 'A' THEN 'c' || o_custkey WHEN l_linestatus = 'F' THEN 's' || l_suppkey ELSE 'c' || o_custkey END AS from_addr,
    CASE WHEN l_returnflag = 'N' THEN 'c' || o_custkey WHEN l_returnflag = 'A' THEN 's' || l_suppkey WHEN l_linestatus = 'F' THEN 'c' || o_custkey ELSE '{ZERO}' END AS to_addr,
    CASE WHEN l_partkey % 5 IN (1, 2) THEN 18 ELSE 6 END AS decimals,
    l_quantity::HUGEINT * CASE WHEN l_partkey % 5 IN (1, 2) THEN 1000000000000000000 ELSE 1000000 END AS value_raw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def normalise_vendor(rows: DataFrame, product: str | Column, network: str | Column, decimals: int | Column, allowed_tokens: list[str] | None = None, since: str | None = None, before: str | None = None) -> DataFrame:
    """Vendor transactions as ledger rows.

    ``product``, ``network`` and ``decimals`` are one unit's values or columns of ``rows``, so that all units
    go through one pass. Rows of tokens outside the allow-list are left out first; a token whose decimals
    differ from the configured ones, and a missing counterparty that is neither a mint's sender nor a
    burn's receiver, raise; kinds are compared as they are written. ``since`` and ``before`` (ISO days) bound
    the scan: the first inclusive, the second not.
    """
    product, network, decimals = (x if isinstance(x, Column) else F.lit(x) for x in (product, network, decimals))
    day = F.substring("timestamp", 1, 10)
    if since:
        rows = rows.where(day >= since)
    if before:
        rows = rows.where(day < before)
    if allowed_tokens is not None:
        rows = rows.where(F.lower("token.address").isin([t.lower() for t in allowed_tokens]))
    slug = F.coalesce("transaction_type.slug", F.lit(""))
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} of transaction "), F.coalesce("id", F.lit("null")))).cast("string")
    sender = F.when(F.col("from_address").isNotNull(), F.col("from_address")).when(slug.contains("mint"), ZERO).otherwise(bad("missing sender"))
    receiver = F.when(F.col("to_address").isNotNull(), F.col("to_address")).when(slug.contains("burn"), ZERO).otherwise(bad("missing receiver"))
    same = F.coalesce(F.col("token.decimals"), decimals) == decimals
    units = F.when(same, to_raw_units(F.col("amount"), decimals)).otherwise(bad("token decimals").cast(RAW))
    return rows.select(
        product.alias("product"), network.alias("network"), "id", F.col("transaction_hash").alias("hash"),
        F.unix_timestamp(F.to_timestamp("timestamp")).alias("ts_unix"), sender.alias("from_addr"), receiver.alias("to_addr"), units.alias("value_raw"),
    )


def read_vendor_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of paged JSON responses."""
    return spark.read.schema(VENDOR_PAGE_SCHEMA).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def explode_supply(pages: DataFrame) -> DataFrame:
    """(address, network_id, decimals, supply) of every token with a supply, addresses in lower case. A page without a result raises."""
    some = F.when(F.coalesce(F.size("results"), F.lit(0)) > 0, F.col("results")).otherwise(F.raise_error(F.lit("a supply page without a result")))
    tokens = pages.select(F.explode(some).alias("r")).select(F.explode("r.tokens").alias("t"))
    return tokens.select(F.lower("t.address").alias("address"), F.col("t.network_id").alias("network_id"), F.col("t.decimals").alias("decimals"), F.col("t.total_supply_token.val").alias("supply")).where("supply is not null")


def earliest_day(ledger: DataFrame) -> DataFrame:
    """First transfer day of each product and network."""
    return ledger.groupBy("product", "network").agg(day_of(F.min("ts_unix")).cast("string").alias("first_day"))


def in_scope(ledger: DataFrame, products: list[str] | None = None, networks: list[str] | None = None) -> DataFrame:
    """Only the products a run is limited to, and the networks allowed for backfill; without a list all of them."""
    for column, names in (("product", products), ("network", networks)):
        if names is not None:
            ledger = ledger.where(F.col(column).isin(names))
    return ledger


def windowed(rows: DataFrame, since_unix: int, before_unix: int, page_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of [since, before), and (pages): how many requests of ``page_size`` rows they stand for, an empty window one."""
    some = rows.where((F.col("ts_unix") >= since_unix) & (F.col("ts_unix") < before_unix))
    return some, some.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("long").alias("pages"))


def earliest_of(*dated: tuple[DataFrame, str]) -> DataFrame:
    """(first_day): the earliest day over several tables and their date columns; empty ones count for nothing."""
    parts = [df.agg(F.min(column).cast("date").alias("d")) for df, column in dated]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.min("d").cast("string").alias("first_day"))


def in_feed_order(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``rows`` with ``place``: their number in each unit by time, those of one second as the feed had them. A unit's line is spread over tasks."""
    from ..operators.ordered import ordered_scan

    return ordered_scan(rows, keys, "ts_unix", [position], number="place")


def fresh(df: DataFrame, now_unix: int, ttl_seconds: int, column: str = "fetched_at") -> DataFrame:
    """Cached rows still within their time to live."""
    return df.where(F.lit(now_unix) - F.col(column) < ttl_seconds)
