"""Supply and AUM series: daily changes, gap filling, as-of lookups, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW, usd_micro
from ..sources.ledger import ZERO, day_of


def supply_change() -> Column:
    """What a transfer adds to supply: mints count, burns count against, others are null."""
    amount = F.col("value_raw")
    return F.when(F.col("from_addr") == ZERO, amount).when(F.col("to_addr") == ZERO, -amount).cast(RAW)


def daily_supply(ledger: DataFrame) -> DataFrame:
    """(product, day, supply_raw): cumulative mints less burns on days that have any. Days are pre-aggregated before the running sum."""
    return running_supply(ledger.groupBy("product", day_of(F.col("ts_unix")).alias("day")).agg(F.sum(supply_change()).cast(RAW).alias("net")))


def running_supply(days: DataFrame) -> DataFrame:
    """The same from (product, day, net), net null on days without mint or burn."""
    w = Window.partitionBy("product").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.where("net is not null").select("product", "day", F.sum("net").over(w).cast(RAW).alias("supply_raw"))


def gap_fill(points: DataFrame, keys: list[str], day: str, value: str, order: str | None = None) -> DataFrame:
    """A row for every day from each series' first to its last, carrying the last value forward.

    Of several points of a day the last by ``order`` counts. No calendar join: each point is stretched to
    the day before the next one.
    """
    if order:
        points = points.groupBy(*keys, day).agg(F.max_by(value, order).alias(value))
    w = Window.partitionBy(*keys).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.col(day))
    return points.withColumn("_until", until).select(*keys, F.explode(F.sequence(F.col(day), F.col("_until"))).alias(day), value)


def with_aum(series: DataFrame, products: DataFrame, supply: str = "supply_raw") -> DataFrame:
    """AUM in USD: tokens at today's NAV, exact as ``aum_micro`` (millionths), and that as a double in ``aum_usd``.

    The product dimension is a handful of rows.
    """
    p = F.broadcast(products.select("product", "decimals", "nav_usd"))
    x = series.join(p, "product").withColumn("aum_micro", usd_micro(F.col(supply), F.col("decimals"), F.col("nav_usd")))
    return x.withColumn("aum_usd", F.col("aum_micro").cast("double") / 1e6)


def by_contract(supply: DataFrame, configured: DataFrame) -> DataFrame:
    """Supply rows (contract, ...) with the product of their contract, whatever its case; rows of other contracts are left out."""
    c = configured.select(F.lower("contract").alias("_contract"), "product").distinct()  # the products' own contracts: a dimension
    return supply.withColumn("_contract", F.lower("contract")).join(F.broadcast(c), "_contract").drop("_contract")


def loose_number(text: Column) -> Column:
    """Supply text that may be in scientific notation, as a double."""
    return text.try_cast("double")


def exact_number(text: Column) -> Column:
    """Number text, perhaps in scientific notation, as an exact integer, a fraction cut off; null if it is no number."""
    ok = text.rlike(r"^[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$")
    return F.when(ok, F.floor(text.try_cast("decimal(38,6)"))).otherwise(F.lit(None)).cast(RAW)


#: One page of a saved query's results.
RESULT_SCHEMA = "result struct<rows: array<struct<contract_address: string, day: string, supply_raw: string>>>"


def read_saved_results(spark, path: str) -> DataFrame:
    """(contract, day, supply_raw) of a saved query's result pages: nothing is executed there, results are read as they were left. Days are UTC text, supplies exact."""
    rows = spark.read.schema(RESULT_SCHEMA).json(path).select(F.explode("result.rows").alias("r")).select("r.*")
    return rows.select(F.lower("contract_address").alias("contract"), F.to_date(F.substring("day", 1, 10)).alias("day"), exact_number(F.col("supply_raw")).alias("supply_raw"))


def latest_supply(daily: DataFrame, key: str = "contract") -> DataFrame:
    """(key, supply_raw): the newest supply that is known of each."""
    return daily.where("supply_raw is not null").groupBy(key).agg(F.max_by("supply_raw", "day").alias("supply_raw"))


def as_of(dates: DataFrame, series: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """``dates`` (keys, day) with the series' last value at or before each; null before its first point.

    Both sides are merged into one stream a key and the value carried forward: one shuffle, no range join.
    """
    points = series.select(*keys, F.col(day).alias("_day"), F.lit(0).alias("_ask"), F.col(value).alias("_v"))
    asks = dates.select(*keys, F.col(day).alias("_day"), F.lit(1).alias("_ask"), F.lit(None).cast(series.schema[value].dataType).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(asks).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_ask = 1").select(*keys, F.col("_day").alias(day), F.col("_v").alias(value))


def daily_total(series: DataFrame) -> DataFrame:
    """AUM summed over the products that have the day; nothing is carried past a series' end.

    Summed in whole millionths, so the result doesn't depend on the order of addition.
    """
    return series.groupBy("day").agg((F.sum("aum_micro").cast(RAW).cast("double") / 1e6).alias("total_aum_usd"), F.count("*").alias("products"))


def supply_by_network(configured: DataFrame, supply: DataFrame) -> DataFrame:
    """Configured tokens (product, network_id, address, decimals) against reported supply: sum, and the tokens missing.

    The sum is null where no token matched; reported decimals that differ from the configured raise.
    """
    c = configured.select("product", "network_id", F.lower("address").alias("address"), F.col("decimals").alias("_want"))
    x = c.join(supply.select("address", "decimals", "supply"), "address", "left")
    bad = F.col("decimals").isNotNull() & (F.col("decimals") != F.col("_want"))
    value = F.when(bad, F.raise_error(F.concat(F.lit("token decimals of "), "address")).cast("double")).otherwise(F.col("supply"))
    return x.withColumn("_v", value).groupBy("product", "network_id").agg(F.sum("_v").alias("supply"), F.sort_array(F.collect_list(F.when(F.col("supply").isNull(), F.col("address")))).alias("missing"))
