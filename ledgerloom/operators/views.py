"""Read-side views: history, homepage, recent transfers, fund records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW, tokens, usd_micro
from ..sources.ledger import DAY, ZERO


def month_deltas(readings: DataFrame) -> DataFrame:
    """Change of the composite against the month before; one row a month, hence one window."""
    w = Window.partitionBy().orderBy("month_end")
    return readings.select("month_end", "composite", (F.col("composite") - F.lag("composite").over(w)).alias("delta"))


def month_navigation(readings: DataFrame) -> DataFrame:
    w = Window.partitionBy().orderBy("month_end")
    return readings.select("month_end", F.lag("month_end").over(w).alias("prev_month"), F.lead("month_end").over(w).alias("next_month"))


def latest(df: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The last n rows in ascending order of ``order``."""
    return df.orderBy(F.desc(order)).limit(n)


def recent_large_transfers(ledger: DataFrame, products: DataFrame, usd: float = 1e6, scanned: int = 200, shown: int = 10) -> DataFrame:
    """Of each product's latest ``scanned`` transfers those above ``usd``, at most ``shown``, newest first (ties by id).

    The limit comes before the filter, as in a feed that is read page by page. Days are counted first, so
    that only rows of the days that hold the latest ones are read with all their columns.
    """
    w = Window.partitionBy("product").orderBy(F.desc("ts_unix"), "id")
    day = F.floor(F.col("ts_unix") / DAY)
    newest = Window.partitionBy("product").orderBy(F.desc("_d"))  # a row a day
    days = ledger.groupBy("product", day.alias("_d")).agg(F.count("*").alias("_c")).withColumn("_c", F.sum("_c").over(newest))
    first = days.groupBy("product").agg(F.coalesce(F.max(F.when(F.col("_c") >= scanned, F.col("_d"))), F.min("_d")).alias("_d"))
    begin = first.where("product is not null").agg(F.map_from_entries(F.collect_list(F.struct("product", "_d")))).scalar()  # an entry a product
    x = ledger.where(day >= F.try_element_at(begin, F.col("product"))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= scanned)
    x = x.drop("decimals").join(F.broadcast(products.select("product", "decimals", "nav_usd")), "product")
    x = x.withColumns({"amount": tokens(F.col("value_raw"), F.col("decimals")), "value_micro": usd_micro(F.col("value_raw"), F.col("decimals"), F.col("nav_usd"))})
    x = x.where(F.col("amount") > usd / F.col("nav_usd")).withColumn("rank", F.row_number().over(Window.partitionBy("product").orderBy("_n"))).where(F.col("rank") <= shown)
    return x.select("product", "rank", "id", "ts_unix", "from_addr", "to_addr", "amount", (F.col("value_micro").cast("double") / 1e6).alias("value_usd"), "value_micro", (F.col("from_addr") == ZERO).alias("is_mint"), (F.col("to_addr") == ZERO).alias("is_burn"))


def with_tags(transfers: DataFrame, tags: DataFrame) -> DataFrame:
    """Name tags of both ends."""
    for side in ("from", "to"):
        t = tags.select(F.col("address").alias(f"{side}_addr"), F.col("name_tag").alias(f"{side}_tag"))
        transfers = transfers.join(t, f"{side}_addr", "left")
    return transfers


def homepage(products: DataFrame, latest_aum: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: AUM of products that have any, holders, dormancy weighted by AUM where it is known."""
    x = products.join(latest_aum, "product", "left").join(stats, "product", "left")
    aum, d = F.col("aum_usd"), F.col("dormancy_share_pct")
    live = F.coalesce(F.col("aum_micro") > 0, F.lit(False))
    total = F.sum(F.when(live, F.col("aum_micro"))).cast(RAW)
    return x.agg(
        total.alias("total_aum_micro"), (total.cast("double") / 1e6).alias("total_aum_usd"), F.sum("holder_count").alias("total_holders"), F.count_if(live).alias("products_live"),
        (F.sum(F.when(live, d * aum)) / F.nullif(F.sum(F.when(live & d.isNotNull(), aum)), F.lit(0.0))).alias("dormancy_pct"),
    )


def fund_records(products: DataFrame, stats: DataFrame, latest_aum: DataFrame, top: DataFrame, transfers: DataFrame) -> DataFrame:
    """One record a product, in configured order: statistics, AUM, top holders and large transfers as arrays of bounded size."""
    holders = top.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("rank", "address", "share_pct"))).alias("top_holders"))
    large = transfers.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "value_usd"))).alias("large_transfers"))
    return products.select("product", "cfg_pos").join(stats, "product").join(latest_aum, "product", "left").join(holders, "product", "left").join(large, "product", "left").orderBy("cfg_pos")


def diagnostics(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two tables of equal columns, with the side they are missing from."""
    rest = [c for c in a.columns if c not in keys]
    x = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    differs = ~F.struct(*(F.col(f"a.{c}") for c in rest)).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in rest)))
    where = F.when(F.col(f"a.{keys[0]}").isNull(), "left").when(F.col(f"b.{keys[0]}").isNull(), "right").otherwise("differs")
    return x.where(differs | F.col(f"a.{keys[0]}").isNull() | F.col(f"b.{keys[0]}").isNull()).select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), where.alias("missing_from"))
