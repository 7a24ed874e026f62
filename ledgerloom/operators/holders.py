"""Largest holders, shares of supply and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW, permyriad, tokens

TOP = (1, 3, 5, 10)


def top_holders(holders: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n largest balances of each group (ties by address) with their share of all balances, in percent.

    The rank filter sits on the window, so each task sends at most n rows a group; totals are a
    pre-aggregated group-by of the same holders joined back.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("balance"), "address")
    ranked = holders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    totals = holders.groupBy(*keys).agg(F.sum("balance").cast(RAW).alias("total"))
    return ranked.join(totals, keys).withColumn("share_pct", permyriad(F.col("balance"), F.col("total")) / 100.0)


def concentration(holders: DataFrame, keys: list[str], sizes: tuple[int, ...] = TOP) -> DataFrame:
    """Summed share (percent) of the largest 1, 3, 5 and 10 holders."""
    top = top_holders(holders, max(sizes), keys)
    part = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("balance"))).cast(RAW)
    return top.groupBy(*keys).agg(*(permyriad(part(k), F.max("total")).alias(f"_{k}") for k in sizes)).select(*keys, *((F.col(f"_{k}") / 100.0).alias(f"top{k}_pct") for k in sizes))


def holder_stats(holders: DataFrame, supply: DataFrame, n: int = 10) -> DataFrame:
    """Holder count and the n largest with shares of an external total supply (product, supply_raw)."""
    w = Window.partitionBy("product").orderBy(F.desc("balance"), "address")
    count = holders.groupBy("product").agg(F.count("*").alias("holder_count"))
    ranked = holders.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    share = permyriad(F.col("balance"), F.col("supply_raw")) / 100.0
    return ranked.join(count, "product").join(supply, "product").select("product", "rank", "address", "balance", "holder_count", share.alias("share_of_supply_pct"))


def positive_tokens(wallets: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of positive balances in tokens; needs a ``decimals`` column."""
    held = wallets.groupBy(*keys, "decimals").agg(F.coalesce(F.sum(F.when(F.col("balance") > 0, F.col("balance"))), F.lit(0)).cast(RAW).alias("positive_raw"))
    return held.withColumn("positive_tokens", tokens(F.col("positive_raw"), F.col("decimals")))
