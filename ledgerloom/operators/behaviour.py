"""Behaviour labels and what is counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import RAW, permyriad
from .replay import WINDOW

LABELS = ("Dormant", "Active", "Accumulating", "Distributing")


def label(inflow: Column, outflow: Column) -> Column:
    """By gross flows of the window: none, both, in only, out only."""
    return F.when((inflow <= 0) & (outflow <= 0), "Dormant").when((inflow > 0) & (outflow > 0), "Active").when(inflow > 0, "Accumulating").otherwise("Distributing")


def classify(wallets: DataFrame) -> DataFrame:
    """Holders (positive balance) with their label."""
    return wallets.where("balance > 0").withColumn("behavior", label(F.col("inflow"), F.col("outflow")))


def classify_joined(positive: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for balances and window flows kept apart; a holder without flows is dormant."""
    x = positive.join(flows, keys, "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)).cast(RAW) for c in ("inflow", "outflow")}).withColumn("behavior", label(F.col("inflow"), F.col("outflow")))


def exited_addresses(flows: DataFrame, positive: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses with net outflow in the window that hold nothing now."""
    return flows.where("outflow - inflow > 0").join(positive, keys, "left_anti")


def mix(classified: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("behavior") == x).alias(x.lower()) for x in LABELS]
    return classified.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def stats(wallets: DataFrame, now: int, keys: list[str], window: int = WINDOW) -> DataFrame:
    """The full bundle a group, from wallet rows in one aggregation."""
    holder = F.col("balance") > 0
    lab = label(F.col("inflow"), F.col("outflow"))
    when = lambda x: F.count_if(holder & (lab == x))
    held = F.sum(F.when(holder, F.col("balance"))).cast(RAW)
    still = F.sum(F.when(holder & (F.col("outflow") <= 0), F.col("balance"))).cast(RAW)
    g = wallets.groupBy(*keys).agg(
        F.count_if(holder).alias("holder_count"),
        *(when(x).alias(f"behavior_{x.lower()}") for x in LABELS),
        F.coalesce(held, F.lit(0)).cast(RAW).alias("_held"),
        F.coalesce(still, F.lit(0)).cast(RAW).alias("_still"),
        F.count_if(holder & (F.col("first_receipt") >= now - window)).alias("net_new_wallets_90d"),
        F.count_if(~holder & (F.col("outflow") - F.col("inflow") > 0)).alias("exited_wallets_90d"),
    )
    a, d = F.col("behavior_accumulating"), F.col("behavior_distributing")
    return g.withColumn("dormancy_share_pct", permyriad(F.col("_still"), F.col("_held")) / 100.0).withColumn("net_accumulation_ratio", F.when(a + d > 0, a.cast("double") / (a + d))).drop("_held", "_still")


def mix_percent(mixed: DataFrame) -> DataFrame:
    """Each label's share of holders in percent; 0 of no holders."""
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(0.0)
    return mixed.withColumns({f"{x.lower()}_pct": pct(x.lower()) for x in LABELS})


def aggregate_networks(rows: DataFrame) -> DataFrame:
    """Per-network statistics rolled up to products.

    Counts add up, the ratio is recomputed. Dormancy of one network stays; of several it is weighted by
    market value, and null unless every network has one and they sum to more than nothing.
    """
    mv = F.col("market_value_usd")
    n, known, total = F.count("*"), F.count(mv), F.sum(mv)
    weighted = F.when((known == n) & (total > 0), F.sum(F.col("dormancy_share_pct") * mv) / F.nullif(total, F.lit(0.0)))
    g = rows.groupBy("product").agg(
        *(F.sum(c).alias(c) for c in ("holder_count", *(f"behavior_{x.lower()}" for x in LABELS), "net_new_wallets_90d", "exited_wallets_90d")),
        F.when(n == 1, F.min("dormancy_share_pct")).otherwise(weighted).alias("dormancy_share_pct"),
        F.when(known == n, total).alias("market_value_usd"),
        n.alias("networks"),
        *([F.max("classified_at").alias("classified_at")] if "classified_at" in rows.columns else []),
    )
    a, d = F.col("behavior_accumulating"), F.col("behavior_distributing")
    return g.withColumn("net_accumulation_ratio", F.when(a + d > 0, a.cast("double") / (a + d))).withColumn("net_change", F.col("net_new_wallets_90d") - F.col("exited_wallets_90d"))


def latest_classification(rows: DataFrame) -> DataFrame:
    """(classified_at): the latest time over all funds; null of none."""
    return rows.agg(F.max("classified_at").alias("classified_at"))


def stats_from_classifications(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates rebuilt from stored rows (keys, balance, behavior, classified_at).

    What the rows can't tell, net-new and exited wallets, is 0; dormancy is the balance of those labelled
    dormant or accumulating, who sent nothing in the window.
    """
    is_ = lambda x: F.col("behavior") == x
    held = F.sum("balance").cast(RAW)
    still = F.coalesce(F.sum(F.when(is_("Dormant") | is_("Accumulating"), F.col("balance"))), F.lit(0)).cast(RAW)
    g = stored.groupBy(*keys).agg(
        F.count("*").alias("holder_count"), *(F.count_if(is_(x)).alias(f"behavior_{x.lower()}") for x in LABELS),
        F.lit(0).cast("long").alias("net_new_wallets_90d"), F.lit(0).cast("long").alias("exited_wallets_90d"),
        (permyriad(still, held) / 100.0).alias("dormancy_share_pct"), F.max("classified_at").alias("classified_at"),
    )
    a, d = F.col("behavior_accumulating"), F.col("behavior_distributing")
    return g.withColumn("net_accumulation_ratio", F.when(a + d > 0, a.cast("double") / (a + d)))
