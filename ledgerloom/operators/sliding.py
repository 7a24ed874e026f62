"""Holder behaviour on every day of a ledger's history, from one sweep over each wallet's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW
from ..sources.ledger import DAY, day_of
from .behaviour import LABELS, label
from .replay import WINDOW, legs


def leaves_window(ts_unix: Column, window: int = WINDOW) -> Column:
    """The first day whose last second no longer looks back at ``ts_unix`` (a window's start is inclusive)."""
    return F.date_add(day_of(ts_unix + 1), window // DAY)


def wallet_days(ledger: DataFrame, keys: tuple[str, ...] = ("product",), window: int = WINDOW) -> DataFrame:
    """(keys, address, day, until, balance, inflow, outflow): a wallet from each day that changes anything to the day before the next.

    A transfer is two events: on its own day it adds to balance and flow, on the day it leaves the window
    the flow falls back. Events are summed by wallet and day before one running sum, so neither the window's
    length nor the number of days multiplies anything; transfers are shuffled before they double. ``until`` is null on a wallet's last row.
    """
    amount = F.col("amount")
    zero = F.lit(0).cast(RAW)
    flow = lambda sign: (F.when(F.col("is_in"), amount).otherwise(zero) * sign).cast(RAW).alias("inflow"), lambda sign: (F.when(F.col("is_in"), zero).otherwise(-amount) * sign).cast(RAW).alias("outflow")
    enters = F.struct(day_of(F.col("ts_unix")).alias("day"), amount.alias("net"), flow[0](1), flow[1](1))
    leaves = F.struct(leaves_window(F.col("ts_unix"), window).alias("day"), zero.alias("net"), flow[0](-1), flow[1](-1))
    dealt = legs(ledger, keys).repartition(*keys, "address")  # the one exchange: sums by day and the running sum stay inside
    events = dealt.select(*keys, "address", F.explode(F.array(enters, leaves)).alias("e")).select(*keys, "address", "e.*")
    daily = events.groupBy(*keys, "address", "day").agg(*(F.sum(c).cast(RAW).alias(c) for c in ("net", "inflow", "outflow")))
    w = Window.partitionBy(*keys, "address").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda c: F.sum(c).over(run).cast(RAW)
    return daily.select(*keys, "address", "day", F.date_sub(F.lead("day").over(w), 1).alias("until"), so_far("net").alias("balance"), so_far("inflow").alias("inflow"), so_far("outflow").alias("outflow"))


def daily_mix(ledger: DataFrame, keys: tuple[str, ...] = ("product",), window: int = WINDOW) -> DataFrame:
    """(keys, day, one count a label, total): holders by behaviour at the end of every day, from a unit's first transfer day to the ledger's last.

    Wallets count only where their label changes: one more from the day on, one less from the day after.
    These steps are summed by unit, day and label, and a running sum over a unit's days gives the counts.
    """
    spans = ledger.groupBy(*keys).agg(day_of(F.min("ts_unix")).alias("day"), day_of(F.max("ts_unix")).alias("_end"))  # a row a unit
    last = F.broadcast(spans.agg(F.max("_end").alias("_last")))  # one row
    held = wallet_days(ledger, keys, window).where("balance > 0").withColumn("label", label(F.col("inflow"), F.col("outflow")))
    step = lambda day, n: F.struct(day.alias("day"), F.lit(n).cast("long").alias("n"))
    ends = F.array(step(F.col("day"), 1), step(F.date_add("until", 1), -1))
    steps = held.select(*keys, "label", F.explode(ends).alias("s")).select(*keys, "label", "s.*").where("day is not null")
    sums = steps.groupBy(*keys, "day").agg(*(F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x.lower()) for x in LABELS))
    first = spans.select(*keys, "day", *(F.lit(0).cast("long").alias(x.lower()) for x in LABELS))
    sums = sums.unionByName(first).groupBy(*keys, "day").agg(*(F.sum(x.lower()).alias(x.lower()) for x in LABELS))  # days without holders count too
    w = Window.partitionBy(*keys).orderBy("day")  # a row a day
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = sums.select(*keys, "day", F.lead("day").over(w).alias("_next"), *(F.sum(x.lower()).over(run).alias(x.lower()) for x in LABELS)).join(last).where("day <= _last")
    until = F.least(F.coalesce(F.date_sub("_next", 1), F.col("_last")), F.col("_last"))
    filled = counts.select(*keys, F.explode(F.sequence("day", until)).alias("day"), *(x.lower() for x in LABELS))
    return filled.withColumn("total", sum((F.col(x.lower()) for x in LABELS[1:]), F.col(LABELS[0].lower())))
