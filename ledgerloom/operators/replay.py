"""Balance replay and flows in one pass over transfer legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import RAW
from ..sources.ledger import DAY, ZERO, canonical

WINDOW = 90 * DAY


def legs(ledger: DataFrame, keys: tuple[str, ...] = ("product", "network"), case_sensitive: Column | bool = False) -> DataFrame:
    """(keys, address, signed amount, is_in, ts_unix): each transfer's credit and debit, the zero address left out."""
    amount = F.col("value_raw").cast(RAW)
    row = lambda a, v, i: F.struct(canonical(F.col(a), case_sensitive).alias("address"), v.cast(RAW).alias("amount"), F.lit(i).alias("is_in"))
    both = F.array(row("to_addr", amount, True), row("from_addr", -amount, False))
    return ledger.select(*keys, "ts_unix", F.explode(both).alias("leg")).select(*keys, "ts_unix", "leg.*").where(F.lower("address") != ZERO)


def wallets(legs_: DataFrame, now: int, keys: tuple[str, ...] = ("product", "network"), window: int = WINDOW) -> DataFrame:
    """One row a wallet: balance, flows in the trailing window (start inclusive), first receipt, window outbound count.

    The only shuffle is by (keys, address), after partial sums; every measure of holders builds on it.
    """
    recent = F.col("ts_unix") >= now - window
    zero = F.lit(0).cast(RAW)
    return legs_.groupBy(*keys, "address").agg(
        F.sum("amount").cast(RAW).alias("balance"),
        F.coalesce(F.sum(F.when(recent & F.col("is_in"), F.col("amount"))), zero).cast(RAW).alias("inflow"),
        F.coalesce(F.sum(F.when(recent & ~F.col("is_in"), -F.col("amount"))), zero).cast(RAW).alias("outflow"),
        F.min(F.when(F.col("is_in"), F.col("ts_unix"))).alias("first_receipt"),
    )


def balances(ledger: DataFrame, keys: tuple[str, ...] = ("product", "network"), case_sensitive: Column | bool = False) -> DataFrame:
    """Positive balances."""
    return legs(ledger, keys, case_sensitive).groupBy(*keys, "address").agg(F.sum("amount").cast(RAW).alias("balance")).where("balance > 0")


def negative_balances(wallets_: DataFrame) -> DataFrame:
    """Wallets that hold less than nothing: transfers landed on keys that don't match."""
    return wallets_.where("balance < 0")
