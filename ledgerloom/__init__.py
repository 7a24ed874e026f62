"""Ledger analytics on Spark: balances, holder behaviour, supply, composite index, incremental state."""
