"""The registered ledger queries: plan and SQL side by side."""
