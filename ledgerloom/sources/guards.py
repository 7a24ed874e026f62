"""Input guards as observed metrics: violations are counted in the pass that writes, and any refuses the commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Guard = tuple[str, Column]


class Violation(ValueError):
    """Rows broke a guard; ``counts`` has how many by guard."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {v}" for k, v in counts.items() if v))
        self.counts = counts


def vendor_guards(configured: str = "configured", nav: str = "nav_usd") -> list[Guard]:
    """Guards of vendor rows (``sources.ledger.VENDOR_SCHEMA`` with the token's configured decimals and NAV beside them).

    A null kind is no mint and no burn. Amounts are text here, so that one that is no number is seen.
    """
    slug = F.coalesce("transaction_type.slug", F.lit(""))
    return [
        ("missing_sender", F.col("from_address").isNull() & ~slug.contains("mint")),
        ("missing_receiver", F.col("to_address").isNull() & ~slug.contains("burn")),
        ("token_decimals", F.col("token.decimals") != F.col(configured)),
        ("amount_text", F.col("amount").isNull() | ~F.col("amount").rlike(r"^-?\d+(\.\d+)?$")),
        ("missing_nav", F.col(nav).isNull()),
        ("missing_time", F.to_timestamp("timestamp").isNull()),
    ]


def observed(rows: DataFrame, guards: list[Guard], name: str | None = None) -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and an observation that any action on them fills with ``rows`` and each guard's count; a null condition breaks nothing."""
    seen = Observation(name or f"guards-{uuid.uuid4().hex}")
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(n) for n, bad in guards]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def any_broken(guards: list[Guard]) -> Column:
    out = F.lit(False)
    for _, bad in guards:
        out = out | F.coalesce(bad, F.lit(False))
    return out


def write_guarded(rows: DataFrame, guards: list[Guard], write: Callable[[DataFrame], None], commit: Callable[[], None], undo: Callable[[], None] | None = None) -> dict[str, int]:
    """Stage ``rows`` with ``write`` (one action), then ``commit`` if no guard was broken; else ``undo`` and raise.

    Nothing is read twice: the counts come with the rows as they are written.
    """
    watched, seen = observed(rows, guards)
    write(watched)
    counts = seen.get
    if any(v for k, v in counts.items() if k != "rows"):
        if undo:
            undo()
        raise Violation({k: v for k, v in counts.items() if k != "rows"})
    commit()
    return counts


def split_broken(rows: DataFrame, guards: list[Guard]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all guards, broken ones with the names of what they break in ``broken``): for ingest that sets aside instead of refusing."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in guards)))
    marked = rows.withColumn("broken", names)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
