"""Window sizing and budget rules of chunked backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the backfill's rules.
TARGET_PAGES, MIN_DAYS, MAX_DAYS, INITIAL_DAYS, RUN_BUDGET = 40, 1, 60, 30, 80


def clamp_span(days: Column) -> Column:
    return F.greatest(F.lit(MIN_DAYS), F.least(F.lit(MAX_DAYS), days)).cast("int")


def next_span(days: Column, pages: Column, target: int = TARGET_PAGES) -> Column:
    """The span that would have met the page target at the last window's density; an empty window doubles it."""
    return clamp_span(F.when(pages > 0, F.floor(target * days / F.nullif(pages, F.lit(0)) + 0.5)).otherwise(days * 2))


def halved_span(days: Column) -> Column:
    return F.greatest(F.lit(MIN_DAYS), F.floor(days / 2)).cast("int")


def capped_span(candidate: Column, last_days: Column, last_pages: Column, budget: Column, target: int = TARGET_PAGES) -> Column:
    """``candidate`` cut to what the remaining page budget affords at the last density, a day at least."""
    cap = F.least(F.lit(target), F.greatest(F.lit(0), budget))
    most = F.floor(cap / F.nullif(last_pages / F.nullif(last_days, F.lit(0)), F.lit(0.0)))
    return F.when((last_pages <= 0) | (last_days <= 0), candidate).otherwise(F.greatest(F.lit(MIN_DAYS), F.least(candidate, most))).cast("int")


def sequential_budget(items: DataFrame, order: str, cost: str, budget: int, group: list[str] | None = None) -> DataFrame:
    """``items`` with ``remaining`` before each and whether it ``runs``: one runs while anything is left, even if it overdraws."""
    w = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(cost).over(w), F.lit(0))
    return items.withColumn("remaining", left.cast("long")).withColumn("runs", left > 0)


#: Fixed: transport errors that a 400 response may wrap.
TRANSPORT_ERRORS = "ETIMEDOUT|ECONNRESET|ECONNREFUSED|EAI_AGAIN|socket hang up|reason: connect"


def http_retryable(status: Column, body: Column) -> Column:
    """Server errors, and a 400 whose body wraps a transport error."""
    return (status >= 500) | ((status == 400) & F.coalesce(body, F.lit("")).rlike(f"(?i)({TRANSPORT_ERRORS})"))


def rate_limited(message: Column) -> Column:
    return F.coalesce(message.rlike(r"HTTP 429\b"), F.lit(False))
