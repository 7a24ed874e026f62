"""Incremental maintenance of holder state: boundary dedup, cursor, additive merge, gated rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import RAW, tokens
from ..sources.ledger import DAY
from ..sources.store import VersionedStore
from .replay import legs

KEYS = ["product", "network"]
# The limits of the reconciliation and of the gate.
#: How much worse than the stored state a rebuilt one may deviate from supply and still replace it.
REBUILD_SLACK = 0.005
WARN_SHARE, MIN_NOTIONAL_USD = 0.05, 1_000_000


def _of_unit(rows: DataFrame, measure: Column) -> Column:
    """A row's unit's ``measure`` over ``rows``, null for units without rows.

    One map of as many entries as there are configured products and networks, so that a filter on it needs no
    join and goes down to the scan, ahead of any exchange below.
    """
    entry = F.struct(F.struct(*KEYS).alias("k"), F.col("_m"))
    found = rows.groupBy(*KEYS).agg(measure.alias("_m")).agg(F.map_from_entries(F.collect_list(entry))).scalar()
    return F.try_element_at(found, F.struct(*KEYS))


def since_cursor(ledger: DataFrame, cursor: DataFrame | None) -> DataFrame:
    """Rows from the start of each cursor's UTC day on; all rows of products and networks without one."""
    if cursor is None:
        return ledger
    begin = _of_unit(cursor, F.floor(F.max("last_ts") / DAY) * DAY)
    return ledger.where(F.coalesce(F.col("ts_unix") >= begin, F.lit(True)))


def drop_boundary(fetched: DataFrame, cursor: DataFrame | None) -> DataFrame:
    """Without rows whose ids the cursor has seen on its boundary day. By id, never by order; no cursor or no ids drops nothing."""
    if cursor is None:
        return fetched
    return fetched.join(cursor.where("id is not null").select(*KEYS, "id"), [*KEYS, "id"], "left_anti")


def next_cursor(fresh: DataFrame, prior: DataFrame | None) -> DataFrame:
    """(product, network, last_ts, id): the latest time, and a row for each id of its UTC day.

    Ids of the same day as before are joined by the earlier ones; without new rows the cursor stays. Ids
    are rows, so a busy day is spread over tasks; the end of a window without rows is a row with a null id.
    """
    seen = fresh.select(*KEYS, "ts_unix", "id")
    if prior is not None:
        seen = seen.unionByName(prior.select(*KEYS, F.col("last_ts").alias("ts_unix"), "id"))
    last = _of_unit(seen, F.max("ts_unix"))
    return seen.where(F.floor(F.col("ts_unix") / DAY) == F.floor(last / DAY)).select(*KEYS, last.alias("last_ts"), "id").distinct()


def deltas(fresh: DataFrame, case_sensitive: Column | bool = False) -> DataFrame:
    """(product, network, address, balance, first_receipt) changes of new rows."""
    return legs(fresh, tuple(KEYS), case_sensitive).groupBy(*KEYS, "address").agg(F.sum("amount").cast(RAW).alias("balance"), F.min(F.when(F.col("is_in"), F.col("ts_unix"))).alias("first_receipt"))


def merge(state: DataFrame | None, change: DataFrame) -> DataFrame:
    """State plus changes: balances add up, first receipts keep the minimum, zero rows stay for re-entry."""
    both = change if state is None else state.select(change.columns).unionByName(change)
    return both.groupBy(*KEYS, "address").agg(F.sum("balance").cast(RAW).alias("balance"), F.min("first_receipt").alias("first_receipt"))


def unit_name(product: str, network: str) -> str:
    return f"{product}/{network}"


def lifecycle(store: VersionedStore) -> dict[str, dict]:
    """Backfill state by unit: ``lifecycle`` (in_progress or complete; a unit never begun has none) and ``span_days``."""
    return store.meta.get("units", {})


def outside_backfill(ledger: DataFrame, store: VersionedStore) -> DataFrame:
    """Without the units whose backfill is in progress: normal runs leave those alone."""
    busy = [u for u, x in lifecycle(store).items() if x["lifecycle"] == "in_progress"]
    return ledger.where(~F.concat_ws("/", *KEYS).isin(busy)) if busy else ledger


def run_increment(ledger: DataFrame, store: VersionedStore) -> int:
    """One run: fetch from the cursor's day, drop what was seen, merge, move the cursor; one atomic commit."""
    return _advance(outside_backfill(ledger, store), store)


def _advance(ledger: DataFrame, store: VersionedStore, meta: dict | None = None, at_least: tuple[str, str, int] | None = None) -> int:
    at = store.version
    state, cursor = store.read("state"), store.read("cursor")
    fresh = drop_boundary(since_cursor(ledger, cursor), cursor)
    moved = next_cursor(fresh, cursor)
    if at_least:  # the cursor of a window's end, where the window held nothing later
        end = ledger.sparkSession.createDataFrame([(*at_least, None)], moved.schema)
        moved = next_cursor(moved.unionByName(end).withColumnRenamed("last_ts", "ts_unix"), None)
    return store.commit({"state": merge(state, deltas(fresh)), "cursor": moved}, meta, expect=at)


def reconcile(held: DataFrame) -> DataFrame:
    """Status of (product, .., positive_tokens, supply_tokens, nav_usd): skipped without, or with too little, supply; else within 5 % or not."""
    s, p = F.col("supply_tokens"), F.col("positive_tokens")
    deviation = F.abs(p - s) / F.nullif(s, F.lit(0.0))
    status = F.when(s.isNull(), "skipped: no supply").when(s <= 0, "skipped: supply not positive").when(s * F.col("nav_usd") < MIN_NOTIONAL_USD, "skipped: below floor").when(deviation > WARN_SHARE, "deviates").otherwise("ok")
    return held.withColumn("deviation", F.when(s > 0, deviation)).withColumn("status", status)


def rebuild_gate(stored: DataFrame, candidate: DataFrame, supply: DataFrame) -> DataFrame:
    """Whether a rebuilt state may replace the stored one, by (product, network).

    Both are compared with supply (product, network, decimals, supply_tokens); no supply, or none above
    zero, is no basis and skips. The candidate wins unless it deviates more than the stored one plus slack.
    """

    def held(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEYS).agg(F.sum(F.when(F.col("balance") > 0, F.col("balance"))).cast(RAW).alias(name))

    x = supply.join(held(stored, "a"), KEYS, "left").join(held(candidate, "b"), KEYS, "left")
    off = lambda c: F.abs(tokens(F.coalesce(c, F.lit(0).cast(RAW)), F.col("decimals")) - F.col("supply_tokens")) / F.nullif("supply_tokens", F.lit(0.0))
    x = x.withColumn("stored_deviation", F.when(F.col("supply_tokens") > 0, off("a"))).withColumn("candidate_deviation", F.when(F.col("supply_tokens") > 0, off("b")))
    return x.withColumn("decision", F.when(F.coalesce(F.col("supply_tokens"), F.lit(0.0)) <= 0, "skip").when(F.col("candidate_deviation") <= F.col("stored_deviation") + REBUILD_SLACK, "swap").otherwise("keep")).drop("a", "b")


def rebuild(ledger: DataFrame, supply: DataFrame, store: VersionedStore) -> int | None:
    """Recompute from the start and swap in what passes the gate; the version made, or None if nothing did."""
    at = store.version
    state, cursor = store.read("state"), store.read("cursor")
    candidate = merge(None, deltas(ledger))
    gate = rebuild_gate(state, candidate, supply).where("decision = 'swap'").select(*KEYS)
    if gate.isEmpty():
        return None
    swap = lambda old, new: old.join(gate, KEYS, "left_anti").select(new.columns).unionByName(new.join(gate, KEYS, "left_semi").select(new.columns))
    return store.commit({"state": swap(state, candidate), "cursor": swap(cursor, next_cursor(ledger, None))}, expect=at)


def backfill(windows: list[DataFrame], store: VersionedStore, complete: bool) -> int:
    """Windows of all units together, oldest to newest, one commit a window, so a stopped run resumes after the last."""
    for i, rows in enumerate(windows):
        last = complete and i == len(windows) - 1
        _advance(rows, store, {"lifecycle": "complete" if last else "in_progress"})
    return store.version


def backfill_unit(product: str, network: str, windows: list[tuple[DataFrame, int]], store: VersionedStore, complete: bool, span_days: int | None = None) -> int:
    """A unit's windows (rows, end exclusive), oldest to newest, one commit each: state, cursor, lifecycle and span together.

    The cursor ends at the last row's time or, in a window without rows, at its end, so that an empty stretch
    isn't asked for again. ``span_days`` is what the next run is to begin with. While the unit is in
    progress, ``run_increment`` leaves it alone.
    """
    unit = unit_name(product, network)
    for i, (rows, end) in enumerate(windows):
        done = complete and i == len(windows) - 1
        entry = {**lifecycle(store).get(unit, {}), "lifecycle": "complete" if done else "in_progress", **({"span_days": span_days} if span_days else {})}
        mine = rows.where((F.col("product") == product) & (F.col("network") == network))
        empty = (product, network, end - 1) if mine.isEmpty() else None
        _advance(mine, store, {"units": {**lifecycle(store), unit: entry}}, empty)
    return store.version


TWIN = ["hash", "from_addr", "to_addr", "value_raw"]


def owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Account addresses replaced by their owners on both sides; ``owners`` is (account, owner).

    A null owner raises for ids of the dash feed (``2-hash-n``) and keeps the address for those of the
    underscore feed (``2_hash_1_n``).
    """
    x = rows
    for side in ("from_addr", "to_addr"):
        o = owners.select(F.col("account").alias(side), F.col("owner").alias("_o"), F.lit(True).alias("_known"))
        x = x.join(o, side, "left")
        lost = F.col("_known").isNotNull() & F.col("_o").isNull() & F.col("id").rlike("^[0-9]+-")
        x = x.withColumn(side, F.when(lost, F.raise_error(F.concat(F.lit("no owner of "), side)).cast("string")).otherwise(F.coalesce("_o", side))).drop("_o", "_known")
    return x


def resolve_twins(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``owned`` rows, then one of each twin: rows of equal hash, ends and value are twins; the one of the smallest id stays."""
    rest = [c for c in rows.columns if c not in (*TWIN, "id")]
    one = owned(rows, owners).groupBy(*TWIN).agg(F.min_by(F.struct("id", *rest), "id").alias("r"))
    return one.select(*(F.col(c) if c in TWIN else F.col(f"r.{c}").alias(c) for c in rows.columns))
