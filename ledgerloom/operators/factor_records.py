"""Readings whose factors are a dynamic record (VARIANT): factors that the code doesn't know survive storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import FACTORS


def factor_record(known: dict[str, tuple[Column, Column]], more: Column | None = None) -> Column:
    """A VARIANT object factor -> {raw, score}; factors whose raw value is null are left out.

    ``more`` is JSON text of further factors; of a name in both, the known one counts.
    """
    record = "struct<raw:double,score:double>"
    entries = F.array_compact(F.array(*(F.when(raw.isNotNull(), F.struct(F.lit(k).alias("key"), F.struct(raw.cast("double").alias("raw"), score.cast("double").alias("score")).alias("value"))) for k, (raw, score) in known.items())))
    own = F.map_from_entries(entries)
    if more is not None:
        parsed = F.coalesce(F.from_json(more, f"map<string,{record}>"), F.create_map().cast(f"map<string,{record}>"))
        own = F.map_concat(own, F.map_filter(parsed, lambda k, v: ~k.isin(list(known))))
    return F.parse_json(F.to_json(own))


def record_of_reading(more: Column | None = None) -> Column:
    """The record of a reading with one column a factor and its score."""
    return factor_record({f.key: (F.col(f.key), F.col(f"{f.key}_score")) for f in FACTORS}, more)


def explode_factors(readings: DataFrame, keys: list[str], factors: str = "factors") -> DataFrame:
    """(keys, factor, raw, score): a row each factor of the record, known or not; an empty or null record gives none."""
    record = F.map_entries(F.col(factors).cast("map<string,variant>"))
    rows = readings.select(*keys, F.explode(record).alias("e"))
    value = lambda name: F.try_variant_get(F.col("e.value"), f"$.{name}", "double")
    return rows.select(*keys, F.col("e.key").alias("factor"), value("raw").alias("raw"), value("score").alias("score"))


def contributions(readings: DataFrame, keys: list[str], factors: str = "factors") -> DataFrame:
    """``explode_factors`` with ``contribution``: the known factors' shares of the composite; null for others."""
    weights = F.create_map(*[x for f in FACTORS for x in (F.lit(f.key), F.lit(f.weight))])
    present = sum((F.when(F.try_variant_get(F.col(factors), f"$.{f.key}.raw", "double").isNotNull(), F.lit(f.weight)).otherwise(0.0) for f in FACTORS), F.lit(0.0))
    rows = explode_factors(readings.withColumn("_present", present), [*keys, "_present"], factors)
    return rows.withColumn("contribution", F.when(F.col("_present") > 0, F.col("score") * weights[F.col("factor")] / F.col("_present"))).drop("_present")
