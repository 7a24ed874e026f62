"""Scoring of index factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODOLOGY_VERSION = "1.1"


@dataclass(frozen=True)
class Factor:
    key: str
    weight: float
    lo: float
    neutral: float | None
    hi: float
    sign: int = 1


#: Weights, and the raw values that score 0, 50 and 100. A falling share is good, hence the signs.
FACTORS = (
    Factor("aumGrowth3m", 0.25, -0.40, 0.0, 0.65),
    Factor("holderGrowth3m", 0.20, -0.10, 0.0, 0.30),
    Factor("concentrationDelta3m", 0.20, -0.15, 0.0, 0.15, -1),
    Factor("dormancyDelta3m", 0.15, -0.35, 0.0, 0.35, -1),
    Factor("transferActivityRatio", 0.10, 0.0, 1.0, 3.0),
    Factor("breadth", 0.10, 1.0, None, 6.0),
)


def normalize(raw: Column, lo: float, neutral: float | None, hi: float) -> Column:
    """Piecewise-linear score from 0 at ``lo`` over 50 at ``neutral`` to 100 at ``hi``; a range of no width gives 50."""

    def line(a: float, b: float, low: float, high: float) -> Column:
        return F.lit(50.0) if a == b else low + (raw - a) / (b - a) * (high - low)

    if neutral is None:
        value = line(lo, hi, 0.0, 100.0)
    else:
        value = F.when(raw <= neutral, line(lo, neutral, 0.0, 50.0)).otherwise(line(neutral, hi, 50.0, 100.0))
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def factor_score(factor: Factor, raw: Column) -> Column:
    return normalize(raw * float(factor.sign), factor.lo, factor.neutral, factor.hi)


def normalize_sql(raw: str, f: Factor) -> str:
    """The same as SQL text."""
    x = f"({raw}) * {float(f.sign)}"
    if f.neutral is None:
        value = f"0.0::DOUBLE + ({x} - {f.lo}::DOUBLE) / ({f.hi}::DOUBLE - {f.lo}::DOUBLE) * 100.0::DOUBLE"
    else:
        value = (
            f"CASE WHEN {x} <= {f.neutral}::DOUBLE THEN 0.0::DOUBLE + ({x} - ({f.lo})::DOUBLE) / ({f.neutral}::DOUBLE - ({f.lo})::DOUBLE) * 50.0::DOUBLE "
            f"ELSE 50.0::DOUBLE + ({x} - {f.neutral}::DOUBLE) / ({f.hi}::DOUBLE - {f.neutral}::DOUBLE) * 50.0::DOUBLE END"
        )
    return f"CASE WHEN ({raw}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, {value})) END"
