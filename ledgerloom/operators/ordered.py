"""Scans in order over keys that are few and hot.

A window by key puts all rows of a key into one task. Here a key's line is cut into pieces of about
``PIECE`` rows, whose borders and whose values carried in (rows, sums and last values before the piece)
come from one aggregation by (key, step of the order column), a row a day or so. Each row then needs
its own piece only: the window's key is (key, piece), spread evenly whatever the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW
from ..sources.ledger import DAY

PIECE = 1_000_000


def ordered_scan(
    rows: DataFrame, keys: list[str], at: str, ties: list[str], number: str | None = None, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, step: int = DAY, piece: int = PIECE
) -> DataFrame:
    """``rows`` with running values of each key's line in order of ``at`` (a long) and ``ties``, the row itself included.

    ``number`` names a row number from 1; ``sums`` are running sums of exact integers; ``lasts`` the last
    value that isn't null. Rows of a key that agree in ``at`` and ``ties`` stand in any order. A step of one key is never
    cut, so it should be short enough for a task. Two passes over ``rows``; the table between them has
    a row a key and step. It is kept, so that its size is known and rows aren't shuffled to meet it while it is small.
    """
    sums, lasts = sums or {}, lasts or {}
    place = F.struct(at, *ties)
    stepped = rows.withColumn("_step", F.floor(F.col(at) / step))
    measures = [F.count("*").alias("_n")]
    measures += [F.coalesce(F.sum(c), F.lit(0)).cast(RAW).alias(f"_s_{n}") for n, c in sums.items()]
    measures += [F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_l_{n}") for n, c in lasts.items()]
    by_key = Window.partitionBy(*keys).orderBy("_step")  # a row a step
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    steps = stepped.groupBy(*keys, "_step").agg(*measures)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n")]
    carried += [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).cast(RAW).alias(f"_s_{n}") for n in sums]
    carried += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts]
    steps = steps.select(*keys, "_step", *carried).withColumn("_piece", F.floor(F.col("_n") / piece))
    first = Window.partitionBy(*keys, "_piece").orderBy("_step")
    names = ["_n", *(f"_s_{n}" for n in sums), *(f"_l_{n}" for n in lasts)]
    steps = steps.select(*keys, "_step", "_piece", *(F.first(c).over(first).alias(c) for c in names))

    steps = steps.persist()
    steps.count()
    dealt = stepped.join(steps, [*keys, "_step"])
    inside = Window.partitionBy(*keys, "_piece").orderBy(at, *ties)
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    if number:
        out[number] = F.col("_n") + F.row_number().over(inside)
    out |= {n: (F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(run), F.lit(0))).cast(RAW) for n, c in sums.items()}
    out |= {n: F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(f"_l_{n}")) for n, c in lasts.items()}
    return dealt.select(*rows.columns, *(c.alias(n) for n, c in out.items()))
