"""Connected components of a distributed edge list, nothing of it collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the smallest node reachable.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the smallest of
    them, so paths shrink geometrically. Minima are pre-aggregated before the shuffle and a node with
    very many edges is an ordinary join key that adaptive execution can split. Lineage is cut each
    round through the shared checkpoint folder. Null ends and self-loops are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = shared_checkpoint(e)
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
        e = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = shared_checkpoint(e)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
