"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

1. The size of a document is its number of words. Sources in code-point order, null last, weigh
   1, 2, 3, 1, 2, 3, ... and share all words; a target stops at ``MOST`` times its source's size and
   the excess goes to the others by weight (water filling, solved by one running sum over sources).
2. The total is cut into blocks of ``BLOCK`` words. Blocks go to sources by highest quotients
   target / 1, / 3, / 5, ...; a source's blocks go to its shards the same way, by shard size. The
   quotas of a divisor method lie within a proven distance of the ideal share, so only the few
   quotients near it are listed and ranked, never one row a block.
3. A source has one shard per ``SHARD`` words, documents are dealt by a digest of id and text, so a hot
   source, and rows that share an id or have none, are many groups of bounded size. In a shard, documents stand in a seeded order on one line of words; the
   quota takes the line as often as it fits and then blocks in a row from a seeded start, round the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, shared_checkpoint

BLOCK = 16
SHARD = 500_000
MOST = 3
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(*parts) -> Column:
    """md5 of the seed and the parts, as 32 hex digits; nulls are written as an empty field."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts)))


def number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long")


def same(a: str, b: str, names: list[str]) -> Column:
    """Null-safe equality of the named columns of two aliased tables."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows before this one in ``order`` (which must tell rows apart).

    Rows are dealt to ranges of the order and summed inside each; only one total a range, as many as
    there are partitions, passes through one task.
    """
    dealt = shared_checkpoint(df.repartitionByRange(partitions_for(df), *order).withColumn("_range", F.spark_partition_id()))
    each = dealt.groupBy("_range").agg(*(F.sum(e).alias(f"_of_{n}") for n, e in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_range", *(F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_of_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "_range")
    return out.withColumns({n: F.col(f"_of_{n}") + F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()}).drop("_range", *(f"_of_{n}" for n in sums))


def with_totals(df: DataFrame, group: list[str], *totals: Column) -> DataFrame:
    """``df`` with aggregates over each group (over all rows without one); groups meet only as partial sums."""
    if not group:
        return df.crossJoin(F.broadcast(df.agg(*totals)))  # one row
    each = df.groupBy(*group).agg(*totals)
    names = [c for c in each.columns if c not in group]
    return df.alias("a").join(_small(each).alias("b"), same("a", "b", group)).select("a.*", *(f"b.{n}" for n in names))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, total) from (source, size). Nothing holds all sources in one task."""
    by = shared_checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    name = F.col("source").asc_nulls_last()
    by = running(by, [name], {"_rank": F.lit(1)}).withColumn("weight", F.col("_rank") % 3 + 1).drop("_rank")
    by = with_totals(by, [], F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).withColumn("most", F.col("source_size") * MOST)
    by = running(by, [(F.col("most") / F.col("weight")).asc(), name], {"place": F.lit(1), "before": F.col("most"), "weight_before": F.col("weight")})
    by = by.withColumn("level", (F.col("total") - F.col("before")) / (F.col("weights") - F.col("weight_before")))
    held = F.col("level") * F.col("weight") <= F.col("most")
    by = with_totals(shared_checkpoint(by), [], F.min_by("level", F.when(held, F.col("place"))).alias("water"))
    return by.select("source", "source_size", F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.col("most").cast("double"), F.col("water") * F.col("weight"))).alias("target"), "total")


def quotas(items: DataFrame, group: list[str], order: Column, amount: str, seats: Column) -> DataFrame:
    """``items`` with ``quota``: ``seats`` of each group dealt to its rows by the highest of amount / (2k + 1).

    With A the group's amount, n its rows and S its seats, the divisor d obeys |S - A/d| <= n/2, so a
    quota lies within a/d +- 1/2 for a/d in S*a/A*(1 +- n/(2S)). All quotients below that range win, all
    above lose; those inside (some 4n in a group) are ranked, ties by ``order``. The ranking runs over
    ranges of (group, quotient), so neither many rows nor a hot group meet in one task.
    """
    x = with_totals(items.withColumn("_seats", seats), group, F.sum(amount).alias("_all"), F.count("*").alias("_n"))
    x = x.withColumn("_ideal", F.when(F.col("_all") > 0, F.col("_seats") * F.col(amount) / F.col("_all")).otherwise(0.0))
    x = x.withColumn("_slack", F.when(F.col("_seats") > 0, F.col("_ideal") * F.col("_n") / (2 * F.col("_seats"))).otherwise(0.0))
    x = x.withColumn("_base", F.greatest(F.lit(0), F.floor(F.col("_ideal") - F.col("_slack") - 0.500001)).cast("long"))
    x = x.withColumn("_top", F.when(F.col(amount) > 0, F.ceil(F.col("_ideal") + F.col("_slack") + 1.500001)).otherwise(0).cast("long"))
    x = with_totals(shared_checkpoint(x), group, F.sum("_base").alias("_dealt")).withColumn("_open", F.col("_seats") - F.col("_dealt"))
    listed = x.withColumn("_k", F.explode_outer(F.when(F.col("_top") > F.col("_base"), F.sequence(F.col("_base"), F.col("_top") - 1))))
    quotient = (F.col(amount) / (2 * F.col("_k") + 1)).desc_nulls_last()
    listed = shared_checkpoint(running(listed, [*(F.col(g).asc_nulls_last() for g in group), quotient, order, F.col("_k").asc()], {"_r": F.lit(1)}))
    listed = with_totals(listed, group, F.min("_r").alias("_first"))
    won = listed.withColumn("_won", (F.col("_k").isNotNull() & (F.col("_r") - F.col("_first") < F.col("_open"))).cast("long"))
    keys = items.columns
    return won.groupBy(*keys).agg((F.max("_base") + F.sum("_won")).alias("quota"))


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast only when counted to be small; else the join shuffles, and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.count() <= rows else df


def mix_sources(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; with ``keep`` also the whole row, as ``row``,
    and ``pieces``: the (from, to) word numbers of each piece taken, whole copies first; no word is in two partial ones.

    A null text has size 0 and is never taken; a null source is a source of its own; rows that repeat
    a doc_id are separate documents; a very long one is cut between words only where its quota ends. No document is taken more than ``MOST`` times. An empty table
    gives no rows. Extra columns are read only if kept.
    """
    known = ["doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_digest")]
    totals = shared_checkpoint(docs.select(*known))
    narrow = docs.select(*known, F.struct(*docs.columns).alias("row")) if keep else totals
    sources = shared_checkpoint(source_targets(totals.select("source", "size")))

    def sharded(df: DataFrame) -> DataFrame:
        joined = df.alias("d").join(_small(sources).alias("s"), same("d", "s", ["source"])).select("d.*", "s.source_size", "s.target")
        count = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).cast("long")
        return joined.withColumn("order_key", digest("doc_id", "text_digest")).withColumn("shard", F.pmod(number(F.col("order_key")), count))

    shards = sharded(totals).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    seats = F.floor(F.col("total") / BLOCK + 0.5).cast("long")
    per_source = quotas(sources.select("source", "target", "total"), [], F.col("source").asc_nulls_last(), "target", seats).select("source", F.col("quota").alias("seats"))
    shards = shards.alias("d").join(_small(shared_checkpoint(per_source)).alias("s"), same("d", "s", ["source"])).select("d.*", "s.seats")
    shards = shared_checkpoint(quotas(shards, ["source"], F.col("shard"), "shard_size", F.col("seats")).select("source", "shard", "shard_size", "quota"))
    rows = sharded(narrow).alias("d").join(_small(shards).alias("q"), same("d", "q", ["source", "shard"])).select("d.*", "q.shard_size", "q.quota")

    line = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("low", F.coalesce(F.sum("size").over(line), F.lit(0)))
    words, size, z = F.col("quota") * BLOCK, F.col("size"), F.col("shard_size")
    rows = rows.withColumn("rounds", F.when(z > 0, F.floor(words / z)).otherwise(0).cast("long"))
    rows = rows.withColumn("start", F.when(z > 0, F.pmod(number(digest("source", "shard")), F.ceil(z / BLOCK)) * BLOCK).otherwise(0).cast("long"))
    rows = rows.withColumn("stop", F.col("start") + words - F.col("rounds") * z)
    cover = lambda a, b: F.greatest(F.lit(0), F.least(F.col("low") + size, b) - F.greatest(F.col("low"), a))
    part = cover(F.col("start"), F.least(F.col("stop"), z)) + cover(F.lit(0), F.col("stop") - z)
    taken = F.least(MOST * size, F.col("rounds") * size + part).cast("long")
    piece = lambda a, b: F.struct(a.cast("long").alias("from"), b.cast("long").alias("to"))
    ends = [(F.col("start"), F.least(F.col("stop"), z)), (F.lit(0), F.col("stop") - z)]
    parts = F.array(*(piece(F.greatest(F.lit(0), a - F.col("low")), F.least(size, b - F.col("low"))) for a, b in ends))
    parts = F.filter(parts, lambda x: x["to"] > x["from"])
    whole = F.array_repeat(piece(F.lit(0), size), F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int"))
    pieces = F.concat(whole, F.when((size > 0) & (taken % F.greatest(size, F.lit(1)) > 0), parts).otherwise(F.slice(parts, 1, 0)))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row", pieces.alias("pieces")] if keep else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and of a document taken in part the very words taken.

    Rows without words (null or empty texts) are never taken; repeated rows are documents of their own; very
    long texts are cut between words; an empty table gives no rows; extra columns of whatever name are copied.
    """
    rows = mix_sources(docs, keep=True).withColumn("piece", F.explode("pieces"))
    words = F.col("piece.to") - F.col("piece.from")
    part = words < F.col("size")
    found = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(found, (F.col("piece.from") + 1).cast("int"), words.cast("int")), "")
    rows = rows.withColumn("cut", F.when(part, cut))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.when(part, F.col("cut")).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(part, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(v.alias(c) for c, v in out.items()))


#: The same in DuckDB's SQL.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS order_key
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1 AS weight,
         (sum(source_size) OVER ())::BIGINT AS total FROM by_source),
placed AS (
  SELECT *, row_number() OVER r AS place,
         (total - coalesce(sum(source_size * {MOST}) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW r AS (ORDER BY (source_size * {MOST})::DOUBLE / weight, source ASC NULLS LAST)),
level AS (SELECT arg_min(level, place) AS water FROM placed WHERE level * weight <= source_size * {MOST}),
sources AS (
  SELECT source, source_size, total, CASE WHEN total = 0 THEN 0.0 ELSE least((source_size * {MOST})::DOUBLE, water * weight) END::DOUBLE AS target,
         floor(total::DOUBLE / {BLOCK} + 0.5)::BIGINT AS seats
  FROM placed, level),
source_near AS (
  SELECT *, CASE WHEN sum(target) OVER () > 0 THEN seats * target / sum(target) OVER () ELSE 0 END AS ideal, count(*) OVER () AS n FROM sources),
source_base AS (
  SELECT *, greatest(0, floor(ideal - CASE WHEN seats > 0 THEN ideal * n / (2 * seats) ELSE 0 END - 0.500001))::BIGINT AS base,
         (CASE WHEN target > 0 THEN ceil(ideal + CASE WHEN seats > 0 THEN ideal * n / (2 * seats) ELSE 0 END + 1.500001) ELSE 0 END)::BIGINT AS top FROM source_near),
source_listed AS (
  SELECT source, base, unnest(range(base, top)) AS k, target, seats - sum(base) OVER () AS open FROM source_base),
source_won AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source ASC NULLS LAST, k) <= open AS won FROM source_listed),
source_quota AS (
  SELECT s.source, any_value(s.base) + coalesce(sum(w.won::INT), 0) AS quota
  FROM source_base s LEFT JOIN source_won w ON s.source IS NOT DISTINCT FROM w.source GROUP BY s.source),
dealt AS (
  SELECT d.*, s.source_size, s.target, ('0x' || substr(order_key, 1, 8))::BIGINT % greatest(1, ceil(s.source_size::DOUBLE / {SHARD}))::BIGINT AS shard
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (
  SELECT d.source, d.shard, sum(d.size)::BIGINT AS shard_size, any_value(q.quota) AS seats
  FROM dealt d JOIN source_quota q ON d.source IS NOT DISTINCT FROM q.source GROUP BY d.source, d.shard),
shard_near AS (
  SELECT *, CASE WHEN sum(shard_size) OVER g > 0 THEN seats * shard_size::DOUBLE / sum(shard_size) OVER g ELSE 0 END AS ideal, count(*) OVER g AS n
  FROM shards WINDOW g AS (PARTITION BY source)),
shard_base AS (
  SELECT *, greatest(0, floor(ideal - CASE WHEN seats > 0 THEN ideal * n / (2 * seats) ELSE 0 END - 0.500001))::BIGINT AS base,
         (CASE WHEN shard_size > 0 THEN ceil(ideal + CASE WHEN seats > 0 THEN ideal * n / (2 * seats) ELSE 0 END + 1.500001) ELSE 0 END)::BIGINT AS top FROM shard_near),
shard_listed AS (
  SELECT source, shard, shard_size, unnest(range(base, top)) AS k, seats - sum(base) OVER (PARTITION BY source) AS open FROM shard_base),
shard_won AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) <= open AS won FROM shard_listed),
shard_quota AS (
  SELECT s.source, s.shard, any_value(s.shard_size) AS z, (any_value(s.base) + coalesce(sum(w.won::INT), 0))::BIGINT * {BLOCK} AS words
  FROM shard_base s LEFT JOIN shard_won w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard GROUP BY s.source, s.shard),
lines AS (
  SELECT d.doc_id, d.size, d.source_size, d.target, q.z, q.words, CASE WHEN q.z > 0 THEN q.words // q.z ELSE 0 END AS rounds,
         coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.order_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
         CASE WHEN q.z > 0 THEN ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(d.source, ''), d.shard::VARCHAR)), 1, 8))::BIGINT % ceil(q.z::DOUBLE / {BLOCK})::BIGINT * {BLOCK} ELSE 0 END AS start
  FROM dealt d JOIN shard_quota q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard)
SELECT doc_id, size, source_size, target,
       least({MOST} * size, rounds * size
         + greatest(0, least(low + size, least(start + words - rounds * z, z)) - greatest(low, start))
         + greatest(0, least(low + size, start + words - rounds * z - z) - low))::BIGINT AS taken
FROM lines
"""
