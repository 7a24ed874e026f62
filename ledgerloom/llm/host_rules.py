"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents.

1. Counts of every whole text (words, symbols, repeated lines and words) are taken in Arrow batches, a
   text at a time; nothing of a text leaves its task but its counts.
2. Each of ``RULES`` is a share of a document that fails above its limit. One aggregation by host (partial
   sums first, so a hot host is a row a task) gives its documents and those that fail the base or a rule.
3. Method of moments over all hosts: mean m and variance v of the hosts' rates, the sampling part
   taken off; the prior is beta(m * s, (1 - m) * s) with s = m * (1 - m) / v - 1, held to 1 .. ``MOST_PRIOR``. A
   host's posterior rate is (failures + m * s) / (n + s): few documents say little, many speak for themselves.
4. The posterior rate gives the host's verdict, and the verdict scales the limits that its documents are
   held to: ``suspect`` (above ``SUSPECT``, or above twice the mean) halves them, ``trusted`` (below half the mean)
   makes them half as wide again, others are ``plain``. Verdicts are joined back to the documents; one that is
   above its host's limits goes. No verdict rejects a document that is clean itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
#: What share of a document may be, in hundredths: (numerator, denominator, limit).
RULES = {
    "symbols": ("n_symbols", "word_chars", 5),
    "dup_lines": ("n_dup_lines", "n_lines", 60),
    "repeats": ("n_repeat_words", "n_words", 40),
}
#: Verdict -> what a host's limits are multiplied with, in tenths.
SCALE = {"trusted": 15, "plain": 10, "suspect": 5}
SUSPECT = 0.5
MOST_PRIOR = 1_000
#: Hosts whose verdicts are broadcast; if there are more, those with the most documents, and the rest by shuffle.
MOST_BROADCAST_HOSTS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(ids: np.ndarray) -> int:
    """Words covered by windows of three words that the text holds twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    names = int(ids.max()) + 1
    first = ids[:-1].astype(np.int64) * names + ids[1:]
    _, pairs = np.unique(first, return_inverse=True)  # ranks stay below n, so the next product fits
    _, window, count = np.unique(pairs[:-1].astype(np.int64) * names + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one whole text; words are runs of anything but the six ASCII blanks."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "replace").split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x and x.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ids) if len(known) < len(words) else 0


def count_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, counts) of every row."""

    def run(batches):
        for batch in batches:
            rows = [text_counts(t) for t in batch.column(2).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in columns)], names=["doc_id", "host", *COUNTS])

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words"))


def above(tenths: Column) -> Column:
    """Whether any rule's share is above so many tenths of its limit, in whole numbers."""
    out = F.lit(False)
    for numerator, denominator, limit in RULES.values():
        out = out | (F.col(numerator) * 1000 > F.col(denominator) * limit * tenths)
    return out


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n, failed): documents and rule failures of each host; null is a host of its own."""
    return counted.groupBy("host").agg(F.count("*").alias("n"), F.sum((base_failed() | above(F.lit(10))).cast("long")).alias("failed"))


def beta_prior(rates: DataFrame) -> DataFrame:
    """(mean, strength), one row: a beta distribution fitted to the hosts' rates by moments.

    The mean is over documents; the spread that sampling alone would give is taken off the rates'
    variance. Without spread, or with one host, the strength is ``MOST_PRIOR``. Sums are of whole numbers or in
    host-sized terms, so that the order of rows hardly matters.
    """
    n, k = F.sum("n").cast("double"), F.sum("failed").cast("double")
    rate = F.col("failed") / F.col("n")
    sums = rates.agg(n.alias("n"), (k / n).alias("mean"), F.sum(F.col("n") * rate * rate).alias("squares"), F.count("*").alias("hosts"))
    spread = F.col("squares") / F.col("n") - F.col("mean") * F.col("mean") - F.col("hosts") * F.col("mean") * (1 - F.col("mean")) / F.col("n")
    strength = F.when(spread > 0, F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / spread - 1, F.lit(1.0)), F.lit(float(MOST_PRIOR)))).otherwise(F.lit(float(MOST_PRIOR)))
    return sums.select("mean", strength.alias("strength"))


def host_verdicts(rates: DataFrame) -> DataFrame:
    """(host, n, failed, rate, verdict) with the posterior rate."""
    both = rates.crossJoin(F.broadcast(beta_prior(rates)))  # one row
    both = both.withColumn("rate", (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    verdict = F.when((F.col("rate") > SUSPECT) | (F.col("rate") > 2 * F.col("mean")), "suspect").when(F.col("rate") < F.col("mean") / 2, "trusted").otherwise("plain")
    return both.select("host", "n", "failed", "rate", verdict.alias("verdict"))


def _with_verdicts(counted: DataFrame, rates: DataFrame) -> DataFrame:
    """Documents with their hosts' verdicts; no host of many documents is a key of a shuffle."""
    verdicts = host_verdicts(rates).select(F.col("host").alias("_host"), "n", F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    same = F.col("host").eqNullSafe(F.col("_host"))
    hosts, total = rates.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if hosts <= MOST_BROADCAST_HOSTS:
        return counted.join(F.broadcast(verdicts), same, "left").drop("_host", "n")
    many = F.col("n") * MOST_BROADCAST_HOSTS > total  # of so many hosts at most
    found = counted.join(F.broadcast(verdicts.where(many)), same, "left").drop("_host", "n")
    rest = found.where("host_verdict is null").select(*counted.columns).join(verdicts.where(~many), same, "left").drop("_host", "n")
    return found.where("host_verdict is not null").unionByName(rest)


def apply_host_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, counts, base_failed, host_rate, host_verdict, kept) for every row.

    Null and empty texts have no words and fail the base rule; a null host is a host of its own. Repeated rows
    count each; texts are counted whole at any length. An empty table gives no rows. Other columns aren't read.
    """
    counted = shared_checkpoint(count_texts(df, id_col, text_col, host_col))
    rates = shared_checkpoint(host_rates(counted))
    joined = _with_verdicts(counted, rates)
    tenths = F.lit(SCALE["plain"])
    for verdict, scale in SCALE.items():
        tenths = F.when(F.col("host_verdict") == verdict, scale).otherwise(tenths)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | above(tenths)))


def _above_sql(tenths: str) -> str:
    return "(" + " OR ".join(f"{a} * 1000 > {b} * {limit} * {tenths}" for a, b, limit in RULES.values()) + ")"


_BASE_SQL = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PCT} * n_words)"
_WORD_SQL = "'[^\\x20\\x09-\\x0D]+'"

#: The same in DuckDB's SQL.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, {_WORD_SQL}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD_SQL})) AS lines FROM docs),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS j FROM twice) GROUP BY r),
counted AS (
  SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered c USING (r)),
rates AS (SELECT host, count(*) AS n, count(*) FILTER ({_BASE_SQL} OR {_above_sql('10')}) AS failed FROM counted GROUP BY host),
sums AS (SELECT sum(n)::DOUBLE AS n, sum(failed)::DOUBLE / sum(n)::DOUBLE AS mean, sum(n * (failed::DOUBLE / n) * (failed::DOUBLE / n)) AS squares, count(*) AS hosts FROM rates),
spreads AS (SELECT mean, squares / n - mean * mean - hosts * mean * (1 - mean) / n AS spread FROM sums),
prior AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0::DOUBLE), {MOST_PRIOR}::DOUBLE) ELSE {MOST_PRIOR}::DOUBLE END AS strength FROM spreads),
posterior AS (SELECT host, mean, (failed + mean * strength) / (n + strength) AS rate FROM rates CROSS JOIN prior),
verdicts AS (SELECT host, CASE WHEN rate > {SUSPECT} OR rate > 2 * mean THEN 'suspect' WHEN rate < mean / 2 THEN 'trusted' ELSE 'plain' END AS host_verdict FROM posterior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, {_BASE_SQL} AS base_failed,
  NOT ({_BASE_SQL} OR {_above_sql("CASE host_verdict " + " ".join(f"WHEN '{v}' THEN {k}" for v, k in SCALE.items()) + " END")}) AS kept, host_verdict
FROM counted c JOIN verdicts v ON c.host IS NOT DISTINCT FROM v.host
"""
