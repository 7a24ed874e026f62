import hashlib
import heapq
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        level = Fraction(total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in rest)) if rest else 0
        over = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s] if s in capped else level * weight[s]) for s in order}
        capped |= over


def brute_seats(amounts, seats):
    heap = [(-a, k, 0) for k, a in amounts.items() if a > 0]
    heapq.heapify(heap)
    out = defaultdict(int)
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-amounts[k] / (2 * n + 3), k, n + 1))
    return out


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_quotas_are_the_highest_quotients(spark, seats):
    rng = random.Random(seats)
    amounts = {f"s{i:02d}": rng.choice([0, 1, 5, rng.randint(1, 10**6)]) for i in range(40)} | {"hot": 10**7}
    df = spark.createDataFrame(list(amounts.items()), "k string, a long")
    got = {r.k: r.quota for r in M.quotas(df, [], F.col("k"), "a", F.lit(seats)).collect()}
    assert got == {k: brute_seats(amounts, seats)[k] for k in amounts}


def documents(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "é", "Z", None, "tiny"])
        k = rng.choice([0, 1, 3, 50, 400]) if s != "tiny" else rng.choice([0, 1])
        rows.append((i, rng.choice([" ", "\n"]).join(["w"] * k) or rng.choice([None, "", " \t"]), s, "x"))
    return rows


@pytest.mark.parametrize("shard", [M.SHARD, 2000])
def test_mix_meets_targets_and_sql(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD", shard)
    rows = documents(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix_sources(df).collect()
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s, _ in rows}
    for i, n in size.items():
        sizes[source[i]] += n
    want = brute_targets(sizes)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        shards = max(1, -(-sizes[s] // shard))
        assert abs(taken[s] - t) <= M.BLOCK * (1 + shards)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_sources(df.repartition(3)).collect()))
    documents_ = df.toPandas()  # noqa: F841
    sql = M.SQL.replace("/ 500000)", f"/ {shard})")
    con = duckdb.connect()
    con.register("documents", documents_)
    assert sorted(con.execute(sql).fetchall()) == sorted(map(tuple, got))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [*documents(4, 120), (7, "same id again here", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and {r.size for r in mixed.collect()} == {"x"}
    words = mixed.select(M.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == M.mix_sources(df).agg(F.sum("taken")).first()[0]
    assert mixed.where(F.length("text") != F.col("n_chars")).count() == 0


def test_many_sources_meet_the_sql(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 5, 40])), f"host{i % 20_000}" if i % 7 else None, "x") for i in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    documents = df.toPandas()  # noqa: F841
    got = M.mix_sources(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duckdb.sql(M.SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_rows_of_one_id_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 2000)
    rows = [(None if i % 2 else 5, f"t{i} " * 40, "hot", "x") for i in range(1000)]
    got = M.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1000 and sum(r.taken for r in got) == pytest.approx(40_000, abs=M.BLOCK * 22)
    monkeypatch.setattr(M, "digest", lambda *p: F.lit("0" * 32))  # all in one shard: what the text in the key prevents
    assert sum(r.taken for r in M.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()) == 40_000


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    got = {r.i: (r.s, r.n) for r in M.running(df, [F.col("g").asc_nulls_last(), F.col("i").desc()], {"s": F.col("x"), "n": F.lit(1)}).collect()}
    total = 0
    for n, (_, i, x) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1]))):
        assert got[i] == (total, n)
        total += x


def test_mixed_documents_of_odd_tables(spark):
    schema = "doc_id long, text string, source string, size string, taken long, shard string, piece string, row string"
    assert M.mixed_documents(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, "s", 1, "a", "b", "c"), (1, "", "a", "s", 1, "a", "b", "c"), (2, "word " * 300_000, "a", "s", 1, "a", "b", "c"), (3, "one two", None, "s", 1, "a", "b", "c"), (3, "one two", None, "s", 1, "a", "b", "c")]
    out = M.mixed_documents(spark.createDataFrame(rows, schema))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "size", "taken", "shard", "piece", "row"]
    assert {(r["size"], r.taken, r.shard, r.piece, r["row"]) for r in got} == {("s", 1, "a", "b", "c")}
    assert abs(sum(len((r.text or "").split()) for r in got) - 300_004) <= 3 * M.BLOCK


def test_empty_and_wordless(spark):
    assert M.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    got = M.mix_sources(spark.createDataFrame([(1, None, None, ""), (None, " ", "a", "")], SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (None, 0, 0.0, 0)}


def test_mixed_documents_hold_the_very_words_of_the_run(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(rng.choice([1, 30, 300, 2000]))), rng.choice("abc"), "x") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = [(r.source, r.text.split()) for r in M.mixed_documents(df).collect()]
    taken, tails = {r.source: r.n for r in M.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}, 0
    md5 = lambda *x: hashlib.md5("|".join(map(str, (M.SEED, *x))).encode()).hexdigest()
    for s, n in taken.items():
        line = [w for i, t, x, _ in sorted(rows, key=lambda r: md5(r[0], hashlib.md5(r[1].encode()).hexdigest())) if x == s for w in t.split()]
        z = len(line)
        start = int(md5(s, 0)[:8], 16) % -(-z // M.BLOCK) * M.BLOCK
        want = Counter({w: n // z for w in line})
        want.update((line + line)[start : start + n % z])
        assert Counter(w for x, t in texts if x == s for w in t) == want
        tails += sum(not t[0].endswith(".0") for x, t in texts if x == s)
    assert tails
