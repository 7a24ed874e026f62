from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.supply import exact_number, latest_supply, read_saved_results
from ledgerloom.sources import guards, paged, sinks
from ledgerloom.sources.ledger import DAY
from ledgerloom.streaming import twins


def test_all_sinks_or_none(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 4).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("t"))
    sinks.write_sinks(sinks.split_rows(df, {"a": ["k", "v"], "b": ["k", "t"]}), path)
    read = lambda s: sorted(map(tuple, sinks.read_sink(spark, path, s).collect()))
    want = read("a"), read("b")
    assert want == (sorted((i, 2 * i) for i in range(40)), sorted((i, "x" if i % 3 == 0 else None) for i in range(40)))
    failing = df.withColumn("v", F.when(F.col("k") == 33, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_sinks(sinks.split_rows(failing, {"a": ["k", "v"], "b": ["k", "t"]}), path)
    assert (read("a"), read("b")) == want  # neither changed
    assert not list((tmp_path / "out" / "_staged").glob("*"))
    sinks.write_sinks(sinks.routed_rows({"a": df.limit(1).select("k", "v"), "b": df.limit(0).select("k", "t")}), path, overwrite=True)
    assert len(read("a")) == 1 and len(list((tmp_path / "out" / "a").glob("*.parquet"))) == 1
    with pytest.raises(Exception, match="no sink"):
        sinks.write_sinks(df.select(F.lit("zz").alias("sink"), F.struct("k").alias("a")), path)


def test_the_source_is_scanned_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(count, "id long")
    sinks.write_sinks(sinks.split_rows(df, {"a": ["id"], "b": ["id"], "c": ["id"]}), str(tmp_path / "o"))
    assert seen.value == 100


def test_twins_of_two_feeds(spark, tmp_path):
    schema = "hash string, from_addr string, to_addr string, value_raw decimal(38,0), id string, ts_unix long"
    row = lambda h, i, t, a="a": (h, a, "b", Decimal(5), i, t * DAY)
    left = [row("h1", "2-h1-0", 1, "acc"), row("h2", "2-h2-0", 2), row("h3", "2-h3-1", 3), row("h3", "2-h3-0", 3), row("end", "e", 900)]
    right = [row("h1", "2_h1_1_0", 1), row("h4", "2_h4_1_0", 5), row("h2", "2_h2_1_0", 60), row("end", "e", 900)]
    streams = []
    for name, rows in (("l", left), ("r", right)):
        for part in (rows[:2], rows[2:-1], rows[-1:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    owners = spark.createDataFrame([("acc", "a")], "account string, owner string")
    out = str(tmp_path / "out")
    twins.write_twins(twins.one_of_twins(streams, owners, 10, 30), out, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.hash, r.from_addr, r.id) for r in spark.read.parquet(out).where("hash <> 'end'").collect())
    assert got == [("h1", "a", "2-h1-0"), ("h2", "a", "2-h2-0"), ("h2", "a", "2_h2_1_0"), ("h3", "a", "2-h3-0"), ("h4", "a", "2_h4_1_0")]  # h2's rows are too far apart


def test_guards_count_in_the_writing_pass_and_refuse(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5"), (2, None), (3, "x")], "id int, amount string")
    rules = [("null_amount", F.col("amount").isNull()), ("text", ~F.col("amount").rlike(r"^\d+$"))]
    path, done = str(tmp_path / "staged"), []
    with pytest.raises(guards.Violation, match="null_amount: 1, text: 1") as e:
        guards.write_guarded(rows, rules, lambda df: df.write.parquet(path), lambda: done.append("commit"), lambda: done.append("undo"))
    assert e.value.counts == {"null_amount": 1, "text": 1} and done == ["undo"]
    assert guards.write_guarded(rows.where("id = 1"), rules, lambda df: df.write.mode("overwrite").parquet(path), lambda: done.append("commit")) == {"rows": 1, "null_amount": 0, "text": 0}
    assert done == ["undo", "commit"]
    good, bad = guards.split_broken(rows, rules)
    assert [r.id for r in good.collect()] == [1] and {r.id: r.broken for r in bad.collect()} == {2: ["null_amount"], 3: ["text"]}


def test_saved_results_and_missing_history(spark, tmp_path):
    texts = spark.createDataFrame([("1.5e3",), ("12",), ("-2E+2",), ("1e-2",), ("x",), (None,), ("449946534147315186905",), ("100.9",)], "t string")
    assert [r[0] if r[0] is None else int(r[0]) for r in texts.select(exact_number(F.col("t"))).collect()] == [1500, 12, -200, 0, None, None, 449946534147315186905, 100]
    (tmp_path / "p.json").write_text('{"result": {"rows": [{"contract_address": "0xA", "day": "2024-01-02 00:00:00.000 UTC", "supply_raw": "1e3"}, {"contract_address": "0xa", "day": "2024-01-03 00:00:00.000 UTC", "supply_raw": "bad"}]}}')
    assert [(r.contract, int(r.supply_raw)) for r in latest_supply(read_saved_results(spark, str(tmp_path / "p.json"))).collect()] == [("0xa", 1000)]
    empty = paged.read_history(spark, str(tmp_path / "nothing"), "id string, n int")
    assert empty.count() == 0 and empty.columns == ["id", "n"]
    paged.write_cache(spark.createDataFrame([("a", 1)], "id string, n int"), str(tmp_path / "some"), 5)
    assert [tuple(r) for r in paged.read_history(spark, str(tmp_path / "some"), "id string, n int").collect()] == [("a", 1)]
