"""What the ledger's queries leave out before rows are exchanged."""

from pyspark.sql import functions as F

from ledgerloom.operators import incremental, views
from ledgerloom.operators.ordered import ordered_scan
from ledgerloom.plans import catalog
from ledgerloom.sources.dimensions import products
from ledgerloom.sources.ledger import derived_ledger

SF = "/root/testdata/sf0.001"


def below_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Join Inner") :]


def test_a_line_is_made_small_before_the_join(spark):
    line = below_join(derived_ledger(spark, SF).select("product", "from_addr", "value_raw")).split("\n")[1]
    assert "AS _part" in line and "AS _supplier" in line
    assert all(c.split("#")[0] not in ("l_partkey", "l_suppkey") for c in line[line.index("[") + 1 :].split(", ") if " AS " not in c and "(" not in c)


def test_cursor_limits_reach_the_scan(spark):
    ledger = derived_ledger(spark, SF)
    cursor = incremental.next_cursor(ledger, None)
    for df in (cursor, incremental.since_cursor(ledger, cursor)):
        assert "scalar-subquery" in below_join(df)


def test_latest_transfers_are_read_from_their_days_only(spark):
    assert "scalar-subquery" in below_join(views.recent_large_transfers(derived_ledger(spark, SF), products(spark), 30.0))


def test_supply_reads_mints_and_burns_only(spark):
    assert "IN (mint,burn)" in below_join(catalog._latest_aum(spark, SF))


def test_ordered_rows_do_not_move_to_meet_small_steps(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "100000")
    try:
        got = ordered_scan(rows, ["k"], "t", [], number="n", step=10_000, piece=50_000)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("n <> floor(t / 2) + 1").count() == 0
    finally:
        spark.conf.set(key, before)


def test_months_deal_transfers_by_wallet_once(spark):
    """Calendar, flows, sums by month and the pass for the top 5 share one exchange of transfers, and so one join of lines."""
    key, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(key, "false")  # so that the plan shows what is used again
    try:
        plan = catalog.factor_inputs(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set(key, before)
    made = [line for line in plan if "ReusedExchange" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in made) == 1
    assert sum("FileScan parquet" in line and "l_orderkey" in line for line in made) == 1


def test_months_of_transfers_without_product_holder_or_time(spark):
    """Such transfers are of no wallet; the calendar still begins and ends with them if they have a time."""
    from decimal import Decimal

    from ledgerloom.operators import index
    from ledgerloom.sources.ledger import LEDGER_SCHEMA, ZERO, unix

    row = lambda product, at, a, b, v: (product, "n0", "i", "h", at, a, b, Decimal(v))
    rows = [
        row("p0", unix(2020, 1, 5), ZERO, ZERO, 7), row("p0", unix(2020, 2, 5), ZERO, "a", 3_000_000), row("p0", unix(2020, 2, 28), "a", "b", 1_000_000),
        row(None, unix(2020, 4, 30), ZERO, "a", 5), row("p0", None, ZERO, "a", 9_000_000),
    ]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_SCHEMA.fields)
    got = index.product_months(spark.createDataFrame(rows, schema), products(spark)).where("product = 'p0'").orderBy("month").collect()
    assert [(str(r.month_end), r.aum_micro, r.holder_count, r.volume_micro) for r in got] == [("2020-01-31", 0, 0, 0), ("2020-02-29", 3_000_000, 2, 1_000_000), ("2020-03-31", 3_000_000, 2, 0), ("2020-04-30", 3_000_000, 2, 0)]
