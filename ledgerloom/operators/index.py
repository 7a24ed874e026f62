"""Month-end metrics, factors and the composite index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RAW, half_up, permyriad, pow10, usd_micro
from ..functions.scores import FACTORS, METHODOLOGY_VERSION, factor_score
from ..sources.ledger import DAY, ZERO, day_of
from .replay import legs

DAYS_30, DAYS_90 = 30 * DAY, 90 * DAY


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_end_day(month: Column) -> Column:
    return F.last_day(F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1)))


def month_end_unix(month: Column) -> Column:
    """23:59:59 of a month's last day."""
    return F.datediff(month_end_day(month), F.lit("1970-01-01").cast("date")).cast("long") * DAY + DAY - 1


def month_calendar(ledger: DataFrame, low: str = "ts_unix", high: str = "ts_unix") -> DataFrame:
    """(month, month_end): every month from the first transfer's to the last complete one."""
    span = ledger.agg(F.min(low).alias("a"), F.max(high).alias("b"))
    first = month_number(day_of(F.col("a")))
    b = month_number(day_of(F.col("b")))
    last = F.when(F.last_day(day_of(F.col("b"))) == day_of(F.col("b")), b).otherwise(b - 1)
    months = span.select(first.alias("first"), last.alias("last")).where("first <= last")
    return months.select(F.explode(F.sequence("first", "last")).alias("month")).withColumn("month_end", month_end_day(F.col("month")))


#: Levels of the month tree: an interval of up to 4096 months is a few blocks, a longer one a few more.
LEVELS = 12


def blocks(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The blocks (level, index) of a binary tree of months that make up the months from ``first`` to ``last``, with nulls between."""
    found = []
    for level in range(levels):
        a, b = F.shiftright(first + (2**level - 1), level), F.shiftright(last + 1, level) - 1  # whole blocks inside
        block = lambda i, ok, level=level: F.when(ok, F.struct(F.lit(level).alias("level"), i.cast("int").alias("block")))
        found += [block(a, (a <= b) & (a % 2 == 1)), block(b, (a <= b) & (b % 2 == 0))]
    a, b = F.shiftright(first + (2**levels - 1), levels), F.shiftright(last + 1, levels) - 1
    whole = F.when(a <= b, F.transform(F.sequence(a, b), lambda i: F.struct(F.lit(levels).alias("level"), i.cast("int").alias("block"))))
    return F.when(a <= b, F.concat(F.array(*found), whole)).otherwise(F.array(*found))


def month_legs(ledger: DataFrame) -> DataFrame:
    """(product, address, amount, ts_unix, is_in, plain, month): what months need of each transfer, dealt by wallet.

    Transfers without a holder at either end stand as nothing for the address '', since their times count for the calendar;
    those without a time are left out.

    What is exchanged is four columns, of which every reader needs each: time, direction and whether a transfer is plain
    are one number, and a product is never null. So readers that differ in the measures they use share the exchange.
    """
    plain = F.coalesce((F.col("from_addr") != ZERO) & (F.col("to_addr") != ZERO), F.lit(False))
    holder = lambda c: F.coalesce(F.lower(F.col(c)) != ZERO, F.lit(False))
    nobody = ~(holder("from_addr") | holder("to_addr"))
    ledger = ledger.where("ts_unix is not null").select(
        F.coalesce("product", F.lit("")).alias("product"), "ts_unix", plain.alias("plain"), "from_addr", F.when(nobody, "").otherwise(F.col("to_addr")).alias("to_addr"), F.when(nobody, F.lit(0).cast(RAW)).otherwise(F.col("value_raw").cast(RAW)).alias("value_raw")
    )
    packed = F.col("ts_unix") * 4 + F.col("plain").cast("long") * 2 + F.col("is_in").cast("long")
    leg = legs(ledger, ("product", "plain")).select("product", "address", packed.alias("_when"), "amount").repartition("product", "address")  # the one exchange: sums by month and the running sum over them stay inside
    ts, received = F.shiftright("_when", 2), F.col("_when").bitwiseAND(1) == 1
    return leg.select("product", "address", "amount", ts.alias("ts_unix"), received.alias("is_in"), (F.col("_when").bitwiseAND(2) == 2).alias("plain"), month_number(day_of(ts)).alias("month"))


def month_changes(ledger: DataFrame) -> DataFrame:
    """(product, address, month, net, out_ts): what a wallet gained in each month it took part in, and its last outbound transfer."""
    return month_legs(ledger).groupBy("product", "address", "month").agg(F.sum("amount").cast(RAW).alias("net"), F.max(F.when(~F.col("is_in"), F.col("ts_unix"))).alias("out_ts"))


def month_flows(ledger: DataFrame) -> DataFrame:
    """(product, month, supply, own_volume, next_volume, first_ts, last_ts): what needs no wallet.

    Supply is what all wallets gained. Volumes are of plain transfers and counted at the receiver: those that the
    month's own end still looks back at, and those that the next one does.
    """
    seen = lambda m: F.sum(F.when(F.col("plain") & F.col("is_in") & (day_of(F.col("ts_unix") + 1) > F.date_sub(month_end_day(m), DAYS_30 // DAY)), F.col("amount"))).cast(RAW)
    return month_legs(ledger).groupBy("product", "month").agg(
        F.sum("amount").cast(RAW).alias("supply"), seen(F.col("month")).alias("own_volume"), seen(F.col("month") + 1).alias("next_volume"), F.min("ts_unix").alias("first_ts"), F.max("ts_unix").alias("last_ts")
    )


def top_floor(largest: Column, k: int = 5) -> Column:
    """A balance that the k-th largest of a month is never below, of the largest balances of groups of wallets among those that changed in the month; null where fewer than k groups hold anything.

    The k-th largest of the groups' largest is reached by k wallets. Plain maxima, no sort of the wallets.
    """
    return F.get(F.sort_array(F.collect_list(largest), False), F.lit(k - 1))


def product_months(ledger: DataFrame, products: DataFrame, groups: int = 16) -> DataFrame:
    """One row a (month, product), from the first transfer's month to the last complete one: AUM, holders, top-5 share, dormant share, 30-day volume and velocity.

    Nothing is replayed a month and no wallet is stretched over its months. The ledger is read once into
    ``month_legs``; over ``month_changes`` a running sum gives the balance from each change to the next, an interval of months.
    Counts, sums, supply and volumes are differences at an interval's ends, summed up month by month: an
    interval is dormant from the first month-end that lies beyond the trailing window of its last outbound
    transfer, and supply is what all wallets gained, since plain transfers cancel. For the top 5 only
    intervals that reach the lowest ``top_floor`` of their months count, some hundred a month; each goes to the few
    blocks of a binary tree of months that make it up, each block keeps its five largest, and a
    month's five are among those of the blocks above it.

    Shuffles: one by (product, address), which ``month_flows``, the sums by month and the pass for the top 5 share; the
    others of pre-aggregated rows by (product, month) or (product, block). The sums by month are gathered into a row a
    product with its floors and the ledger's first and last time, so calendar, floors and measures come from one pass.
    """
    w = Window.partitionBy("product", "address").orderBy("month")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = month_changes(ledger).withColumns({"balance": F.sum("net").over(so_far).cast(RAW), "last_out": F.max("out_ts").over(so_far), "next": F.lead("month").over(w)})
    seen = F.col("last_out") + DAYS_90
    own = month_number(day_of(seen))  # its month-end is the first at or after ``seen``
    still = F.when(F.col("last_out").isNull(), F.col("month")).otherwise(F.greatest(F.col("month"), own + F.when(month_end_unix(own) <= seen, 1).otherwise(0)))
    size = F.col("balance").cast("double").desc()  # settles most comparisons without touching a wide decimal
    top = Window.partitionBy("product", "level", "block").orderBy(size, F.desc("balance"), "address")
    zero, nothing = F.lit(0).cast(RAW), F.lit(None).cast(RAW)
    b, after = F.col("balance"), F.col("next")  # the last interval is open; months after the calendar fall away at the end
    holds = b > 0
    dormant = holds & F.coalesce(F.col("still") < after, F.lit(True))

    def event(month: Column, n: int, total: Column, dormant: Column) -> Column:
        return F.struct(month.cast("long").alias("month"), F.lit(n).alias("n"), total.cast(RAW).alias("total"), dormant.cast(RAW).alias("dormant"))

    ends = F.array(event(F.col("month"), 1, b, nothing), event(after, -1, -b, nothing), event(F.when(dormant, F.col("still")), 0, nothing, b), event(F.when(dormant, after), 0, nothing, -b))
    group = F.pmod(F.hash("address"), F.lit(groups)).alias("_g")
    events = x.where(holds).withColumn("still", still).select("product", group, F.explode(ends).alias("e")).select("product", "_g", "e.*").where("month is not null")
    counts = [F.sum("n").alias("n"), *(F.sum(c).cast(RAW).alias(c) for c in ("total", "dormant"))]
    held = events.groupBy("product", "month", "_g").agg(*counts, F.max("total").alias("_b"))  # the largest total is that of a balance that begins, if any does
    held = held.groupBy("product", "month").agg(*counts, top_floor(F.when(F.col("_b") > 0, F.col("_b"))).alias("floor"))
    flow = lambda month, **values: F.struct(F.expr(month).cast("long").alias("month"), *(F.col(values[c]).alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in (("supply", RAW), ("volume", RAW), ("first_ts", "long"), ("last_ts", "long"))))
    flows = month_flows(ledger).select("product", F.explode(F.array(flow("month", supply="supply", volume="own_volume", first_ts="first_ts", last_ts="last_ts"), flow("month + 1", volume="next_volume"))).alias("e")).select("product", "e.*")  # a row or two a month
    names = ("n", "total", "dormant", "supply", "volume")
    steps = held.unionByName(flows, allowMissingColumns=True).groupBy("product", "month").agg(F.sum("n").alias("n"), *(F.sum(c).cast(RAW).alias(c) for c in names[1:]), F.max("floor").alias("floor"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    lines = steps.groupBy("product").agg(F.collect_list(F.struct("month", *names, "floor", "first_ts", "last_ts")).alias("line"))  # a row a product, a step a month; read by all below
    steps = lines.select("product", F.explode("line").alias("s")).select("product", "s.*")
    calendar = month_calendar(steps, "first_ts", "last_ts")
    grid = calendar.select("month").crossJoin(F.broadcast(products.select("product")))  # months x the products dimension
    run = Window.partitionBy("product").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    floor = F.struct("month", F.coalesce("floor", zero).alias("floor"))
    floors = grid.join(steps.select("product", "month", "floor"), ["product", "month"], "left").groupBy("product").agg(F.transform(F.array_sort(F.collect_list(floor)), lambda m: m["floor"]).alias("floors"), F.min("month").alias("first"), F.max("month").alias("last"))  # an array a product
    until = F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.col("last")).cast("int")
    lowest = F.array_min(F.slice("floors", F.col("month") - F.col("first") + 1, F.greatest(F.col("until") - F.col("month") + 1, F.lit(0))))  # null after the calendar's end
    large = x.where(holds).join(F.broadcast(floors), "product").withColumn("month", F.col("month").cast("int")).withColumn("until", until).where(F.col("balance") >= lowest)
    large = large.select("product", "address", "balance", F.explode(blocks(F.col("month"), F.col("until"))).alias("t")).where("t is not null").select("product", "address", "balance", "t.*")
    large = large.withColumn("_r", F.row_number().over(top)).where("_r <= 5").drop("_r")
    above = calendar.select("month", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(F.col("month").cast("int"), i).alias("block")) for i in range(LEVELS + 1)))).alias("t")).select("month", "t.*")
    by_month = Window.partitionBy("product", "month").orderBy(F.desc("balance"), "address")
    five = large.join(F.broadcast(above), ["level", "block"]).withColumn("_r", F.row_number().over(by_month)).where("_r <= 5").groupBy("product", "month").agg(F.sum("balance").cast(RAW).alias("top5"))

    # one exchange by (product, month) brings all measures together, months without any included
    rows = grid.unionByName(steps.select("product", "month", *names), allowMissingColumns=True).unionByName(five, allowMissingColumns=True)
    x = rows.groupBy("product", "month").agg(F.sum("n").alias("n"), *(F.sum(c).cast(RAW).alias(c) for c in ("total", "dormant", "supply", "top5", "volume")))
    total = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    x = x.withColumns({"holder_count": total("n"), **{c: total(c).cast(RAW) for c in ("total", "dormant", "supply")}})
    x = x.join(F.broadcast(products.select("product", "decimals", "nav_usd")), "product").join(F.broadcast(calendar), "month")  # a row a month
    less = pow10(F.greatest(F.lit(0), F.col("decimals") - 6))
    vol = F.coalesce("volume", zero)
    micro = ((vol - vol % less) / less).cast(RAW)  # tokens to six places, the rest cut
    x = x.withColumns({"volume_micro": usd_micro(micro, F.least(F.col("decimals"), F.lit(6)), F.col("nav_usd")), "aum_micro": usd_micro(F.col("supply"), F.col("decimals"), F.col("nav_usd")).cast(RAW)})
    aum_usd, usd = F.col("aum_micro").cast("double") / 1e6, F.col("volume_micro").cast("double") / 1e6
    return x.select(
        "month", "month_end", "product", "aum_micro", aum_usd.alias("aum_usd"), F.coalesce("holder_count", F.lit(0)).alias("holder_count"),
        (permyriad(F.coalesce("top5", zero), F.coalesce("total", zero)) / 10000.0).alias("top5_share"),
        (permyriad(F.coalesce("dormant", zero), F.coalesce("total", zero)) / 10000.0).alias("dormancy_share"),
        "volume_micro", usd.alias("volume_30d_usd"), F.when(F.col("aum_micro") > 0, usd / aum_usd).otherwise(0.0).alias("velocity"),
    )


def month_rollup(rows: DataFrame) -> DataFrame:
    """One row a month: totals, mean top-5 share over products with holders, AUM-weighted dormancy, velocity, live products. AUM adds up in whole millionths, whatever the order."""
    aum, held = F.col("aum_usd"), F.col("holder_count") > 0
    g = rows.groupBy("month", "month_end").agg(
        F.sum("aum_micro").cast(RAW).alias("total_micro"), (F.sum("aum_micro").cast(RAW).cast("double") / 1e6).alias("total_aum"), F.sum("holder_count").alias("total_holders"), F.coalesce(F.avg(F.when(held, F.col("top5_share"))), F.lit(0.0)).alias("avg_top5_share"),
        F.sum(F.when(aum > 0, F.col("dormancy_share") * aum)).alias("_d"), F.sum(F.when(aum > 0, aum)).alias("_a"),
        F.sum(F.col("velocity") * aum).alias("total_volume_30d"), F.count_if((aum > 0) | held).alias("live_products"),
    )
    return g.withColumn("avg_dormancy_share", F.coalesce(F.col("_d") / F.nullif("_a", F.lit(0.0)), F.lit(0.0))).withColumn("velocity", F.when(F.col("total_aum") > 0, F.col("total_volume_30d") / F.col("total_aum")).otherwise(0.0)).drop("_d", "_a")


def factor_inputs(months: DataFrame) -> DataFrame:
    """Raw factors of each month; null where three months of history are lacking or a base isn't positive.

    The window has no partition: a row a month is all there is.
    """
    w = Window.partitionBy().orderBy("month")
    ago = lambda c: F.lag(c, 3).over(w)
    growth = lambda c: F.when(ago(c) > 0, (F.col(c) - ago(c)) / ago(c))
    before = w.rowsBetween(-3, -1)
    mean = F.when(F.count("velocity").over(before) == 3, F.sum("velocity").over(before) / 3)
    return months.select(
        "month", "month_end", growth("total_aum").alias("aumGrowth3m"), growth("total_holders").alias("holderGrowth3m"), (F.col("avg_top5_share") - ago("avg_top5_share")).alias("concentrationDelta3m"),
        (F.col("avg_dormancy_share") - ago("avg_dormancy_share")).alias("dormancyDelta3m"), F.when(mean > 0, F.col("velocity") / mean).alias("transferActivityRatio"), (F.col("live_products") + 1).cast("double").alias("breadth"),
    )


def composite(inputs: DataFrame) -> DataFrame:
    """Scores and their weighted mean over the factors present; a row without any raises."""
    score = {f.key: factor_score(f, F.col(f.key)) for f in FACTORS}
    present = sum((F.when(F.col(f.key).isNotNull(), F.lit(f.weight)).otherwise(0.0) for f in FACTORS), F.lit(0.0))
    weighed = sum((F.coalesce(F.lit(f.weight) / F.nullif(present, F.lit(0.0)) * score[f.key], F.lit(0.0)) for f in FACTORS), F.lit(0.0))
    missing = F.array_compact(F.array(*(F.when(F.col(f.key).isNull(), F.lit(f.key)) for f in FACTORS)))
    value = F.when(F.size(missing) == len(FACTORS), F.raise_error(F.lit("no factors available")).cast("double")).otherwise(half_up(weighed, 2))
    entry = lambda f: F.struct(F.lit(f.key).alias("key"), F.struct(F.col(f.key).alias("raw"), score[f.key].alias("score")).alias("value"))
    factors = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f.key).isNotNull(), entry(f)) for f in FACTORS))))
    reason = F.when(F.size(missing) > 0, F.concat(F.size(missing).cast("string"), F.lit(" factor(s) unavailable: "), F.array_join(missing, ", ")))
    return inputs.select(*inputs.columns, *(score[f.key].alias(f"{f.key}_score") for f in FACTORS), value.alias("composite"), factors.alias("factors"), (F.size(missing) > 0).alias("is_partial"), reason.alias("partial_reason"), F.lit(METHODOLOGY_VERSION).alias("methodology_version"))


def contributions(readings: DataFrame) -> DataFrame:
    """One row a present factor: its score's share of the composite."""
    weights = F.create_map(*[x for f in FACTORS for x in (F.lit(f.key), F.lit(f.weight))])
    rows = readings.select("month_end", "factors", F.explode(F.map_entries("factors")).alias("e"))
    total = F.aggregate(F.map_keys("factors"), F.lit(0.0), lambda a, k: a + F.coalesce(weights[k], F.lit(0.0)))
    return rows.select("month_end", F.col("e.key").alias("factor"), F.col("e.value.raw").alias("raw"), F.col("e.value.score").alias("score"), (F.col("e.value.score") * weights[F.col("e.key")] / total).alias("contribution"))


def calibration_rows(readings: DataFrame) -> DataFrame:
    """Printable lines: raw value (three places) and score (whole) of each factor, rounded half up."""
    cell = lambda f: F.rpad(F.coalesce(F.format_string("%.3f(%.0f)", half_up(F.col(f.key), 3), half_up(F.col(f"{f.key}_score"), 0)), F.lit("-")), 16, " ")
    line = lambda f: F.when(F.col(f.key).isNull(), F.rpad(F.lit("-"), 16, " ")).otherwise(cell(f))
    return readings.select("month_end", F.concat_ws("  ", F.col("month_end").cast("string"), F.format_string("%6.2f", "composite"), F.when(F.col("is_partial"), "*").otherwise(" "), *(line(f) for f in FACTORS)).alias("line"))
