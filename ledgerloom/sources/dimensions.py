"""Static dimensions: products, their tokens, networks, known addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCT_SCHEMA = "slug string, decimals int, nav_usd double, active boolean, tokens array<struct<network_id:int,network_slug:string,address:string,behaviorally_observable:boolean,decimals:int>>"

#: Fixed: networks whose address encodings tell case apart.
CASE_SENSITIVE_NETWORKS = (2, 9, 46)

#: Fixed: words that mark a name tag as a custodian's.
CUSTODIAN_WORDS = (
    "coinbase", "binance", "exchange", "custodian", "custody",
    "gnosis safe", "multisig", "vault", "treasury", "kraken",
    "gemini", "bitfinex", "okx", "bybit", "huobi",
)

#: Fixed: well-known addresses.
KNOWN_ADDRESSES = {
    "0x0000000000000000000000000000000000000000": "Null Address",
    "0x000000000000000000000000000000000000dead": "Dead Address (Burn)",
    "0x71660c4005ba85c37ccec55d0c4493e66fe775d3": "Coinbase",
    "0x503828976d22510aad0201ac7ec88293211d23da": "Coinbase 2",
    "0x3cd751e6b0078be393132286c442345e5dc49699": "Coinbase 4",
    "0x28c6c06298d514db089934071355e5743bf21d60": "Binance Hot Wallet",
    "0xbe0eb53f46cd790cd13851d5eff43d12404d33e8": "Binance Cold Wallet",
    "0x21a31ee1afc51d94c2efccaa2092ad1028285549": "Binance: Hot Wallet 2",
    "0xf977814e90da44bfa03b6295a0616a897441acec": "Binance: Hot Wallet 8",
}

#: The derived ledger's products. NAVs are stated, never defaulted.
NAVS = {"p0": 1.00, "p1": 115.96, "p2": 1.1403, "p3": 11.13, "p4": 1.1318}
DECIMALS = {"p0": 6, "p1": 18, "p2": 18, "p3": 6, "p4": 6}


def products(spark: SparkSession) -> DataFrame:
    """(product, cfg_pos, decimals, nav_usd, active): five rows."""
    rows = [(slug, i, DECIMALS[slug], nav, None) for i, (slug, nav) in enumerate(NAVS.items())]
    return active(spark.createDataFrame(rows, "product string, cfg_pos int, decimals int, nav_usd double, active boolean"))


PRODUCTS_SQL = "products AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, {DECIMALS[p]}, {nav}::DOUBLE)" for i, (p, nav) in enumerate(NAVS.items())) + ") AS t(product, cfg_pos, decimals, nav_usd))"


def active(df: DataFrame) -> DataFrame:
    """Products not switched off; one of them without a NAV raises."""
    checked = F.when(F.col("nav_usd").isNull(), F.raise_error(F.lit("a product without nav_usd")).cast("double")).otherwise(F.col("nav_usd"))
    return df.where(F.coalesce("active", F.lit(True))).withColumn("nav_usd", checked)


def observable_networks(df: DataFrame) -> DataFrame:
    """(slug, network_id, network_slug, addresses, decimals) of networks to replay; conflicting decimals raise."""
    t = df.select("slug", F.col("decimals").alias("own"), F.explode("tokens").alias("t")).where("t.behaviorally_observable")
    by = t.groupBy("slug", "t.network_id", "t.network_slug").agg(F.sort_array(F.collect_list(F.lower("t.address"))).alias("addresses"), F.collect_set(F.coalesce("t.decimals", "own")).alias("d"))
    one = F.when(F.size("d") > 1, F.raise_error(F.concat(F.lit("conflicting decimals on "), "network_slug")).cast("int")).otherwise(F.col("d")[0])
    return by.select("slug", "network_id", "network_slug", "addresses", one.alias("decimals"))


def is_case_sensitive(network_id: Column) -> Column:
    return network_id.isin(*CASE_SENSITIVE_NETWORKS)


def is_custodian(tag: Column) -> Column:
    return F.coalesce(F.lower(tag).rlike("|".join(CUSTODIAN_WORDS)), F.lit(False))


def known_addresses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_ADDRESSES.items()), "address string, tag string")


def name_tags(addresses: DataFrame, known: DataFrame, contracts: DataFrame) -> DataFrame:
    """(address, name_tag, tag_source): a known address's tag, else its contract name, else null."""
    a = addresses.select(F.lower("address").alias("address")).distinct()
    k = known.select(F.lower("address").alias("address"), "tag").dropDuplicates(["address"])
    c = contracts.select(F.lower("address").alias("address"), "contract_name").where("contract_name <> ''").dropDuplicates(["address"])
    both = a.join(k, "address", "left").join(c, "address", "left")
    return both.select("address", F.coalesce("tag", "contract_name").alias("name_tag"), F.when(F.col("tag").isNotNull(), "known").when(F.col("contract_name").isNotNull(), "contract").alias("tag_source"))
