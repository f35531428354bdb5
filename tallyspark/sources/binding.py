"""The canonical model as projections of a star schema of orders, lines, parts, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.context import Shop
from tallyspark.functions.numbers import exact

ZONE = "America/New_York"
STOCK_LOCATIONS = (0, 1, 2)


def _map(column: str, pairs: dict[str, str], default: str):
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def shop(spark: SparkSession, sf_dir: str, timezone: str = ZONE) -> Shop:
    """Zone-less timestamps of the files are read as UTC instants.

    Sides of left joins have distinct keys by construction, so that a metric that reads none of their columns loses the join.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, part = t("customer"), t("part")
    one = lambda df, key, column: df.groupBy(key).agg(F.min(column).alias(column))
    at = lambda c: F.col(c).cast("timestamp")
    orders = t("orders").join(one(customer, "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), at("o_orderdate").alias("placed_at"), _map("o_orderstatus", {"O": "open", "F": "completed", "P": "canceled"}, "canceled").alias("status"),
        F.col("c_nationkey").alias("location_id"), _map("o_orderpriority", {"1-URGENT": "in_store", "2-HIGH": "online", "3-MEDIUM": "event"}, "other").alias("channel"), F.concat(F.lit("reg"), (F.col("o_orderkey") % 2).cast("string")).alias("source"), exact("o_totalprice").alias("total"),
    )
    lineitem = t("lineitem")
    variants = part.select(F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("name"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"), F.lpad((F.col("p_partkey") * 7 + 40_000_000).cast("string"), 12, "0").alias("barcode"), F.col("p_brand").alias("product_id"), F.col("p_type").alias("category_id"), exact("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 10 != 0, exact(0.6 * F.col("p_retailprice"))).alias("cost"))
    lines = lineitem.join(one(part, "p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("l_orderkey").alias("order_id"), F.when(F.col("l_suppkey") % 25 != 0, F.col("l_partkey")).alias("variant_id"), exact("l_quantity").alias("quantity"), exact("l_extendedprice").alias("gross"), exact(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        F.when(F.col("l_partkey") % 10 != 0, exact(0.6 * F.col("p_retailprice"))).alias("unit_cost"), exact(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax")).alias("tax"),
    )
    refunds = lineitem.filter("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_orderkey").alias("order_id"), exact(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), at("l_shipdate").alias("occurred_at"))
    levels = part.select(F.col("p_partkey").alias("variant_id"), F.explode(F.array(*map(F.lit, STOCK_LOCATIONS))).alias("location_id")).withColumn("on_hand", exact((F.col("variant_id") * 37 + F.col("location_id") * 11) % 53 - 2))
    movements = t("events").select(
        F.col("user_id").alias("variant_id"), (F.col("user_id") % 3).cast("int").alias("location_id"), _map("event_type", {"purchase": "sold", "signup": "received", "click": "returned", "error": "damaged"}, "adjusted").alias("kind"), exact(F.floor(F.col("value") / 50) + 1).alias("quantity"), at("ts").alias("occurred_at"), "event_id",
    )
    supply = lineitem.select(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("vendor_id")).distinct()
    least = supply.groupBy("variant_id").agg(F.min("vendor_id").alias("first_vendor"))
    terms = supply.join(least, "variant_id").select("variant_id", "vendor_id", (F.col("vendor_id") == F.col("first_vendor")).alias("is_primary"), (7 + F.col("vendor_id") % 21).cast("int").alias("lead_time_days"), exact(1 + F.col("vendor_id") % 6).alias("pack_size"), exact(F.col("vendor_id") % 4 * 5).alias("min_order_qty"), (F.col("vendor_id") % 7 == 0).alias("takes_returns"))
    payments = orders.select("order_id", "source", F.col("total").alias("amount"), F.when(F.col("customer_id") % 3 == 0, "card").when(F.col("customer_id") % 3 == 1, "cash").otherwise("other").alias("tender"), exact(F.col("order_id") % 5).alias("tip"), F.col("placed_at").alias("occurred_at"), "location_id")
    nation, region = t("nation"), t("region")
    tree = region.select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")).unionByName(nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name")))
    customers = customer.select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("c"), (F.col("c_custkey") % 1000).cast("string"), F.lit("@mail.test")).alias("email"), F.concat(F.lit("555-"), (F.col("c_custkey") % 700).cast("string")).alias("phone"), F.col("c_name").alias("name"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") * 7 % 900).cast("int")).alias("created_on"))
    return Shop(
        frames={"orders": orders, "lines": lines, "refunds": refunds, "variants": variants, "levels": levels, "movements": movements, "terms": terms, "payments": payments, "tree": tree, "customers": customers, "locations": nation.select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("name")), "vendors": t("supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("name"))},
        timezone=timezone, payment_sources=("reg0", "reg1"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
