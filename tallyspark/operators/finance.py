"""Month-end money: tax, tips, tenders, reconciliation, and the packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Shop
from tallyspark.functions.numbers import money, total
from tallyspark.operators import inventory, sales
from tallyspark.operators.scopes import sold_lines

NET_TOLERANCE, TAKINGS_TOLERANCE = 0.01, 5.0


def _payments(shop: Shop, period: DateRange) -> DataFrame:
    """Payments of orders that count, of the sources that report them; amounts are without tips."""
    shop.require("has_payments")
    rows = shop.payments.filter(period.inside(F.col("occurred_at"), shop.timezone)).filter(F.col("source").isin(*shop.payment_sources))
    return rows.join(shop.orders.filter("status <> 'canceled'").select("order_id"), "order_id", "left_semi")


def financial_summary(shop: Shop, period: DateRange) -> DataFrame:
    tax = sold_lines(shop, period).agg(total("tax").alias("tax"))
    paid = _payments(shop, period).agg(total("amount").alias("amount"), total("tip").alias("tips"), F.count("*").alias("payments"))
    return tax.join(paid).select(money("tax").alias("tax"), money("tips").alias("tips"), money("amount").alias("payments_amount"), "payments")


def tender_split(shop: Shop, period: DateRange) -> DataFrame:
    return _payments(shop, period).groupBy("tender").agg(money(total("amount")).alias("amount"), money(total("tip")).alias("tips"), F.count("*").alias("payments"))


def reconciliation_net(shop: Shop, period: DateRange) -> DataFrame:
    """net = gross - discounts - refunds, to a cent."""
    s = sales.sales_summary(shop, period)
    gap = F.round(F.col("gross_sales") - F.col("discounts") - F.col("refunds") - F.col("net_sales"), 2)
    return s.select(gap.alias("gap"), (F.abs(gap) <= NET_TOLERANCE).alias("ok"))


def reconciliation_takings(shop: Shop, period: DateRange) -> DataFrame:
    """Payments and tips against net of discounts plus tax and tips, to the tolerance."""
    lines = sold_lines(shop, period).agg(total(F.col("gross") - F.col("discount")).alias("net"), total("tax").alias("tax"))
    paid = _payments(shop, period).agg(total("amount").alias("amount"), total("tip").alias("tips"))
    gap = F.col("amount") + F.col("tips") - (F.col("net") + F.col("tax") + F.col("tips"))
    return lines.join(paid).select(money(F.col("amount") + F.col("tips")).alias("taken"), money(F.col("net") + F.col("tax") + F.col("tips")).alias("expected"), money(gap).alias("gap"), (F.abs(gap) <= TAKINGS_TOLERANCE).alias("ok"))


def month_end_packet(shop: Shop, period: DateRange) -> DataFrame:
    """(section, item, value) of the month: sales, money, margin, stock and the items that sold least."""

    def rows(section: str, df: DataFrame) -> DataFrame:
        names = [c for c, t in df.dtypes if t != "boolean"]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in names])).alias("p")
        return df.select(pairs).select(F.lit(section).alias("section"), "p.*")

    worst = sales.breakdown(shop, period, "product", limit=10, worst=True)
    parts = [rows("sales", sales.sales_summary(shop, period)), rows("money", financial_summary(shop, period)), rows("margin", sales.margin_report(shop, period)), rows("stock", inventory.inventory_snapshot(shop)), worst.select(F.lit("worst").alias("section"), F.col("key").alias("item"), F.col("net_sales").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store_packet(packet: DataFrame, period: DateRange, path: str) -> None:
    """One partition a period: storing a month again replaces that month only."""
    packet.withColumn("period_start", F.lit(period.start)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_start").parquet(path)


def write_month_end(packet: DataFrame, period: DateRange, path: str) -> None:
    """The packet as a workbook, a tab a section."""
    from tallyspark.sources.files import write_workbook

    sections = sorted(r.section for r in packet.select("section").distinct().collect())  # five
    note = f"{period.start} to {period.end}, days of the shop's own time zone"
    write_workbook({s: packet.filter(F.col("section") == s).select("item", "value") for s in sections}, path, f"Month end {period.start:%Y-%m}", dict.fromkeys(sections, note))
