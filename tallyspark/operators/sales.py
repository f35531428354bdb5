"""Sales metrics: every answer is a lazy frame; money is exact until it is rounded for output."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.context import NO_FILTERS, BadArgument, Caveat, DateRange, Filters, Shop
from tallyspark.functions.numbers import money, ratio, share, total, units
from tallyspark.operators.scopes import bucket, calendar, orders_in, refunds_in, sold_lines, with_totals


def _sums(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(total("gross").alias("gross"), total("discount").alias("discounts"), total("quantity").alias("units"), F.countDistinct("order_id").alias("orders"))


def sales_summary(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS) -> DataFrame:
    """gross = sum of lines, refunds by the day of the refund, net = gross - discounts - refunds; average order value is before refunds."""
    lines = sold_lines(shop, period, filters)
    sold = lines.agg(total("gross").alias("gross"), total("discount").alias("discounts"), total("quantity").alias("units"), F.countDistinct("order_id").alias("orders"), total(F.when(F.col("variant_id").isNull(), F.col("gross") - F.col("discount"))).alias("custom"))
    back = refunds_in(shop, period, filters)[0].agg(total("amount").alias("refunds"))
    one = sold.join(back)  # a row each
    return one.select(
        money("gross").alias("gross_sales"), money("discounts").alias("discounts"), money("refunds").alias("refunds"), money(F.col("gross") - F.col("discounts") - F.col("refunds")).alias("net_sales"),
        units("units").alias("units_sold"), "orders", F.round(ratio(F.col("gross") - F.col("discounts"), F.col("orders")), 2).alias("average_order_value"), money("custom").alias("custom_amounts"),
    )


def custom_amount_caveat(custom: float, net: float) -> Caveat | None:
    """Amounts rung up without a product, from 1 % of net sales on."""
    if custom and net and custom / net >= 0.01:
        return Caveat("custom_amounts", f"{custom / net:.1%} of sales were rung up without a product")
    return None


def coverage_caveats(window: tuple[dt.date | None, dt.date | None], period: DateRange) -> list[Caveat]:
    """What of a period lies outside the data."""
    first, last = window
    if first is None or last is None:
        return [Caveat("no_data", "there are no sales yet")]
    out = []
    if period.end < first or period.start > last:
        out.append(Caveat("outside_data", f"sales run from {first} to {last}"))
        return out
    if period.start < first:
        out.append(Caveat("starts_before_data", f"sales start on {first}"))
    if period.end > last:
        out.append(Caveat("ends_after_data", f"the last sale is of {last}"))
    return out


def sales_series(shop: Shop, period: DateRange, grain: str, filters: Filters = NO_FILTERS) -> DataFrame:
    """Each bucket of the period once, with zeros where nothing was sold."""
    sold = _sums(sold_lines(shop, period, filters).withColumn("bucket", bucket(shop, F.col("placed_at"), grain)), "bucket")
    back = refunds_in(shop, period, filters)[0].groupBy(bucket(shop, F.col("occurred_at"), grain).alias("bucket")).agg(total("amount").alias("refunds"))
    out = calendar(shop, period, grain).join(sold, "bucket", "left").join(back, "bucket", "left").fillna(0)
    return out.select("bucket", money("gross").alias("gross_sales"), money("discounts").alias("discounts"), money("refunds").alias("refunds"), money(F.col("gross") - F.col("discounts") - F.col("refunds")).alias("net_sales"), units("units").alias("units_sold"), "orders")


#: Columns of sold lines by dimension; the last three carry refunds, too.
DIMENSION_COLUMNS = {"product": "product_id", "variant": "variant_id", "category": "category_id", "channel": "channel", "location": "location_id", "source": "source"}


def breakdown(shop: Shop, period: DateRange, dimension: str, filters: Filters = NO_FILTERS, limit: int = 10, worst: bool = False, totals: bool = False) -> DataFrame:
    """The keys that sell most (or least) before refunds, with their share of net sales over all keys.

    Refunds name an order, not a product: they are subtracted by channel, location and source only. Ties go to the
    smaller key. totals: with total_rows before the limit, and whether the list is truncated.
    """
    if dimension not in DIMENSION_COLUMNS:
        raise BadArgument(f"{dimension!r} is no dimension; choose one of {', '.join(DIMENSION_COLUMNS)}")
    if dimension == "location":
        shop.require("multi_location")
    column = DIMENSION_COLUMNS[dimension]
    product = dimension in ("product", "variant")
    lines = sold_lines(shop, period, filters, require_product=product).withColumn("key", F.col(column).cast("string"))
    sold = _sums(lines, "key").withColumn("refunds", F.lit(0).cast("decimal(24,4)"))
    if dimension in ("channel", "location", "source"):
        back = refunds_in(shop, period, filters)[0].groupBy(F.col(column).cast("string").alias("key")).agg(total("amount").alias("back"))
        sold = sold.join(back, sold["key"].eqNullSafe(back["key"]), "left").drop(back["key"]).withColumn("refunds", F.coalesce("back", "refunds"))
    sold = sold.withColumn("before", F.col("gross") - F.col("discounts")).withColumn("net", F.col("before") - F.col("refunds"))
    whole = sold.agg(total("net").alias("whole"))
    order = F.col("before").asc() if worst else F.col("before").desc()
    top = sold.orderBy(order, F.col("key").asc_nulls_last()).limit(limit).join(whole)
    out = top.select("key", money("gross").alias("gross_sales"), money("discounts").alias("discounts"), money("refunds").alias("refunds"), money("net").alias("net_sales"), units("units").alias("units_sold"), "orders", share(F.col("net"), F.col("whole")).alias("share"))
    return with_totals(out, sold, limit) if totals else out


#: What a channel is called.
CHANNEL_NAMES = {"in_store": "In store", "online": "Online", "event": "Events and pop-ups", "other": "Other"}


def labelled(rows: DataFrame, shop: Shop, dimension: str) -> DataFrame:
    """Rows of breakdown() with `label`, what people call the key; names are looked up for these few keys alone.

    A variant is its product's name and its own, unless it has none of its own; a register is what the shop calls it.
    """
    if dimension not in DIMENSION_COLUMNS:
        raise BadArgument(f"{dimension!r} is no dimension; choose one of {', '.join(DIMENSION_COLUMNS)}")
    key = F.col("key")
    if dimension == "product":
        return rows.withColumn("label", key)
    if dimension == "category":
        return rows.withColumn("label", F.coalesce(key, F.lit("Uncategorised")))
    if dimension in ("channel", "source"):
        names = CHANNEL_NAMES if dimension == "channel" else shop.source_names
        named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key] if names else F.lit(None)
        return rows.withColumn("label", F.coalesce(named, F.lit("Other") if dimension == "channel" else key))
    if dimension == "location":
        names = shop.locations.groupBy(F.col("location_id").cast("string").alias("key")).agg(F.min("name").alias("label"))
        return rows.join(names, "key", "left").fillna("Unknown location", ["label"]).select(*rows.columns, "label")
    own = F.when(F.col("name").isNull() | (F.col("name") == F.col("product_id")), F.col("product_id")).otherwise(F.concat_ws(" \u2014 ", "product_id", "name"))
    names = shop.variants.groupBy(F.col("variant_id").cast("string").alias("key")).agg(F.min(own).alias("label"))
    return rows.join(names, "key", "left").select(*rows.columns, "label")


def with_previous(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS, **others: DateRange) -> DataFrame:
    """The summary of a period beside that of the one before it, and of others."""
    periods = {"current": period, "previous": period.previous()} | others
    parts = [sales_summary(shop, p, filters).withColumn("period", F.lit(name)) for name, p in periods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def digest_comparison(shop: Shop, as_of: dt.date) -> DataFrame:
    """The last full Monday-to-Sunday week, the week before and the same week a year (364 days) earlier."""
    sunday = as_of - dt.timedelta(days=as_of.isoweekday() % 7 or 7)
    week = DateRange.last(7, sunday)
    year = DateRange(week.start - dt.timedelta(days=364), week.end - dt.timedelta(days=364))
    return with_previous(shop, week, year_before=year)


def data_window(shop: Shop) -> DataFrame:
    """Local days of the first and the last sale."""
    found = orders_in(shop, None).agg(F.min("placed_at").alias("first"), F.max("placed_at").alias("last"))
    return found.select(shop.local_day(F.col("first")).alias("first_day"), shop.local_day(F.col("last")).alias("last_day"))


def margin_report(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS) -> DataFrame:
    """Profit over sales of lines that carry a cost; a line without one is uncovered, not free."""
    shop.require("has_costs")
    net, covered = F.col("gross") - F.col("discount"), F.col("unit_cost").isNotNull()
    sums = sold_lines(shop, period, filters).agg(total(net).alias("net"), total(F.when(covered, net)).alias("covered"), total(F.when(covered, (F.col("quantity") * F.col("unit_cost")).cast("decimal(24,8)"))).alias("cogs"))
    return sums.select(money("net").alias("net_sales"), money("covered").alias("covered_sales"), money("cogs").alias("cogs"), money(F.col("covered") - F.col("cogs")).alias("gross_profit"), share(F.col("covered") - F.col("cogs"), F.col("covered")).alias("margin"), share(F.col("covered"), F.col("net")).alias("cost_coverage"))


def customer_stats(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS) -> DataFrame:
    """Buyers of the period; a returning one has any earlier order that counts, whatever the filters."""
    shop.require("has_customers")
    orders = orders_in(shop, period, filters)
    buyers = orders.filter("customer_id is not null").groupBy("customer_id").agg(F.min("placed_at").alias("first_here"))
    returning = returning_customers(shop, period, filters)
    counts = orders.agg(F.count("*").alias("orders"), F.count("customer_id").alias("identified"))
    sums = buyers.agg(F.count("*").alias("buyers")).join(returning.agg(F.count("*").alias("returning"))).join(counts)
    return sums.select("buyers", "returning", (F.col("buyers") - F.col("returning")).alias("new"), share(F.col("returning"), F.col("buyers")).alias("repeat_rate"), share(F.col("identified"), F.col("orders")).alias("identified_share"))


def returning_customers(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS) -> DataFrame:
    start = F.lit(period.bounds(shop.timezone)[0].replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
    earlier = shop.orders.filter("status <> 'canceled'").filter(F.col("placed_at") < start).select("customer_id")
    return orders_in(shop, period, filters).filter("customer_id is not null").select("customer_id").distinct().join(earlier, "customer_id", "left_semi")


def variant_sales(shop: Shop, period: DateRange) -> DataFrame:
    sums = _sums(sold_lines(shop, period, require_product=True), "variant_id")
    return sums.select("variant_id", units("units").alias("units_sold"), money(F.col("gross") - F.col("discounts")).alias("net_sales"), "orders")
