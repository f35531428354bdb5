"""Scopes: which rows a metric is about. Filters on instants stay on bare columns, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.context import NO_FILTERS, Caveat, DateRange, Filters, Shop
from tallyspark.session import written


def _in(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.filter(F.col(column).isin(*values)) if values else df


def orders_in(shop: Shop, period: DateRange | None, filters: Filters = NO_FILTERS) -> DataFrame:
    """Orders that count as sales: open ones do, cancelled ones don't. A merchandise filter keeps orders with such a line."""
    out = shop.orders.filter("status <> 'canceled'")
    if period:
        out = out.filter(period.inside(F.col("placed_at"), shop.timezone))
    for column, values in (("location_id", filters.location_ids), ("channel", filters.channels), ("source", filters.sources)):
        out = _in(out, column, values)
    if filters.merchandise:
        out = out.join(_merchandise(shop, shop.lines.join(shop.variants, "variant_id"), filters), "order_id", "left_semi")
    return out


def _merchandise(shop: Shop, df: DataFrame, filters: Filters) -> DataFrame:
    for column, values in (("category_id", filters.category_ids), ("product_id", filters.product_ids), ("variant_id", filters.variant_ids)):
        df = _in(df, column, values)
    return df


def sold_lines(shop: Shop, period: DateRange | None, filters: Filters = NO_FILTERS, require_product: bool = False) -> DataFrame:
    """Lines of such orders with their variant, if it is known; deleted variants and custom amounts stay unless a product is asked for."""
    orders = orders_in(shop, period, Filters(filters.location_ids, filters.channels, (), (), (), filters.sources))
    kept = [F.min(c).alias(n) for c, n in (("product_id", "product_id"), ("category_id", "category_id"), ("price", "price"), ("name", "variant_name"))]
    variants = shop.variants.groupBy("variant_id").agg(*kept)  # keys are distinct by construction, so the join goes where no column of it is read
    out = shop.lines.join(orders, "order_id").join(variants, "variant_id", "left")
    if require_product or filters.merchandise:
        out = out.filter("variant_id is not null")
    return _merchandise(shop, out, filters)


def refunds_in(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS) -> tuple[DataFrame, list[Caveat]]:
    """Refunds by the day of the refund, of cancelled orders too. A refund names no product, so a merchandise filter leaves none."""
    out = shop.refunds.filter(period.inside(F.col("occurred_at"), shop.timezone)).join(shop.orders.select("order_id", "location_id", "channel", "source"), "order_id")
    for column, values in (("location_id", filters.location_ids), ("channel", filters.channels), ("source", filters.sources)):
        out = _in(out, column, values)
    if filters.merchandise:
        return out.filter(F.lit(False)), [Caveat("refunds_not_by_product", "refunds can't be attributed to products and are left out")]
    return out, []


def stock(shop: Shop, filters: Filters = NO_FILTERS) -> tuple[DataFrame, list[Caveat]]:
    """Shelves with their variants; stock has no channel."""
    out = _merchandise(shop, _in(shop.levels, "location_id", filters.location_ids).join(shop.variants, "variant_id"), filters)
    return out, [Caveat("stock_has_no_channel", "the channel filter does not apply to stock")] if filters.channels else []


def descendants(tree: DataFrame, roots: list[str]) -> DataFrame:
    """Ids of the roots and of all nodes below them, at any depth: level by level until no new id appears, as it does in a cycle."""
    found = level = written(tree.filter(F.col("id").isin(*roots)).select("id").distinct(), "level")
    while not level.isEmpty():
        below = tree.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        level = written(below.join(found, "id", "left_anti"), "level")
        found = found.unionByName(level)
    return found


def bucket(shop: Shop, column: Column, grain: str) -> Column:
    """The first local day of the day, Monday week or month."""
    return F.to_date(F.date_trunc(grain, F.from_utc_timestamp(column, shop.timezone)))


def calendar(shop: Shop, period: DateRange, grain: str) -> DataFrame:
    spark = shop.orders.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(period.start), F.lit(period.end))).alias("day"))
    return days.select(F.to_date(F.date_trunc(grain, "day")).alias("bucket")).distinct()


def with_totals(page: DataFrame, rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page with total_rows, how many rows there are before it is cut, and truncated, whether more follow it."""
    count = rows.agg(F.count("*").alias("total_rows"))
    return page.join(count).withColumn("truncated", F.col("total_rows") > offset + limit)
