"""Demand: what sells how fast on which shelf, and what to order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Shop
from tallyspark.functions.numbers import total, units
from tallyspark.operators.inventory import signed
from tallyspark.operators.scopes import sold_lines, stock

#: Weights of the last four weeks, days between orders, lead time where none is known, bounds of the seasonal
#: factor, weekly units of a steady seller, weeks of safety stock of a slow one, and words of categories never reordered.
WEIGHTS = (4, 3, 2, 1)
REVIEW_DAYS, DEFAULT_LEAD = 7, 14
SEASON_LOW, SEASON_HIGH = 0.5, 2.5
STEADY, SLOW_SAFETY = 3, 0.33
SKIP_CATEGORIES = ("singles", "single", "consignment", "trade-in", "used")
WINDOW_DAYS, URGENT = 28, 250
SHELF = ["variant_id", "location_id"]


def _weeks(shop: Shop, as_of: dt.date) -> tuple[DateRange, list[Column]]:
    period = DateRange.last(WINDOW_DAYS, as_of)
    end = F.lit(period.bounds(shop.timezone)[1].replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
    week = F.floor((F.unix_micros(end) - F.unix_micros("placed_at")) / 604_800_000_000)
    inside = period.inside(F.col("placed_at"), shop.timezone)
    return period, [units(total(F.when(inside & (week == i), F.col("quantity")))).alias(f"w{i}") for i in range(4)]


def weekly_units(shop: Shop, as_of: dt.date) -> DataFrame:
    """Units of each shelf in fixed weeks of 604,800 seconds back from the window's end; w0 is the newest."""
    period, weeks = _weeks(shop, as_of)
    return sold_lines(shop, period, require_product=True).groupBy(*SHELF).agg(*weeks)


def primary_terms(shop: Shop) -> DataFrame:
    """One vendor a variant: the primary one, then the shortest lead time, then the smallest id."""
    w = Window.partitionBy("variant_id").orderBy(F.desc("is_primary"), "lead_time_days", "vendor_id")
    return shop.terms.withColumn("n", F.row_number().over(w)).filter("n = 1").select("variant_id", "vendor_id", "lead_time_days", units("pack_size").alias("pack_size"), units("min_order_qty").alias("min_order_qty"))


def stockout_days(shop: Shop, as_of: dt.date, days: int = WINDOW_DAYS) -> DataFrame:
    """Days on which a move left a shelf empty, rewinding today's count from the newest move.

    A move without a sign ends the rewinding: what was on the shelf before it is unknown. Days without moves don't count.
    """
    period = DateRange.last(days, as_of)
    moves = shop.movements.filter(period.inside(F.col("occurred_at"), shop.timezone)).withColumn("sign", signed())
    newer = Window.partitionBy(*SHELF).orderBy(F.desc("occurred_at"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("since", F.coalesce(F.sum(F.col("quantity") * F.col("sign")).over(newer), F.lit(0))).withColumn("unclear", F.coalesce(F.max((F.col("sign") == 0).cast("int")).over(newer), F.lit(0)))
    left = moves.filter("unclear = 0").join(shop.levels, SHELF).withColumn("left", F.col("on_hand") - F.col("since"))
    empty = left.filter("left <= 0").groupBy(*SHELF).agg(F.countDistinct(shop.local_day(F.col("occurred_at"))).alias("n"))
    return empty.select(*SHELF, F.least(F.col("n"), F.lit(days - 1)).alias("stockout_days"))


def _years(shop: Shop, as_of: dt.date) -> tuple[DateRange, list[Column]]:
    window = DateRange.last(WINDOW_DAYS, as_of - dt.timedelta(days=364))
    year = DateRange.last(365, as_of)
    inside = lambda p: F.when(p.inside(F.col("placed_at"), shop.timezone), F.col("quantity"))
    return DateRange(window.start, as_of), [units(total(inside(window))).alias("last_year"), units(total(inside(year))).alias("trailing_year")]


def year_units(shop: Shop, as_of: dt.date) -> DataFrame:
    """Units of each shelf in the same window a year (364 days) ago and in the year before as_of."""
    period, sums = _years(shop, as_of)
    return sold_lines(shop, period, require_product=True).groupBy(*SHELF).agg(*sums)


def _recent_and_year(shop: Shop, as_of: dt.date) -> DataFrame:
    """weekly_units() and year_units() of one scan: the weeks lie within the year."""
    period, sums = _years(shop, as_of)
    return sold_lines(shop, period, require_product=True).groupBy(*SHELF).agg(*_weeks(shop, as_of)[1], *sums)


def velocity(weeks: list[Column], stockout: Column, window: int = WINDOW_DAYS) -> Column:
    """Units a day: recent weeks weigh more, and days with an empty shelf are left out of the window."""
    weighted = sum((w * k for w, k in zip(weeks, WEIGHTS, strict=True)), F.lit(0.0)) / sum(WEIGHTS) / 7
    return F.bround(weighted * (window / F.greatest(window - stockout, F.lit(1)).cast("double")), 3)


def seasonal(last_year: Column, trailing: Column) -> Column:
    """How much busier the time of year is than an average month; 1 without a year of sales."""
    factor = last_year / (trailing * WINDOW_DAYS / 365)
    return F.when((trailing > 0) & (last_year > 0), F.bround(F.least(F.greatest(factor, F.lit(SEASON_LOW)), F.lit(SEASON_HIGH)), 2)).otherwise(1.0)


def rounded_to_pack(quantity: Column, pack: Column, least: Column) -> Column:
    """Whole packs, and no fewer than the vendor accepts."""
    pack = F.when(pack > 0, pack).otherwise(1.0)
    packs = F.ceil(F.greatest(quantity, F.lit(0.0)) / pack) * pack
    return F.when(quantity <= 0, 0.0).when(packs < least, F.ceil(least / pack) * pack).otherwise(packs).cast("double")


def demand_inputs(shop: Shop, as_of: dt.date, movements_as_of: dt.date | None = None) -> DataFrame:
    """A row a shelf with all that the forecast needs; sums come before the joins."""
    shelves = stock(shop)[0].select(*SHELF, "sku", "category_id", units("price").alias("price"), units("cost").alias("cost"), units("on_hand").alias("on_hand"))
    out = shelves.join(_recent_and_year(shop, as_of), SHELF, "left").join(stockout_days(shop, movements_as_of or as_of), SHELF, "left").join(primary_terms(shop), "variant_id", "left")
    return out.fillna(0.0, ["w0", "w1", "w2", "w3", "last_year", "trailing_year"]).fillna(0, ["stockout_days"])


def skip_reason(category: Column, sold: Column, active: Column | None = None) -> Column:
    one_off = F.lit(False)
    for word in SKIP_CATEGORIES:
        one_off = one_off | F.lower(F.coalesce(category, F.lit(""))).contains(word)
    out = F.when(one_off, "one-off inventory").when(sold <= 0, "no sales in the window")
    return F.when(~active, "discontinued").otherwise(out) if active is not None else out


def reorder(shop: Shop, as_of: dt.date, on_order: DataFrame | None = None, movements_as_of: dt.date | None = None) -> DataFrame:
    """What to order for each shelf: demand over lead time and review, safety stock, less what is there or on its way (of the variant, on any shelf)."""
    rows = demand_inputs(shop, as_of, movements_as_of)
    rows = rows.join(on_order, "variant_id", "left").fillna(0.0, ["on_order"]) if on_order is not None else rows.withColumn("on_order", F.lit(0.0))
    weeks = [F.col(f"w{i}") for i in range(4)]
    rows = rows.filter(skip_reason(F.col("category_id"), sum(weeks[1:], weeks[0])).isNull()).withColumn("velocity", velocity(weeks, F.col("stockout_days"))).filter("velocity > 0")
    rows = rows.withColumn("season", seasonal(F.col("last_year"), F.col("trailing_year"))).withColumn("lead", F.coalesce("lead_time_days", F.lit(DEFAULT_LEAD)))
    rate = F.col("velocity") * F.col("season")
    safety_weeks = F.when(F.col("velocity") * 7 >= STEADY, 1.0).otherwise(SLOW_SAFETY)
    rows = rows.withColumn("demand", F.bround(rate * (F.col("lead") + REVIEW_DAYS), 3)).withColumn("safety", F.bround(rate * 7 * safety_weeks, 3))
    rows = rows.withColumn("raw_qty", F.bround(F.col("demand") + F.col("safety") - F.col("on_hand") - F.col("on_order"), 3))
    rows = rows.withColumn("suggested_qty", rounded_to_pack(F.col("raw_qty"), F.coalesce("pack_size", F.lit(1.0)), F.coalesce("min_order_qty", F.lit(0.0)))).filter("suggested_qty > 0")
    rows = rows.withColumn("cover", F.when(F.col("on_hand") > 0, F.bround(F.col("on_hand") / F.col("velocity"), 1)))
    return rows.withColumn("stocks_out", F.coalesce(F.col("cover") < F.col("lead"), F.lit(False)))


def suggestions(shop: Shop, as_of: dt.date, limit: int = 200, on_order: DataFrame | None = None) -> DataFrame:
    rows = reorder(shop, as_of, on_order)
    return rows.orderBy(F.desc("stocks_out"), F.coalesce("cover", F.lit(-1.0)), *SHELF).limit(limit).select(*SHELF, "velocity", "season", "lead", "demand", "safety", "raw_qty", "suggested_qty", "cover", "stocks_out", "vendor_id")


def vendor_groups(shop: Shop, as_of: dt.date) -> DataFrame:
    """Suggestions by vendor; those without one have a null vendor."""
    rows = reorder(shop, as_of)
    return rows.groupBy("vendor_id").agg(F.count("*").alias("lines"), F.round(F.sum("suggested_qty"), 2).alias("units"), F.round(F.sum(F.col("suggested_qty") * F.col("cost")), 2).alias("cost"))


def _missed(shop: Shop, as_of: dt.date) -> DataFrame:
    """Shelves that are empty before a delivery, with the units missed between; an already empty shelf has no cover and is not counted."""
    rows = reorder(shop, as_of).filter("cover is not null and stocks_out").withColumn("short", F.col("lead") - F.col("cover")).filter("short > 0")
    return rows.withColumn("missed", F.bround(F.col("velocity") * F.col("short"), 2))


def shortfall_impact(shop: Shop, as_of: dt.date) -> DataFrame:
    """(lines, impact): one row, of margin lost if at least half of the lines have a cost, of sales otherwise; none without a line."""
    sales = F.coalesce(F.col("missed") * F.col("price"), F.lit(0.0))
    margin = F.col("missed") * (F.col("price") - F.col("cost"))
    sums = _missed(shop, as_of).agg(F.count("*").alias("lines"), F.count(margin).alias("costed"), F.sum(F.coalesce(margin, sales)).alias("margin"), F.sum(sales).alias("sales")).filter("lines > 0")
    return sums.select("lines", F.round(F.when(F.col("costed") * 2 >= F.col("lines"), F.col("margin")).otherwise(F.col("sales")), 2).alias("impact"))


def shortfall(shop: Shop, as_of: dt.date) -> DataFrame:
    """What running out costs between the empty shelf and the delivery; an already empty shelf has no cover and is not counted."""
    rows = _missed(shop, as_of)
    sums = rows.agg(F.count("*").alias("lines"), F.round(F.sum("missed"), 2).alias("units_missed"), F.round(F.sum(F.col("missed") * F.col("price")), 2).alias("lost_sales"), F.round(F.sum(F.col("missed") * (F.col("price") - F.col("cost"))), 2).alias("lost_margin"))
    return sums.withColumn("severity", F.when(F.coalesce("lost_sales", F.lit(0.0)) >= URGENT, "urgent").otherwise("warn"))


def outstanding(purchase_lines: DataFrame) -> DataFrame:
    """Quantities on draft and sent orders that have not arrived, by variant."""
    return purchase_lines.filter(F.col("status").isin("draft", "sent")).groupBy("variant_id").agg(F.sum(F.col("quantity") - F.col("received")).cast("double").alias("on_order"))


def purchase_orders(purchase_lines: DataFrame, vendors: DataFrame, canceled: bool = False) -> DataFrame:
    """Orders by reference with vendor, units, value of the priced lines, how many have no price, and their lines."""
    rows = purchase_lines if canceled else purchase_lines.filter("status <> 'canceled'")
    line = F.struct("variant_id", "status", "quantity", "received", "price")
    orders = rows.groupBy("reference", "vendor_id").agg(
        F.count("*").alias("n_lines"), F.sum("quantity").alias("units"), F.round(F.sum(F.col("quantity") * F.col("price")), 2).alias("value"), F.count_if(F.col("price").isNull()).alias("unpriced"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    return orders.join(vendors.select("vendor_id", F.col("name").alias("vendor")), "vendor_id", "left").select("reference", "vendor", "n_lines", "units", "value", "unpriced", "lines")


def reorder_outcome(purchase_lines: DataFrame, sold_after: DataFrame) -> DataFrame:
    """Units that a received order let the shop sell: sold in the month after it, at most what arrived, beyond what was there."""
    rows = purchase_lines.filter("status = 'received'").join(sold_after, "variant_id", "left").fillna(0.0, ["units_sold"])
    saved = F.greatest(F.least(F.col("units_sold"), F.col("received").cast("double")) - F.col("on_hand_at_draft").cast("double"), F.lit(0.0))
    return rows.withColumn("units_saved", saved).groupBy("reference").agg(F.round(F.sum("units_saved"), 2).alias("units_saved"), F.round(F.sum(F.col("units_saved") * F.col("price").cast("double")), 2).alias("sales_saved"))


def next_reference(orders: DataFrame, when: dt.date) -> str:
    """PO-yyyy-mm-nnnn: the count of the month's orders and one."""
    prefix = f"PO-{when:%Y-%m}-"
    return f"{prefix}{orders.filter(F.col('reference').startswith(prefix)).count() + 1:04d}"


