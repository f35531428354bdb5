"""Stock metrics: shelves joined with what sold lately."""

from __future__ import annotations

import datetime as dt
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.context import MOVEMENT_SIGNS, NO_FILTERS, BadArgument, DateRange, Filters, Shop
from tallyspark.functions.numbers import money, share, total, units
from tallyspark.operators.scopes import sold_lines, stock, with_totals

if TYPE_CHECKING:
    from tallyspark.operators.sales_days import SalesDays

VELOCITY_DAYS, COVER_DAYS = 28, 14


def inventory_value(shop: Shop, filters: Filters = NO_FILTERS) -> DataFrame:
    """What is on the shelves at price and at cost; coverage is the share of units with a cost."""
    worth = lambda c: total((F.col("on_hand") * F.col(c)).cast("decimal(24,8)"))
    sums = stock(shop, filters)[0].filter("on_hand > 0").agg(F.countDistinct("variant_id").alias("variants"), total("on_hand").alias("units"), worth("price").alias("retail"), worth("cost").alias("cost"), total(F.when(F.col("cost").isNotNull(), F.col("on_hand"))).alias("costed"), total(F.when(F.col("price").isNull(), F.col("on_hand"))).alias("unpriced"))
    return sums.select("variants", units("units").alias("units"), money("retail").alias("retail_value"), money("cost").alias("cost_value"), share(F.col("costed"), F.col("units")).alias("cost_coverage"), units("unpriced").alias("unpriced_units"))


def sell_through(shop: Shop, period: DateRange, filters: Filters = NO_FILTERS, limit: int = 20) -> DataFrame:
    """Sold over sold and what is on hand now, by variant; those that sold most."""
    sold = sold_lines(shop, period, filters, require_product=True).groupBy("variant_id").agg(total("quantity").alias("sold"))
    held = stock(shop, filters)[0].groupBy("variant_id").agg(total("on_hand").alias("on_hand"))
    out = sold.join(held, "variant_id", "full_outer").fillna(0, ["sold", "on_hand"]).filter("sold > 0 or on_hand > 0")
    return out.orderBy(F.desc("sold"), "variant_id").limit(limit).select("variant_id", units("sold").alias("units_sold"), units("on_hand").alias("on_hand"), share(F.col("sold"), F.col("sold") + F.col("on_hand")).alias("sell_through"))


def stock_rows(shop: Shop, as_of: dt.date, filters: Filters = NO_FILTERS, days: int = VELOCITY_DAYS, kept: SalesDays | None = None, since: dt.date = dt.date(1970, 1, 2)) -> DataFrame:
    """A row a variant: on hand, units sold in the last days (anywhere: velocity is of the shop), daily rate, days of cover and last sale.

    Sums come before joins, so that no sale is counted for more than one shelf. kept: the written days, read instead of all
    lines. since: no earlier sale is looked for, for callers that ask for variants that sold later only.
    """
    held = stock(shop, filters)[0].groupBy("variant_id", "sku", "price").agg(total("on_hand").alias("on_hand"))
    if kept:
        sales = kept.sales(shop, as_of, sold=days)
    else:
        lately = F.when(DateRange.last(days, as_of).inside(F.col("placed_at"), shop.timezone), F.col("quantity"))
        sales = sold_lines(shop, DateRange(since, as_of), require_product=True).groupBy("variant_id").agg(total(lately).alias("sold"), F.max("placed_at").alias("last_sale"))
    out = held.join(sales, "variant_id", "left").fillna(0, ["sold"])
    rate = F.col("sold").cast("double") / days
    return out.withColumn("daily", F.round(rate, 3)).withColumn("cover", F.when(F.col("sold") > 0, F.round(F.col("on_hand").cast("double") / rate, 1))).withColumn("last_day", shop.local_day(F.col("last_sale")))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("variant_id", "sku", units("on_hand").alias("on_hand"), units("sold").alias("units_sold"), "daily", "cover", "last_day")


def _window(as_of: dt.date) -> dt.date:
    """The first day of the window in which units are counted: what sold in it has its last sale there."""
    return DateRange.last(VELOCITY_DAYS, as_of).start


def days_of_cover(shop: Shop, as_of: dt.date, filters: Filters = NO_FILTERS, limit: int = 25) -> DataFrame:
    """Variants that sell and are on the shelf, the shortest cover first."""
    return _listed(stock_rows(shop, as_of, filters, since=_window(as_of)).filter("sold > 0 and on_hand > 0").orderBy("cover", "variant_id").limit(limit))


def low_stock(shop: Shop, as_of: dt.date, filters: Filters = NO_FILTERS, limit: int = 50) -> DataFrame:
    """Variants that sold in the window and have few units or less than two weeks' cover left."""
    rows = stock_rows(shop, as_of, filters, since=_window(as_of)).filter((F.col("sold") > 0) & ((F.col("on_hand") <= shop.low_stock_threshold) | (F.col("cover") < COVER_DAYS)))
    return _listed(rows.orderBy(F.col("cover").asc_nulls_last(), "variant_id").limit(limit))


def dead_stock(shop: Shop, as_of: dt.date, filters: Filters = NO_FILTERS, limit: int = 50, kept: SalesDays | None = None) -> DataFrame:
    """Variants on the shelf that never sold, or not since the cutoff, by value at price."""
    cutoff = as_of - dt.timedelta(days=shop.dead_stock_days)
    rows = stock_rows(shop, as_of, filters, kept=kept).filter((F.col("on_hand") > 0) & (F.col("last_day").isNull() | (F.col("last_day") < F.lit(cutoff))))
    rows = rows.withColumn("value", (F.col("on_hand") * F.col("price")).cast("decimal(24,4)"))
    return rows.orderBy(F.col("value").desc_nulls_last(), "variant_id").limit(limit).select("variant_id", "sku", units("on_hand").alias("on_hand"), money("value").alias("retail_value"), "last_day")


def negative_stock(shop: Shop, limit: int = 50, filters: Filters = NO_FILTERS) -> DataFrame:
    """Variants whose shelves add up to less than nothing."""
    return stock(shop, filters)[0].groupBy("variant_id").agg(total("on_hand").alias("on_hand")).filter("on_hand < 0").orderBy("on_hand", "variant_id").limit(limit).select("variant_id", units("on_hand").alias("on_hand"))


def inventory_snapshot(shop: Shop) -> DataFrame:
    """Shelves now, valued at cost; coverage is the share of rows with a cost."""
    worth = total((F.col("on_hand") * F.col("cost")).cast("decimal(24,8)"))
    sums = stock(shop)[0].filter("on_hand > 0").agg(F.count("*").alias("shelves"), total("on_hand").alias("units"), worth.alias("value"), F.count("cost").alias("costed"))
    return sums.select("shelves", units("units").alias("units"), money("value").alias("cost_value"), share(F.col("costed"), F.col("shelves")).alias("cost_coverage"))


def signed(kind: str = "kind") -> Column:
    """+1, -1, or 0 for kinds whose direction is not known."""
    out = F.lit(0)
    for name, sign in MOVEMENT_SIGNS.items():
        out = F.when(F.col(kind) == name, sign).otherwise(out)
    return out


def inventory_at(shop: Shop, at: dt.date) -> DataFrame:
    """Shelves at the end of a day: today's counts less what has moved since, not below zero; approximate where a move has no sign."""
    shop.require("has_inventory_history")
    _, after = DateRange(at, at).bounds(shop.timezone)
    moved = shop.movements.filter(F.col("occurred_at") >= F.lit(after.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")).groupBy("variant_id", "location_id").agg(total(F.col("quantity") * signed()).alias("since"), F.bool_or(signed() == 0).alias("unclear"))
    shelves = stock(shop)[0].join(moved, ["variant_id", "location_id"], "left").fillna(0, ["since"])
    held = F.greatest(F.col("on_hand") - F.col("since"), F.lit(0))
    sums = shelves.withColumn("held", held.cast("decimal(20,4)")).agg(total("held").alias("units"), total((F.col("held") * F.col("cost")).cast("decimal(28,8)")).alias("value"), F.coalesce(F.bool_or("unclear"), F.lit(False)).alias("approximate"))
    return sums.select(units("units").alias("units"), money("value").alias("cost_value"), "approximate")


#: Sort keys of the catalog and their columns.
SORTS = {"name": "name", "sku": "sku", "price": "price", "cost": "cost", "on_hand": "on_hand", "margin": "margin", "category": "category_id", "product": "product_id", "last_sold": "last_sale"}


def catalog_page(shop: Shop, as_of: dt.date, query: str | None = None, sort: str = "name", descending: bool = False, limit: int = 50, offset: int = 0, filters: Filters = NO_FILTERS, totals: bool = False, kept: SalesDays | None = None) -> DataFrame:
    """A page of variants with stock by location, unit margin and last sale; ties by name and id, nulls last.

    totals: with total_rows before the page is cut, and whether it is truncated.
    """
    if sort not in SORTS:
        raise BadArgument(f"{sort!r} is no sort; choose one of {', '.join(SORTS)}")
    shelves = stock(shop, filters)[0].groupBy("variant_id").agg(total("on_hand").alias("on_hand"), F.array_sort(F.collect_list(F.struct("location_id", F.col("on_hand").alias("units")))).alias("stock"))
    last = kept.sales(shop, as_of) if kept else sold_lines(shop, DateRange(dt.date(1970, 1, 2), as_of), require_product=True).groupBy("variant_id").agg(F.max("placed_at").alias("last_sale"))
    rows = shop.variants.join(shelves, "variant_id", "left").join(last, "variant_id", "left").withColumn("margin", share(F.col("price") - F.col("cost"), F.col("price")))
    if query:
        pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        searched = [c for c in ("name", "sku", "barcode", "category_id") if c in rows.columns]
        rows = rows.filter(F.exists(F.array(*searched), lambda c: c.ilike(pattern)))
    key = F.col(SORTS[sort])
    page = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "name", "variant_id").offset(offset).limit(limit)
    text = F.array_join(F.transform("stock", lambda s: F.concat_ws("=", s["location_id"].cast("string"), s["units"].cast("int").cast("string"))), ";")
    out = page.select("variant_id", "name", "sku", units("price").alias("price"), "margin", units("on_hand").alias("on_hand"), text.alias("stock"), shop.local_day(F.col("last_sale")).alias("last_day"))
    return with_totals(out, rows, limit, offset) if totals else out


def keyset_page(df: DataFrame, sort: str, key: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """Rows after (sort value, key), one more than the limit: whether there is a next page shows in the count."""
    if after:
        df = df.filter(F.struct(sort, key) > F.struct(*[F.lit(v).cast(df.schema[c].dataType) for v, c in zip(after, (sort, key), strict=True)]))
    return df.orderBy(sort, key).limit(limit + 1)


