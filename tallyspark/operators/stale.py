"""Stock that does not sell: grades, partners, better places and what to do."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Shop
from tallyspark.functions.numbers import money, share, total, units
from tallyspark.operators.scopes import sold_lines, stock

if TYPE_CHECKING:
    from tallyspark.operators.sales_days import SalesDays

#: Days since the last sale, and the windows and ratio of slowing stock; markdown steps; least baskets and share.
STALE_DAYS, DEAD_DAYS = 60, 120
RECENT_DAYS, TRAILING_DAYS, SLOWING = 30, 90, 0.5
LADDER = (0.15, 0.30, 0.50)
LEAST_BASKETS, LEAST_SHARE = 3, 0.25
START = dt.date(1970, 1, 2)
#: Variants of a basket that meet in one group.
BASKET_BLOCK = 500


def stale_rows(shop: Shop, as_of: dt.date, kept: SalesDays | None = None) -> DataFrame:
    """Variants on the shelf that do not sell as they should. kept: the written days, read instead of all lines."""
    held = stock(shop)[0].groupBy("variant_id", "sku", "category_id", "price", "cost").agg(total("on_hand").alias("on_hand")).filter("on_hand > 0")
    inside = lambda days: F.when(DateRange.last(days, as_of).inside(F.col("placed_at"), shop.timezone), F.col("quantity"))
    sold = kept.sales(shop, as_of, recent=RECENT_DAYS, trailing=TRAILING_DAYS) if kept else sold_lines(shop, DateRange(START, as_of), require_product=True).groupBy("variant_id").agg(F.max("placed_at").alias("last_sale"), total(inside(RECENT_DAYS)).alias("recent"), total(inside(TRAILING_DAYS)).alias("trailing"))
    rows = held.join(sold, "variant_id", "left").fillna(0, ["recent", "trailing"])
    rows = rows.withColumn("days_since", F.date_diff(F.lit(as_of), shop.local_day(F.col("last_sale")))).withColumn("recent_daily", F.bround(F.col("recent").cast("double") / RECENT_DAYS, 4)).withColumn("trailing_daily", F.bround(F.col("trailing").cast("double") / TRAILING_DAYS, 4))
    grade = F.when(F.col("days_since").isNull() | (F.col("days_since") >= DEAD_DAYS), "dead").when(F.col("days_since") >= STALE_DAYS, "stale").when((F.col("trailing_daily") > 0) & (F.col("recent_daily") < F.col("trailing_daily") * SLOWING), "slowing")
    return rows.withColumn("kind", grade).filter("kind is not null").withColumn("cash", (F.col("on_hand") * F.coalesce("cost", "price")).cast("decimal(24,4)"))


def stale_inventory(shop: Shop, as_of: dt.date, limit: int = 500, kept: SalesDays | None = None) -> DataFrame:
    """Variants on the shelf that are dead, stale or slowing, by the cash in them (at cost, else at price)."""
    rows = stale_rows(shop, as_of, kept).orderBy(F.col("cash").desc_nulls_last(), "variant_id").limit(limit)
    return rows.select("variant_id", "kind", units("on_hand").alias("on_hand"), "days_since", "recent_daily", "trailing_daily", money("cash").alias("cash"))


def basket_pairs(baskets: DataFrame, targets: DataFrame, block: int = BASKET_BLOCK) -> DataFrame:
    """(target_id, variant_id, baskets): in how many of the baskets (order_id, variant_id, each pair once) a target stands with another variant.

    A basket of more than `block` variants is dealt into blocks by a hash, and each block of its targets meets each of its
    blocks in a group of its own: no group has more pairs than two blocks make. Pairs are counted in the tasks before they are
    shuffled. Only targets are joined with their baskets, so pairs are of targets, not of all variants.
    """
    large = baskets.groupBy("order_id").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    rows = baskets.join(large, "order_id", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("variant_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = rows.join(targets, "variant_id", "left_semi").select("order_id", F.col("at").alias("own"), every.alias("other"), F.col("variant_id").alias("target_id"))
    met = mine.join(rows.select("order_id", every.alias("own"), F.col("at").alias("other"), "variant_id"), ["order_id", "own", "other"])
    return met.filter("target_id <> variant_id").groupBy("target_id", "variant_id").agg(F.count("*").alias("baskets"))


def co_purchases(shop: Shop, targets: DataFrame, as_of: dt.date, days: int = 365, partners: int = 3) -> DataFrame:
    """For each target variant the others most often in the same orders, that sold in the last 31 days, too.

    Only baskets with a target are joined, so pairs are of targets, not of all variants.
    """
    baskets = sold_lines(shop, DateRange.last(days, as_of), require_product=True).select("order_id", "variant_id").distinct()
    pairs = basket_pairs(baskets, targets.select("variant_id").distinct())
    recent = sold_lines(shop, DateRange(as_of - dt.timedelta(days=30), as_of), require_product=True).groupBy("variant_id").agg(total("quantity").alias("units")).filter("units > 0")
    w = Window.partitionBy("target_id").orderBy(F.desc("baskets"), F.desc("units"), "variant_id")
    return pairs.join(recent, "variant_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= partners).select("target_id", F.col("variant_id").alias("partner_id"), "baskets", units("units").alias("units"))


def category_by_location(shop: Shop, as_of: dt.date, days: int = 90) -> DataFrame:
    """Each location's share of a category's units."""
    sold = sold_lines(shop, DateRange.last(days, as_of), require_product=True).groupBy("category_id", "location_id").agg(total("quantity").alias("units"))
    whole = F.sum("units").over(Window.partitionBy("category_id"))
    return sold.select("category_id", "location_id", units("units").alias("units"), share(F.col("units"), whole).alias("share"))


def ladder(price: Column, cost: Column) -> Column:
    """Markdown steps: discount, price, margin a unit, and whether the price clears the cost (it does if that is unknown)."""

    def step(d: float) -> Column:
        cut = F.round(price * F.lit(Decimal(str(1 - d))), 2)
        return F.struct(F.lit(d).alias("discount"), units(cut).alias("price"), money(cut - cost).alias("margin"), F.coalesce(cut >= cost, F.lit(True)).alias("clears_cost"))

    return F.when(price.isNotNull(), F.array(*map(step, LADDER)))


def markdown_ladder(shop: Shop, as_of: dt.date) -> DataFrame:
    rows = stale_rows(shop, as_of).select("variant_id", F.explode(ladder(F.col("price"), F.col("cost"))).alias("s"))
    return rows.select("variant_id", "s.*")


def bundle_price(one: Column, other: Column) -> Column:
    """A tenth off the pair, as a whole amount less a cent."""
    return F.round((one + other) * F.lit(Decimal("0.9")), 0).cast("double") - 0.01


def vendor_terms(shop: Shop) -> DataFrame:
    """The primary vendor of each variant and whether it takes returns."""
    return shop.terms.filter("is_primary").select("variant_id", "vendor_id", "takes_returns")


def where_it_sits(shop: Shop) -> DataFrame:
    """The location with most of each variant; of equal ones the smaller."""
    shelf = F.max(F.struct("on_hand", (-F.col("location_id")).alias("l")))
    return shop.levels.groupBy("variant_id").agg(shelf.alias("s")).select("variant_id", (-F.col("s.l")).alias("sits_at"))


def rescue(shop: Shop, as_of: dt.date, limit: int = 200) -> DataFrame:
    """What to do with each stale variant: return it, bundle it, move it, or mark it down, whichever applies first."""
    rows = stale_rows(shop, as_of)
    takes_returns = vendor_terms(shop)
    best = co_purchases(shop, rows, as_of, partners=3).filter(F.col("baskets") >= LEAST_BASKETS).join(shop.variants.select(F.col("variant_id").alias("partner_id"), F.col("price").alias("partner_price")), "partner_id", "left")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("baskets"), F.desc("units"), "partner_id"))).filter("n = 1").select(F.col("target_id").alias("variant_id"), "partner_id", "partner_price")
    where = where_it_sits(shop)
    strong = category_by_location(shop, as_of).filter(F.col("share") >= LEAST_SHARE).groupBy("category_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "location_id"))).alias("strong"))
    rows = rows.join(takes_returns, "variant_id", "left").join(best, "variant_id", "left").join(where, "variant_id", "left").join(strong, "category_id", "left")
    target = F.element_at(F.filter("strong", lambda x: x["location_id"] != F.col("sits_at"))["location_id"], 1)
    rows = rows.withColumn("move_to", F.when(F.size(F.filter("strong", lambda x: x["location_id"] != F.col("sits_at"))) > 0, target))
    steps = ladder(F.col("price"), F.col("cost"))
    clears = F.filter(steps, lambda s: s["clears_cost"])
    step = F.when(F.size(clears) > 0, F.get(clears, F.lit(0))).otherwise(F.get(steps, F.lit(0)))
    dead = F.col("kind") == "dead"
    play = F.when(dead & F.coalesce("takes_returns", F.lit(False)), "return_to_vendor").when(F.col("partner_id").isNotNull(), "bundle").when(F.col("move_to").isNotNull(), "move").otherwise("markdown")
    rows = rows.withColumn("play", play)
    price = F.when(F.col("play") == "bundle", F.round(bundle_price(F.col("price"), F.col("partner_price")), 2)).when(F.col("play") == "markdown", step["price"])
    return rows.orderBy(F.col("cash").desc_nulls_last(), "variant_id").limit(limit).select("variant_id", "kind", "play", price.alias("new_price"), F.when(F.col("play") == "bundle", F.col("partner_id")).alias("partner_id"), F.when(F.col("play") == "move", F.col("move_to")).alias("move_to"))


def rescue_outcome(actions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Units in the 30 days before and after an action, and the cash recovered at cost."""
    rows = actions.join(before.select("variant_id", F.col("units_sold").alias("units_before")), "variant_id", "left").join(after.select("variant_id", F.col("units_sold").alias("units_after")), "variant_id", "left").fillna(0.0, ["units_before", "units_after"])
    return rows.select("variant_id", "kind", "units_before", "units_after", F.round(F.least("units_after", "on_hand_before") * F.col("unit_cost"), 2).alias("recovered"))
