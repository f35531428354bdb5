"""Robust baselines by weekday and location, and the detectors that use them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.context import BadArgument, DateRange, Shop
from tallyspark.functions.numbers import money, ratio, total, units
from tallyspark.operators.demand import shortfall_impact
from tallyspark.operators.inventory import negative_stock
from tallyspark.operators.jobs import Schedule
from tallyspark.operators.scopes import refunds_in, sold_lines
from tallyspark.operators.staffing import heatmap, observe
from tallyspark.operators.stale import stale_rows

#: Fixed values of the detectors.
Z = {"low": 3.2, "normal": 2.5, "high": 2.0}
LEAST_DOLLARS, SCAN_DAYS, PERIODS, USABLE = 75, 7, 8, 4
SPREAD_FLOOR, MAD_TO_SIGMA = 25, 1.4826
GAP_ORDERS, GAP_MULTIPLE, GAP_FLOOR_HOURS = 400, 3, 30
DEAD_LEAST, DEAD_WARN, REORDER_URGENT = 100, 750, 250
#: The hour of the shop's day at which detectors run.
CHECKED_AT = 6
SHRINK_DAYS, SHRINK_VALUE, SHRINK_UNITS = 14, 40, 5
REFUND_FLOOR, REFUND_MULTIPLE, REFUND_WEEKS, REFUND_DAYS = 0.05, 2.5, 6, 91


def daily_observations(shop: Shop, period: DateRange) -> DataFrame:
    """Net of discounts, not of refunds, by local day and location; a day without sales makes no row."""
    day = shop.local_day(F.col("placed_at"))
    sold = sold_lines(shop, period).groupBy(day.alias("day"), "location_id").agg(total(F.col("gross") - F.col("discount")).alias("net"), total("discount").alias("discounts"), F.countDistinct("order_id").alias("orders"), total("quantity").alias("units"), F.bool_or(F.col("channel") == "event").alias("is_event"))
    back = refunds_in(shop, period)[0].groupBy(shop.local_day(F.col("occurred_at")).alias("r_day"), F.col("location_id").alias("r_location")).agg(total("amount").alias("refunds"))
    both = sold.join(back, F.col("day").eqNullSafe(F.col("r_day")) & F.col("location_id").eqNullSafe(F.col("r_location")), "left").fillna(0, ["refunds"])
    return both.select("day", "location_id", money("net").alias("net_sales"), money("discounts").alias("discounts"), "orders", units("units").alias("units"), money("refunds").alias("refunds"), "is_event")


def _cents(column: Column) -> Column:
    """Half up, also where a double stands a little below the half."""
    return F.floor(column * 100 + 0.500001) / 100


def _median(column: Column) -> Column:
    return _cents(F.percentile(column, 0.5))


def _spread(side: Column, middle: Column) -> tuple[Column, Column]:
    off = F.abs(F.col("net_sales") - middle)
    return F.count(F.when(side, 1)), _cents(_median(F.when(side, off)) * MAD_TO_SIGMA)


def weekday_baselines(observations: DataFrame, as_of: dt.date, weeks: int = PERIODS, judged_from: dt.date | None = None) -> DataFrame:
    """Median and one-sided spreads of each location's weekday; event days and judged days are left out."""
    rows = observations.filter(~F.col("is_event") & (F.col("day") >= F.lit(as_of - dt.timedelta(weeks=weeks))) & (F.col("day") < F.lit(judged_from or as_of))).withColumn("weekday", F.weekday("day"))
    keys = ["location_id", "weekday"]
    middle = rows.groupBy(*keys).agg(_median(F.col("net_sales")).alias("median"), F.count("*").alias("observations"), F.percentile("orders", 0.5).alias("median_orders"))
    joined = rows.join(middle.withColumnRenamed("location_id", "b_location").withColumnRenamed("weekday", "b_weekday"), F.col("location_id").eqNullSafe(F.col("b_location")) & (F.col("weekday") == F.col("b_weekday")))
    below, above, all_ = (_spread(s, F.col("median")) for s in (F.col("net_sales") < F.col("median"), F.col("net_sales") > F.col("median"), F.lit(True)))
    out = joined.groupBy(*keys, "median", "observations", "median_orders").agg(below[0].alias("nb"), below[1].alias("sb"), above[0].alias("na"), above[1].alias("sa"), all_[1].alias("s"))
    return out.select(*keys, "median", "observations", "median_orders", F.when(F.col("nb") >= 2, F.col("sb")).otherwise(F.col("s")).alias("spread_below"), F.when(F.col("na") >= 2, F.col("sa")).otherwise(F.col("s")).alias("spread_above"))


def health_at(shop: Shop, as_of: dt.date) -> DataFrame:
    """sync_health() as it was when the detectors ran on the morning of a day: of the orders placed until then."""
    now = dt.datetime.combine(as_of, dt.time(CHECKED_AT), ZoneInfo(shop.timezone)).astimezone(dt.UTC).replace(tzinfo=None)
    before = shop.orders.filter(F.col("placed_at") <= F.lit(now.isoformat(sep=" ")).cast("timestamp"))
    return sync_health(replace(shop, frames=shop.frames | {"orders": before}), now)


def sales_anomalies(shop: Shop, as_of: dt.date, sensitivity: str = "normal") -> DataFrame:
    """Days of the last week far off their weekday: by z and by dollars. None while orders are overdue: missing data looks like a collapse."""
    first = as_of - dt.timedelta(days=SCAN_DAYS)
    seen = daily_observations(shop, DateRange(as_of - dt.timedelta(weeks=PERIODS + 1), as_of))
    base = weekday_baselines(seen, as_of, PERIODS + 1, first).filter(F.col("observations") >= USABLE).withColumnRenamed("location_id", "b_location").withColumnRenamed("weekday", "b_weekday")
    days = seen.filter(~F.col("is_event") & (F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(as_of)))
    both = days.join(base, F.col("location_id").eqNullSafe(F.col("b_location")) & (F.weekday("day") == F.col("b_weekday")))
    both = both.join(health_at(shop, as_of).filter("not stale").select("stale"))  # one row or none
    off = F.col("net_sales") - F.col("median")
    spread = F.greatest(F.when(off < 0, F.col("spread_below")).otherwise(F.col("spread_above")), F.lit(float(SPREAD_FLOOR)))
    rows = both.withColumn("difference", F.round(off, 2)).withColumn("z", F.round(off / spread, 2)).filter((F.abs("z") >= Z[sensitivity]) & (F.abs("difference") >= LEAST_DOLLARS))
    return rows.select("day", "location_id", "net_sales", "median", "z", "difference", F.when(F.col("difference") < 0, "warn").otherwise("info").alias("severity"))


def sync_health(shop: Shop, now: dt.datetime) -> DataFrame:
    """Silence against three times the ninetieth percentile of the gaps between the last orders, and no less than the floor."""
    recent = shop.orders.filter("status <> 'canceled'").select("placed_at", "order_id").orderBy(F.desc("placed_at"), F.desc("order_id")).limit(GAP_ORDERS)
    before = F.lag("placed_at").over(Window.orderBy("placed_at", "order_id"))  # of a bounded number of rows
    gaps = recent.withColumn("hours", (F.unix_micros("placed_at") - F.unix_micros(before)) / 3.6e9)
    sums = gaps.agg(F.max("placed_at").alias("last_at"), F.percentile("hours", 0.9).alias("typical"))
    hours = (F.unix_micros(F.lit(now.isoformat(sep=" ")).cast("timestamp")) - F.unix_micros("last_at")) / 3.6e9
    limit = F.greatest(F.coalesce(F.col("typical") * GAP_MULTIPLE, F.lit(float(GAP_FLOOR_HOURS))), F.lit(float(GAP_FLOOR_HOURS)))
    return sums.select(F.round(hours, 1).alias("hours_since"), F.round("typical", 1).alias("typical_gap_hours"), F.coalesce(hours > limit, F.lit(True)).alias("stale"))


def shrink(shop: Shop, as_of: dt.date, rung_up: DataFrame) -> DataFrame:
    """Units that movements say were sold and no order rang up, by variant; rung_up is (variant_id, units_sold)."""
    period = DateRange.last(SHRINK_DAYS, as_of)
    moved = shop.movements.filter(period.inside(F.col("occurred_at"), shop.timezone)).groupBy("variant_id").agg(total(F.when(F.col("kind") == "sold", F.col("quantity"))).alias("moved"), total(F.when(F.col("kind") == "damaged", F.col("quantity"))).alias("explained"))
    rows = moved.join(rung_up, "variant_id", "left").fillna(0, ["units_sold"]).withColumn("missing", F.col("moved").cast("double") - F.col("units_sold"))
    rows = rows.filter("missing > 0").join(shop.variants.select("variant_id", units("price").alias("price"), units("cost").alias("cost")), "variant_id", "left").withColumn("value", F.round(F.col("missing") * F.coalesce("cost", "price"), 2))
    return rows.filter((F.col("value") >= SHRINK_VALUE) | (F.col("missing") >= SHRINK_UNITS)).select("variant_id", F.round("missing", 2).alias("missing"), units("explained").alias("explained"), "value")


def _shares(sold: DataFrame, back: DataFrame, *keys: str) -> DataFrame:
    """Refunds and discounts over net sales by keys, of sums (net, discounts) and (refunds)."""
    sold = sold.groupBy(*keys).agg(total("net").alias("net"), total("discounts").alias("discounts"))
    back = back.groupBy(*[F.col(k).alias(f"r_{k}") for k in keys]).agg(total("refunds").alias("refunds"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    both = sold.join(back, same, "left").fillna(0, ["refunds"])
    shares = [F.round(ratio(F.col(c), F.col("net")), 4).alias(f"{name}_share") for c, name in (("refunds", "refund"), ("discounts", "discount"))]
    return both.select(*keys, money("net").alias("net_sales"), money("refunds").alias("refunds"), money("discounts").alias("discounts"), *shares)


def _taken(shop: Shop, period: DateRange, week: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """Sales and refunds summed by location and, counted back from a last day, by week."""
    keys = lambda c: ["location_id", *([F.floor(F.date_diff(F.lit(week), shop.local_day(F.col(c))) / 7).alias("week")] if week else [])]
    sold = sold_lines(shop, period).groupBy(*keys("placed_at")).agg(total(F.col("gross") - F.col("discount")).alias("net"), total("discount").alias("discounts"))
    return sold, refunds_in(shop, period)[0].groupBy(*keys("occurred_at")).agg(total("amount").alias("refunds"))


def refund_shares(shop: Shop, period: DateRange) -> DataFrame:
    """Refunds and discounts over net sales by location."""
    return _shares(*_taken(shop, period), "location_id")


def refund_spike(shop: Shop, as_of: dt.date) -> DataFrame:
    """Recent weeks whose share of refunds or discounts is high and a multiple of the quarter's, which includes them."""
    last = as_of - dt.timedelta(days=1)
    sold, back = _taken(shop, DateRange(as_of - dt.timedelta(days=REFUND_DAYS), last), last)
    usual = _shares(sold, back, "location_id").select(F.col("location_id").alias("u_location"), F.col("refund_share").alias("u_refund"), F.col("discount_share").alias("u_discount"))
    weeks = _shares(sold, back, "location_id", "week").filter((F.col("week") < REFUND_WEEKS) & (F.col("net_sales") > 0))
    both = weeks.withColumn("week_end", F.date_sub(F.lit(last), (7 * F.col("week")).cast("int"))).join(usual, F.col("location_id").eqNullSafe(F.col("u_location")))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(f"{k}_share").alias("share"), F.col(f"u_{k}").alias("usual")) for k in ("refund", "discount")])).alias("k")
    rows = both.select("week_end", "location_id", kinds).select("week_end", "location_id", "k.*")
    high = (F.col("share") >= REFUND_FLOOR) & F.when(F.col("usual") > 0, F.col("share") >= F.col("usual") * REFUND_MULTIPLE).otherwise(F.col("share") >= REFUND_FLOOR * 2)
    return rows.filter(high)


@dataclass(frozen=True)
class Detector:
    """Finds drafts of insights: run gives (subject, severity, impact) for a shop and a day."""

    kind: str
    run: Callable[[Shop, dt.date], DataFrame]
    schedule: Schedule
    requires: tuple[str, ...] = ()


DETECTORS: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    if detector.kind in DETECTORS:
        raise BadArgument(f"there is a detector {detector.kind!r} already")
    DETECTORS[detector.kind] = detector
    return detector


def detected(shop: Shop, as_of: dt.date, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(kind, subject, severity, impact): drafts of the detectors asked for, or of all, that the shop's sources support."""
    unknown = set(kinds or ()) - set(DETECTORS)
    if unknown:
        raise BadArgument(f"there is no detector {', '.join(sorted(unknown))}; there are {', '.join(DETECTORS)}")
    out = shop.orders.sparkSession.createDataFrame([], "kind string, subject string, severity string, impact double")
    for d in DETECTORS.values():
        if d.kind in (kinds or DETECTORS) and set(d.requires) <= shop.capabilities:
            out = out.unionByName(d.run(shop, as_of).select(F.lit(d.kind).alias("kind"), F.col("subject").cast("string"), "severity", F.col("impact").cast("double")))
    return out


def _anomaly_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    return sales_anomalies(shop, as_of).select(F.concat_ws(":", F.col("day").cast("string"), F.col("location_id").cast("string")).alias("subject"), "severity", F.col("difference").alias("impact"))


def _spike_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    return refund_spike(shop, as_of).select(F.concat_ws(":", F.col("week_end").cast("string"), F.col("location_id").cast("string"), "what").alias("subject"), F.lit("warn").alias("severity"), F.lit(None).alias("impact"))


def _shrink_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    sold = sold_lines(shop, DateRange.last(SHRINK_DAYS, as_of), require_product=True).groupBy("variant_id").agg(units(total("quantity")).alias("units_sold"))
    return shrink(shop, as_of, sold).select(F.col("variant_id").alias("subject"), F.lit("warn").alias("severity"), F.col("value").alias("impact"))


def _negative_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    return negative_stock(shop).select(F.col("variant_id").alias("subject"), F.lit("warn").alias("severity"), F.lit(None).alias("impact"))


def _week_of(day: dt.date) -> str:
    year, week, _ = day.isocalendar()
    return f"{year}-W{week:02d}"


def _stale_data_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    """One a day while no order has come for longer than is usual here."""
    return health_at(shop, as_of).filter("stale").select(F.lit(str(as_of)).alias("subject"), F.lit("urgent").alias("severity"), F.lit(None).alias("impact"))


def _dead_stock_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    """One a week: the cash in all stock that stopped moving, if it is worth a word."""
    sums = stale_rows(shop, as_of).agg(F.round(F.sum("cash"), 2).cast("double").alias("impact")).filter(F.col("impact") >= DEAD_LEAST)
    return sums.select(F.lit(_week_of(as_of)).alias("subject"), F.when(F.col("impact") >= DEAD_WARN, "warn").otherwise("info").alias("severity"), "impact")


def _reorder_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    """One a week: what will be missed on shelves that are empty before a delivery can come."""
    sums = shortfall_impact(shop, as_of)
    return sums.select(F.lit(_week_of(as_of)).alias("subject"), F.when(F.col("impact") >= REORDER_URGENT, "urgent").otherwise("warn").alias("severity"), "impact")


def _staffing_drafts(shop: Shop, as_of: dt.date) -> DataFrame:
    """One a month for each location whose rota does not fit its tills; none for a shop without a rota."""
    subject = F.concat_ws(":", F.lit(f"{as_of:%Y-%m}"), F.col("location_id").cast("string"))
    if "rota" not in shop.frames:
        return shop.orders.limit(0).select(F.lit("").alias("subject"), F.lit("info").alias("severity"), F.lit(None).alias("impact"))
    seen = observe(heatmap(shop, as_of), shop.rota).join(shop.rota.groupBy("location_id", "weekday").agg(F.max("staff").alias("staff")), ["location_id", "weekday"])
    quiet = F.when(F.col("kind") != "busy", F.col("staff"))
    rows = seen.groupBy("location_id").agg(F.sum(quiet).alias("hours"))
    cost = F.round(F.col("hours") * shop.hourly_labour_cost, 2) if shop.hourly_labour_cost else F.lit(None)
    return rows.select(subject.alias("subject"), F.lit("info").alias("severity"), cost.alias("impact"))


register(Detector("sales_anomaly", _anomaly_drafts, Schedule("daily", hour=6)))
register(Detector("refund_spike", _spike_drafts, Schedule("weekly", hour=6)))
register(Detector("shrink", _shrink_drafts, Schedule("daily", hour=6), ("has_inventory_history",)))
register(Detector("impossible_stock", _negative_drafts, Schedule("daily", hour=6)))
register(Detector("stale_data", _stale_data_drafts, Schedule("daily", hour=6)))
register(Detector("dead_stock", _dead_stock_drafts, Schedule("weekly", hour=6)))
register(Detector("reorder", _reorder_drafts, Schedule("daily", hour=6)))
register(Detector("staffing", _staffing_drafts, Schedule("monthly", hour=6)))
