"""When a shop is busy: weekday by hour, and the rota laid over it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Shop
from tallyspark.functions.numbers import total
from tallyspark.operators.scopes import sold_lines

#: Weeks observed; orders a staff-hour that are quiet and busy; orders that make an opening or closing hour dead.
WEEKS, QUIET, BUSY, DEAD = 8, 1.0, 6.0, 0.5


def heatmap(shop: Shop, as_of: dt.date, weeks: int = WEEKS) -> DataFrame:
    """Orders and sales by location, weekday (0 is Monday) and local hour, without event days.

    orders_per_observation divides by days with a sale in that hour, which overstates quiet hours; orders_per_week
    by all weeks.
    """
    local = F.from_utc_timestamp("placed_at", shop.timezone)
    lines = sold_lines(shop, DateRange.last(7 * weeks, as_of)).withColumns({"day": F.to_date(local), "weekday": F.weekday(local), "hour": F.hour(local)})
    hours = lines.groupBy("location_id", "day", "weekday", "hour").agg(F.countDistinct("order_id").alias("orders"), total(F.col("gross") - F.col("discount")).alias("net"), F.bool_or(F.col("channel") == "event").alias("event")).filter("not event")
    cells = hours.groupBy("location_id", "weekday", "hour").agg(F.sum("orders").alias("orders"), total("net").alias("net"), F.countDistinct("day").alias("observations"))
    return cells.select("location_id", "weekday", "hour", "orders", F.round("net", 2).cast("double").alias("net_sales"), "observations", F.round(F.col("orders") / F.col("observations"), 2).alias("orders_per_observation"), F.round(F.col("orders") / weeks, 2).alias("orders_per_week"))


def busiest_hours(shop: Shop, as_of: dt.date, weekday: int | None = None, limit: int = 8) -> DataFrame:
    cells = heatmap(shop, as_of)
    if weekday is not None:
        cells = cells.filter(F.col("weekday") == weekday)
    return cells.orderBy(F.desc("orders_per_observation"), F.desc("orders"), "location_id", "weekday", "hour").limit(limit)


def observe(cells: DataFrame, rota: DataFrame) -> DataFrame:
    """Hours of the rota (location_id, weekday, start_hour, end_hour, staff) that are quiet, busy, or dead at an end of a shift."""
    hours = rota.withColumn("hour", F.explode(F.sequence("start_hour", F.col("end_hour") - 1)))
    both = hours.join(cells.select("location_id", "weekday", "hour", "orders_per_observation"), ["location_id", "weekday", "hour"], "left").fillna(0.0, ["orders_per_observation"])
    load = F.round(F.col("orders_per_observation") / F.col("staff"), 2)
    edge = (F.col("hour") == F.col("start_hour")) | (F.col("hour") == F.col("end_hour") - 1)
    kind = F.when(edge & (F.col("orders_per_observation") <= DEAD), "dead_edge").when(load <= QUIET, "quiet").when(load >= BUSY, "busy")
    return both.select("location_id", "weekday", "hour", load.alias("orders_per_staff_hour"), kind.alias("kind")).filter("kind is not null")
