"""Insights and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.context import Shop

OPEN = ("new", "seen", "snoozed")
#: Columns that belong to the user and survive a new finding of the same key.
KEPT = ("status", "rating", "snoozed_until")


def severity_rank() -> Column:
    return F.when(F.col("severity") == "urgent", 0).when(F.col("severity") == "warn", 1).otherwise(2)


def visible(insights: DataFrame, now: Column) -> DataFrame:
    """Open, not expired and not snoozed at the moment."""
    return insights.filter(F.col("status").isin(*OPEN) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)))


def ranked(insights: DataFrame, now: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Worst, dearest and newest first; ties to the smaller key."""
    return visible(insights, now).orderBy(severity_rank(), F.col("dollar_impact").desc_nulls_last(), F.desc("created_at"), "dedupe_key").offset(offset).limit(limit)


def record(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """Stored insights with the drafts merged by dedupe_key: facts are the draft's, what the user did stays."""
    names = stored.columns
    s, d = stored.alias("s"), drafts.alias("d")
    both = s.join(d, "dedupe_key", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}")) if c in (*KEPT, "created_at") else F.when(F.col("d.kind").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(*[F.col(c) if c == "dedupe_key" else pick(c).alias(c) for c in names])


def expire(insights: DataFrame, now: Column) -> DataFrame:
    return insights.withColumn("status", F.when(F.col("status").isin(*OPEN) & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def value_ledger(insights: DataFrame, outcomes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Insights raised and acted on in a period, the money attributed to them, and what was flagged."""
    rows = insights.filter((F.col("created_at") >= start) & (F.col("created_at") < end)).join(outcomes, "dedupe_key", "left")
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return rows.agg(F.count("*").alias("created"), F.count_if(F.expr("status = 'acted'")).alias("acted"), money("attributed").alias("attributed"), money(F.when(F.col("attributed") > 0, F.col("attributed"))).alias("recovered"), money("dollar_impact").alias("flagged"))


def precision(insights: DataFrame) -> DataFrame:
    """Raised, rated and useful findings of each detector."""
    rows = insights.groupBy("kind").agg(F.count("*").alias("raised"), F.count("rating").alias("rated"), F.count_if(F.expr("rating > 0")).alias("useful"))
    return rows.withColumn("precision", F.when(F.col("rated") > 0, F.round(F.col("useful") / F.col("rated"), 4)))


def quiet(start: Column, end: Column, minute: Column) -> Column:
    """Inside quiet hours, in minutes of the day; they may run over midnight."""
    return F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def delivery(messages: DataFrame, cap: int = 3) -> DataFrame:
    """Messages (recipient, enabled, severity, minute, quiet_start, quiet_end, sent_today) with why they are held back, if they are; urgent ones pass quiet hours and the cap."""
    urgent = F.col("severity") == "urgent"
    why = F.when(~F.col("enabled"), "channel_off").when(~urgent & quiet(F.col("quiet_start"), F.col("quiet_end"), F.col("minute")), "quiet_hours").when(~urgent & (F.col("sent_today") >= cap), "daily_cap")
    return messages.withColumn("suppressed", why)


def briefing(shop: Shop, insights: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    """(section, item, value): what an assistant is told beforehand: locations, channels, the window of sales, and the loudest findings."""
    row = lambda section, item, value: (F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))
    sold = shop.orders.filter("status <> 'canceled'")
    window = sold.agg(F.min("placed_at").alias("first"), F.max("placed_at").alias("last"))
    days = window.select(F.explode(F.create_map(F.lit("first_day"), shop.local_day(F.col("first")), F.lit("last_day"), shop.local_day(F.col("last")))).alias("item", "day"))
    loud = ranked(insights, now, limit).filter(F.col("severity") != "info")
    return (
        shop.locations.select(*row("location", F.col("location_id"), F.col("name")))
        .unionByName(sold.groupBy("channel").agg(F.count("*").alias("n")).select(*row("channel", F.col("channel"), F.col("n"))))
        .unionByName(days.select(*row("sales", F.col("item"), F.col("day"))))
        .unionByName(loud.select(*row("finding", F.col("dedupe_key"), F.col("kind"))))
    )
