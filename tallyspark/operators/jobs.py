"""Schedules in a shop's own time, and what job runs say."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """hourly, daily, weekly (weekday 0 is Monday) or monthly (day 1 to 28)."""

    kind: str
    hour: int = 0
    minute: int = 0
    weekday: int = 0
    day: int = 1

    def last_due(self, tz: str, now: dt.datetime) -> dt.datetime:
        """The latest due instant that is not after now, in UTC; wall-clock times are the shop's."""
        local = now.astimezone(ZoneInfo(tz))
        if self.kind == "hourly":
            due = local.replace(minute=self.minute, second=0, microsecond=0)
            return (due if due <= local else due - dt.timedelta(hours=1)).astimezone(dt.UTC)
        days = (local.date() - dt.timedelta(days=n) for n in range(63))
        fits = {"daily": lambda d: True, "weekly": lambda d: d.weekday() == self.weekday, "monthly": lambda d: d.day == self.day}[self.kind]
        dues = (dt.datetime.combine(d, dt.time(self.hour, self.minute), ZoneInfo(tz)) for d in days if fits(d))
        return next(due for due in dues if due <= local).astimezone(dt.UTC)

    def due_within(self, tz: str, grace: dt.timedelta, now: dt.datetime) -> bool:
        return now - self.last_due(tz, now) <= grace


def swept(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs that still say running and started before the cutoff have failed."""
    return runs.withColumn("status", F.when((F.col("status") == "running") & (F.col("started_at") < cutoff), "failed").otherwise(F.col("status")))


def last_succeeded(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'succeeded'").groupBy("job").agg(F.max_by("due_at", "started_at").alias("due_at"))


def claim(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (job, due_at) that no run has claimed yet."""
    return wanted.join(runs.select("job", "due_at"), ["job", "due_at"], "left_anti")


def sent_today(messages: DataFrame, day: dt.date, tz: str) -> DataFrame:
    """Messages by recipient on a shop-local day."""
    return messages.filter(F.to_date(F.from_utc_timestamp("sent_at", tz)) == F.lit(day)).groupBy("recipient").agg(F.count("*").alias("sent"))


def replaced_drafts(orders: DataFrame, drafts: DataFrame) -> DataFrame:
    """An open draft of the same vendor (no vendor counts as one) is cancelled before the new drafts are added."""
    vendors = drafts.select(F.col("vendor_id").alias("__v"), F.lit(True).alias("__new")).distinct()
    both = orders.join(vendors, F.col("vendor_id").eqNullSafe(F.col("__v")), "left")
    gone = F.col("__new") & (F.col("status") == "draft")
    return both.withColumn("status", F.when(gone, "canceled").otherwise(F.col("status"))).select(*orders.columns).unionByName(drafts.select(*orders.columns))


def eval_summary(answers: DataFrame) -> DataFrame:
    """Share passed, mean cost and nearest-rank 95th percentile of seconds, by tenant."""
    return answers.groupBy("tenant").agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("passed"), F.round(F.avg("cost"), 4).cast("double").alias("mean_cost"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95_seconds"))
