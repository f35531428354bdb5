"""As-of join: each row with the last value known at its time.

Rows and changes of a key are united and read in the order of time by a window that carries the last value on. A key's
history is cut into slices of time, so that a key with a large part of all rows is many groups; what a slice begins with,
the last value of the slices before it, comes from one value a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_DAYS = 30


def asof(rows: DataFrame, changes: DataFrame, key: str, at: str, changed_at: str, value: str, slice_days: int = SLICE_DAYS) -> DataFrame:
    """rows with `value`: that of the last change of their key at or before their time, null if there is none.

    Of changes of a key at the same time the largest value counts; a null value changes nothing. Rows without key or time
    have no value. A column `value` of rows is given up for the new one; clashing names of changes don't matter.
    """
    kept = [c for c in rows.columns if c != value]
    slice_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (slice_days * 86_400_000_000))
    named = changes.filter(F.col(key).isNotNull() & F.col(changed_at).isNotNull() & F.col(value).isNotNull())
    named = named.groupBy(F.col(key).alias("__key"), F.col(changed_at).cast("timestamp").alias("__at")).agg(F.max(value).alias("__value")).withColumn("__slice", slice_of("__at"))
    own = rows.select(F.struct(*kept).alias("__row"), F.col(key).alias("__key"), F.col(at).cast("timestamp").alias("__at"), slice_of(at).alias("__slice"))
    # a slice begins with the last value before it: the last change of each slice, carried over the slices that have rows or changes
    ends = named.groupBy("__key", "__slice").agg(F.max_by("__value", "__at").alias("__end"))
    there = own.filter("__key is not null and __slice is not null").select("__key", "__slice").distinct().join(ends, ["__key", "__slice"], "full_outer")
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = there.withColumn("__begin", F.last("__end", ignorenulls=True).over(before)).select("__key", "__slice", "__begin")
    both = own.withColumn("__value", F.lit(None).cast(named.schema["__value"].dataType)).unionByName(named.withColumn("__row", F.lit(None).cast(own.schema["__row"].dataType)))
    known = both.filter("__key is not null and __slice is not null")
    so_far = Window.partitionBy("__key", "__slice").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = known.withColumn("__last", F.last("__value", ignorenulls=True).over(so_far)).filter("__row is not null")
    found = found.join(begins, ["__key", "__slice"], "left").select("__row.*", F.coalesce("__last", "__begin").alias(value))
    odd = both.filter("__row is not null and (__key is null or __slice is null)").select("__row.*", F.col("__value").alias(value))
    return found.unionByName(odd)
