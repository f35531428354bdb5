"""What each variant sold on each local day, written and kept up by days, so that no metric scans all lines ever sold.

Two keyed stores: units and last sale by variant and day, in parts by month; and the last sale by variant up to the settled
day. refresh() takes in the days since the last one and sums the last AGAIN days anew, as late sales and cancellations
change them; days before those are settled. sales() reads the months of its windows, the last sales, and the lines of
the days after the last refresh.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.context import BadArgument, DateRange, Shop
from tallyspark.functions.numbers import total
from tallyspark.operators.scopes import sold_lines
from tallyspark.streaming.store import KeyedStore

AGAIN = 35
START = dt.date(1970, 1, 2)


def _month(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


class SalesDays:
    def __init__(self, spark: SparkSession, path: str, again: int = AGAIN):
        store = lambda name, columns, keys, **more: KeyedStore(spark, f"{path}/{name}", StructType.fromDDL(columns), keys, [keys[-1]], **more)
        self.again = again
        self.days = store("days", "variant_id bigint, day date, units decimal(24,4), last_sale timestamp, gone boolean", ["variant_id", "day"], deal=F.year("day") * 12 + F.month("day") - 1, gone="gone")
        self.last = store("last", "variant_id bigint, last_sale timestamp", ["variant_id"])
        self.marks = store("marks", "name string, through date, settled date", ["name"], parts=1)

    def mark(self) -> tuple[dt.date, dt.date] | None:
        """The last day taken in, and the last settled one."""
        row = self.marks.read().first()
        return (row.through, row.settled) if row else None

    def between(self, first: dt.date, last: dt.date) -> DataFrame:
        """Rows of the days from first to last, from their months alone."""
        months = [m for m in self.days.versions_at() if _month(first) <= m <= _month(last)]
        return self.days.read(parts=months, only=F.col("day").between(F.lit(first), F.lit(last))).drop("gone")

    @staticmethod
    def _summed(shop: Shop, period: DateRange) -> DataFrame:
        lines = sold_lines(shop, period, require_product=True)
        return lines.groupBy("variant_id", shop.local_day(F.col("placed_at")).alias("day")).agg(total("quantity").cast("decimal(24,4)").alias("units"), F.max("placed_at").alias("last_sale"))

    def refresh(self, shop: Shop, through: dt.date) -> None:
        """Take in the days up to `through`. What failed half way is done again by the next call."""
        known = self.mark()
        if known and through < known[0]:
            raise BadArgument(f"the days up to {known[0]} are taken in already")
        settled = known[1] if known else START - dt.timedelta(days=1)
        period = DateRange(settled + dt.timedelta(days=1), through)
        new = self._summed(shop, period)
        lost = self.between(period.start, period.end).join(new.select("variant_id", "day"), ["variant_id", "day"], "left_anti")
        self.days.merge(new.withColumn("gone", F.lit(False)).unionByName(lost.withColumn("gone", F.lit(True))), once=True)
        to = max(settled, through - dt.timedelta(days=self.again))
        if to > settled:
            self.last.merge(self.between(period.start, to).groupBy("variant_id").agg(F.max("last_sale").alias("last_sale")), once=True)
        self.marks.merge(shop.orders.sparkSession.createDataFrame([("sales", through, to)], self.marks.schema))

    def sales(self, shop: Shop, as_of: dt.date, **windows: int) -> DataFrame:
        """variant_id, last_sale, and for each window the units of so many days up to as_of."""
        known = self.mark()
        if not known:
            raise BadArgument("no day is taken in yet")
        through, settled = known
        whole = as_of < settled  # the last sales reach further than asked for
        first = min([START if whole else settled + dt.timedelta(days=1), *(as_of - dt.timedelta(days=n - 1) for n in windows.values())])
        rows = self.between(first, min(as_of, through)).select("variant_id", "day", "units", "last_sale")
        if as_of > through:
            rows = rows.unionByName(self._summed(shop, DateRange(through + dt.timedelta(days=1), as_of)))
        inside = lambda n: F.when(F.col("day") > F.lit(as_of - dt.timedelta(days=n)), F.col("units"))
        sums = rows.groupBy("variant_id").agg(F.max("last_sale").alias("__late"), *[total(inside(n)).alias(c) for c, n in windows.items()])
        if whole:
            return sums.withColumnRenamed("__late", "last_sale")
        both = sums.join(self.last.read(), "variant_id", "full_outer")
        return both.select("variant_id", F.greatest("__late", "last_sale").alias("last_sale"), *[F.coalesce(c, F.lit(0).cast("decimal(34,4)")).alias(c) for c in windows])
