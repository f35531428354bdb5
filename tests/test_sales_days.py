import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.operators import inventory, stale
from tallyspark.operators.sales_days import SalesDays
from tallyspark.plans.catalogue import AS_OF
from tallyspark.sources import binding

D = dt.timedelta


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_metrics_from_days_equal_those_from_lines(spark, tmp_path):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    kept = SalesDays(spark, str(tmp_path), again=20)
    with pytest.raises(BadArgument, match="no day"):
        kept.sales(shop, AS_OF)
    for through in (AS_OF - D(days=400), AS_OF - D(days=200), AS_OF - D(days=8)):
        kept.refresh(shop, through)
    assert kept.mark() == (AS_OF - D(days=8), AS_OF - D(days=28))
    for as_of in (AS_OF, AS_OF - D(days=8), AS_OF - D(days=25), AS_OF - D(days=120)):  # after, at and before what is taken in, and before what is settled
        assert _rows(inventory.dead_stock(shop, as_of, kept=kept)) == _rows(inventory.dead_stock(shop, as_of))
        assert sorted(_rows(stale.stale_rows(shop, as_of, kept))) == sorted(_rows(stale.stale_rows(shop, as_of)))
    assert _rows(inventory.catalog_page(shop, AS_OF, sort="last_sold", kept=kept)) == _rows(inventory.catalog_page(shop, AS_OF, sort="last_sold"))
    with pytest.raises(BadArgument, match="taken in already"):
        kept.refresh(shop, AS_OF - D(days=30))


def test_late_sales_and_cancellations(spark, tmp_path):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    kept = SalesDays(spark, str(tmp_path), again=60)
    kept.refresh(shop, AS_OF - D(days=30))
    # orders of the last days before that are cancelled, others turn up
    late = F.col("placed_at") >= F.lit(str(AS_OF - D(days=75))).cast("timestamp")
    orders = shop.orders.withColumn("status", F.when(late & (F.col("order_id") % 3 == 0), "canceled").when(late & (F.col("order_id") % 3 == 1), "open").otherwise(F.col("status")))
    changed = replace(shop, frames=shop.frames | {"orders": orders})
    kept.refresh(changed, AS_OF - D(days=5))
    assert sorted(_rows(stale.stale_rows(changed, AS_OF, kept))) == sorted(_rows(stale.stale_rows(changed, AS_OF)))


def test_only_the_months_of_the_windows_are_read(spark, tmp_path):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    kept = SalesDays(spark, str(tmp_path), again=20)
    kept.refresh(shop, AS_OF)
    months = len(kept.days.versions_at())
    files = kept.between(AS_OF - D(days=27), AS_OF).inputFiles()
    parts = {f.split("part=")[1].split("/")[0] for f in files}
    assert months > 60 and len(parts) <= 2
    assert not any("part-" in f and "/days/" in f and f.split("part=")[1].split("/")[0] not in parts for f in kept.sales(shop, AS_OF, sold=28).inputFiles())


def test_a_refresh_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    kept = SalesDays(spark, str(tmp_path), again=20)
    kept.refresh(shop, AS_OF - D(days=90))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(kept.marks, "merge", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        kept.refresh(shop, AS_OF - D(days=2))
    assert kept.mark()[0] == AS_OF - D(days=90)
    kept.refresh(shop, AS_OF - D(days=2))
    assert _rows(inventory.dead_stock(shop, AS_OF, kept=kept)) == _rows(inventory.dead_stock(shop, AS_OF))


def test_sums_are_not_searched_for_repeats(spark, tmp_path):
    """What is summed by variant and day has each key once, so no task sorts it to find the last of a key."""
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    kept = SalesDays(spark, str(tmp_path), again=20)
    plans = []
    for store in (kept.days, kept.last):
        store._write = lambda rows, n, *more, inner=store._write: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), inner(rows, n, *more))[1]
    kept.refresh(shop, AS_OF - D(days=40))
    assert len(plans) == 2 and not any("max_by" in p for p in plans)
