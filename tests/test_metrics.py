"""Invariants of the metrics, and their values against the catalogue's SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument, CapabilityUnavailable, DateRange, Filters, Shop, resolve_name, resolve_period
from tallyspark.operators import inventory, sales, scopes
from tallyspark.plans import catalogue, tools
from tallyspark.plans.oracle import ORACLE
from tallyspark.sources import binding

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def shop(spark):
    return binding.shop(spark, DIR)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | dt.date):
        return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    return round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", ["sales_summary", "sales_series_week", "breakdown_location", "sales_filtered_category_tree", "margin_report", "customer_stats", "low_stock", "inventory_at", "weekly_units", "stockout_days", "stale_inventory", "markdown_ladder", "co_purchases", "tender_split", "daily_observations", "shrink", "map_modal_row", "upsert_last_wins", "customer_dedupe", "hybrid_rrf", "value_ledger"])
def test_against_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    cur = con.execute(ORACLE[name])
    order = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == want


def test_days_are_cut_in_the_shops_zone():
    low, high = DateRange(dt.date(2025, 11, 2), dt.date(2025, 11, 2)).bounds("America/New_York")
    assert (high - low) == dt.timedelta(hours=25) and low.hour == 4
    p = DateRange(dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    assert p.previous() == DateRange(dt.date(2024, 1, 30), dt.date(2024, 2, 29))
    assert resolve_period(dt.date(2024, 1, 31)).days == 30
    with pytest.raises(BadArgument):
        DateRange(dt.date(2024, 1, 2), dt.date(2024, 1, 1))


def test_filters_reach_the_scan(shop):
    plan = scopes.orders_in(shop, catalogue.DECEMBER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderdate" in plan.split("PushedFilters")[1]


def test_sources_add_up_and_net_is_what_is_left(shop):
    s = sales.sales_summary(shop, catalogue.YEAR).first()
    assert abs(s.gross_sales - s.discounts - s.refunds - s.net_sales) < 0.011
    rows = sales.breakdown(shop, catalogue.YEAR, "source").collect()
    assert abs(sum(r.net_sales for r in rows) - s.net_sales) < 0.05 and abs(sum(r["share"] for r in rows) - 1) < 1e-3


def test_series_has_every_bucket_once(shop):
    rows = sales.sales_series(shop, catalogue.DECEMBER, "day").collect()
    assert sorted(r.bucket for r in rows) == [dt.date(2000, 12, d) for d in range(1, 32)]


def test_low_and_dead_stock_are_disjoint(shop):
    low, dead = (f(shop, catalogue.AS_OF, limit=10_000) for f in (inventory.low_stock, inventory.dead_stock))
    assert low.join(dead, "variant_id").count() == 0


def test_merchandise_filter_leaves_no_refunds(shop):
    rows, caveats = scopes.refunds_in(shop, catalogue.YEAR, Filters(category_ids=("PROMO",)))
    assert rows.count() == 0 and caveats[0].code == "refunds_not_by_product"


def test_answers_carry_caveats(shop):
    asked = {"start": dt.date(1990, 1, 1), "end": dt.date(2030, 1, 1), "categories": ["promo"]}
    got = tools.answer(shop, catalogue.AS_OF, "sales_summary", asked)
    assert [c.code for c in got.caveats][:3] == ["starts_before_data", "ends_after_data", "refunds_not_by_product"] and got.frame.count() == 1
    assert (got.period.start, got.currency, got.timezone) == (dt.date(1990, 1, 1), shop.currency, shop.timezone)
    assert [c.code for c in tools.answer(shop, catalogue.AS_OF, "low_stock", {}).caveats] == ["low_stock_rule"]
    inside = {"start": dt.date(2000, 12, 1), "end": dt.date(2000, 12, 31)}
    codes = {n: [c.code for c in tools.answer(shop, catalogue.AS_OF, n, inside).caveats] for n in ("top_products", "margin_report", "customer_stats")}
    assert codes["top_products"] == ["breakdown_before_refunds"] and "margin_before_refunds" in codes["margin_report"]
    nobody = Shop(shop.frames | {"orders": shop.orders.withColumn("customer_id", F.lit(None).cast("long"))}, timezone=shop.timezone)
    assert [c.code for c in tools.answer(nobody, catalogue.AS_OF, "customer_stats", inside).caveats] == ["anonymous_sales"]


def test_refusals(shop):
    poor = Shop(shop.frames, capabilities=frozenset())
    with pytest.raises(CapabilityUnavailable):
        sales.margin_report(poor, catalogue.DECEMBER)
    assert "margin_report" not in tools.available(poor) and "margin_report" in tools.available(shop)
    with pytest.raises(BadArgument, match="no tool"):
        tools.call(shop, catalogue.AS_OF, "nothing", {})
    with pytest.raises(BadArgument, match="takes no"):
        tools.call(shop, catalogue.AS_OF, "low_stock", {"x": 1})
    assert tools.call(shop, catalogue.AS_OF, "sales_summary", {"start": dt.date(2000, 12, 1), "end": dt.date(2000, 12, 31)}).count() == 1
    assert resolve_name({"Main Street": 1, "Harbour": 2}, "main") == 1
    with pytest.raises(BadArgument, match="ambiguous"):
        resolve_name({"North": 1, "Northeast": 2}, "nort")


def test_chart_and_numbers():
    tools.check_chart({"type": "bar", "x": "k", "y": ["v"], "data": [{"k": "a", "v": 1.5}]}, {1.5}, {"a"})
    with pytest.raises(BadArgument):
        tools.check_chart({"type": "bar", "x": "k", "y": ["v"], "data": [{"k": "a", "v": 2}]}, {1.5}, {"a"})
    assert tools.unsupported_numbers("sales of $1,234.50 and 7", {1234.5}) == {7.0}


def test_caveats():
    p = DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert [c.code for c in sales.coverage_caveats((None, None), p)] == ["no_data"]
    assert [c.code for c in sales.coverage_caveats((dt.date(2024, 1, 5), dt.date(2024, 3, 1)), p)] == ["starts_before_data"]
    assert sales.custom_amount_caveat(5.0, 1000.0) is None and sales.custom_amount_caveat(10.0, 1000.0)


def test_descendants_end_in_a_cycle(spark):
    tree = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", None)], "id string, parent_id string")
    assert sorted(r.id for r in scopes.descendants(tree, ["a"]).collect()) == ["a", "b", "c"]


def test_refund_of_an_unsold_key_lowers_the_total_only(shop):
    assert sales.breakdown(shop, catalogue.QUARTER, "channel").filter(F.col("net_sales").isNull()).count() == 0
