import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.operators import anomaly, definitions, demand, inventory, retrieval, sales
from tallyspark.operators.knowledge import Knowledge, hashed
from tallyspark.plans import tools
from tallyspark.plans.catalogue import AS_OF, QUARTER
from tallyspark.sources import binding

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def shop(spark):
    return binding.shop(spark, DIR)


def _passages(spark, rows):
    return spark.createDataFrame(rows, "kind string, source_id long, chunk_index int, title string, content string")


def test_passages_are_searched_by_both_halves(spark, tmp_path, shop):
    rows = [("product", 1, 0, "Red mug", "A mug of clay, red."), ("product", 2, 0, "Blue bowl", "Blue bowl for soup"), ("document", 1, 0, "Returns", "Bring it back within ten days with the receipt."), ("document", 1, 1, "Returns", "Red tags are final sale."), ("document", 2, 0, None, ""), (None, 3, 0, "x", "y")]
    index = Knowledge(spark, str(tmp_path), parts=2, cells=2)
    assert index.update(_passages(spark, rows))["new"] == 5
    found = index.search("red mug", 3).collect()
    assert found[0].id == "product:1:0" and found[0].title == "Red mug" and found[0].text == "A mug of clay, red."
    assert [r.kind for r in index.search("red", 5, kind="document").collect()] == ["document"] * 2
    assert index.search("receipt", 1).first().id == "document:1:0"
    # another embedding is only asked for what changed
    asked = []
    index.embed = lambda c, f=index.embed: asked.append(1) or f(c)
    rows[1] = ("product", 2, 0, "Green bowl", "Green bowl for soup")
    del rows[2]
    assert index.update(_passages(spark, rows)) == {"new": 0, "changed": 1, "unchanged": 3, "orphan": 1}
    assert index.search("green", 1).first().title == "Green bowl" and index.search("receipt", 5, kind="document").filter("id = 'document:1:0'").count() == 0
    assert index.vectors.vectors.read().count() == 3  # a text without words has no vector
    with_search = replace(shop, knowledge=index)
    assert tools.call(with_search, AS_OF, "search_catalog", {"query": "green bowl", "limit": 1}).first().id == "product:2:0"
    assert {r.kind for r in tools.call(with_search, AS_OF, "search_catalog", {"query": "red", "kind": "document"}).collect()} == {"document"}
    assert tools.call(shop, AS_OF, "search_catalog", {"query": "sku-1", "limit": 2}).count() == 2
    with pytest.raises(BadArgument, match="kind goes with"):
        tools.call(shop, AS_OF, "search_catalog", {"query": "red", "kind": "document"})


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([("A b a",), ("",), (None,)], "t string").select(hashed(F.col("t"), 16).alias("v")).collect()
    assert [len(r.v) for r in rows] == [16] * 3 and sorted(rows[0].v)[-1] == 2.0 and sum(rows[0].v) == 3 and sum(rows[1].v) == sum(rows[2].v) == 0


def test_silent_while_orders_are_overdue(spark, shop):
    day = dt.date(1999, 10, 8)
    assert anomaly.health_at(shop, day).first().stale is False
    late = F.lit(str(day - dt.timedelta(days=4))).cast("timestamp")
    gap = replace(shop, frames=shop.frames | {"orders": shop.orders.filter((F.col("placed_at") < late) | (F.col("placed_at") > F.lit(str(day)).cast("timestamp") + F.expr("interval 2 days")))})
    assert anomaly.health_at(gap, day).first().stale is True  # orders after the day don't make up for it
    assert anomaly.sales_anomalies(gap, day, "low").count() == 0
    said = anomaly.detected(gap, day, ("stale_data", "sales_anomaly")).collect()
    assert [(r.kind, r.subject, r.severity) for r in said] == [("stale_data", "1999-10-08", "urgent")]
    none = replace(shop, frames=shop.frames | {"orders": shop.orders.limit(0)})
    assert anomaly.health_at(none, day).first().stale is True


def test_detectors_that_have_nothing_to_say(spark, shop):
    assert set(anomaly.DETECTORS) == {"sales_anomaly", "refund_spike", "shrink", "impossible_stock", "stale_data", "dead_stock", "reorder", "staffing"}
    empty = replace(shop, frames=shop.frames | {"levels": shop.levels.limit(0)})
    assert anomaly.detected(empty, AS_OF, ("dead_stock", "reorder", "staffing", "impossible_stock")).count() == 0
    schedules = {k: d.schedule.every if hasattr(d.schedule, "every") else str(d.schedule) for k, d in anomaly.DETECTORS.items()}
    assert "weekly" in schedules["dead_stock"] and "monthly" in schedules["staffing"] and "daily" in schedules["shrink"]


def test_labels(spark, shop):
    rows = sales.labelled(sales.breakdown(shop, QUARTER, "location"), shop, "location").collect()
    assert len(rows) == 10 and all(r.label and r.label != r.key for r in rows)
    odd = spark.createDataFrame([(None,), ("99",)], "key string")
    assert {r.label for r in sales.labelled(odd, shop, "location").collect()} == {"Unknown location"}
    assert [r.label for r in sales.labelled(odd, shop, "category").collect()] == ["Uncategorised", "99"]
    assert [r.label for r in sales.labelled(odd, shop, "source").collect()] == [None, "99"]
    with pytest.raises(BadArgument):
        sales.labelled(odd, shop, "colour")


def test_barcodes(spark, shop):
    one = shop.variants.orderBy("variant_id").first()
    found = inventory.catalog_page(shop, AS_OF, query=one.barcode).collect()
    assert [r.variant_id for r in found] == [one.variant_id]


def test_definitions(shop):
    assert len(definitions.DEFINITIONS) == 17
    assert {d.unit for d in definitions.DEFINITIONS.values()} == {"money", "count", "units", "percent", "days"}
    less = replace(shop, capabilities=shop.capabilities - {"has_costs"})
    assert set(definitions.computable(shop)) - set(definitions.computable(less)) == {"cogs", "gross_margin", "cost_coverage"}
    assert "gross sales - discounts - refunds" in tools.TOOLS["sales_summary"].description()
    assert tools.TOOLS["low_stock"].description().count("(") >= 2
    with pytest.raises(BadArgument, match="there is no metric"):
        definitions.definition("nothing")


def test_many_questions_find_what_each_finds_alone(spark, tmp_path):
    rows = [("product", i, 0, f"{c} {n}", f"{c} {n} of {m}") for i, (c, n, m) in enumerate((c, n, m) for c in ("red", "blue", "green") for n in ("mug", "bowl") for m in ("clay", "steel"))]
    index = Knowledge(spark, str(tmp_path), parts=2, cells=3)
    index.update(_passages(spark, rows))
    asked = {"a": "red clay", "b": "mug", "c": "steel zebra", "d": "", "e": "nothing here", "f": "blue blue bowl"}
    questions = spark.createDataFrame(list(asked.items()), "question_id string, query string")
    many = index.search_many(questions, 5).collect()
    texts = index.texts.search_many(questions, 30).collect()
    for q, query in asked.items():
        alone = [r.doc_id for r in index.texts.search(query, 30).collect()]
        assert [r.doc_id for r in sorted((r for r in texts if r.question_id == q), key=lambda r: r.rank)] == alone
        hybrid = [r.id for r in sorted((r for r in many if r.question_id == q and r.mode == "hybrid"), key=lambda r: r.rank)]
        assert hybrid == [r.id for r in index.hits(query, 5).collect()]
    golden = spark.createDataFrame([("a", "red clay", "Red"), ("b", "bowl of steel", "bowl"), ("c", "nothing", "red")], "question_id string, query string, expected string")
    rates = {r["mode"]: (r.questions, r.hits, r.hit_rate) for r in index.evaluate(golden).collect()}
    assert rates["text"] == (3, 2, 0.6667) and set(rates) == {"vector", "text", "hybrid"} and all(n == 3 for n, _, _ in rates.values())
    empty = Knowledge(spark, str(tmp_path / "none"), parts=1)
    assert empty.search_many(questions).collect() == [] and empty.search("red").collect() == []


def test_passages_keep_their_own_metadata(spark):
    docs = spark.createDataFrame([(1, "First text.", "One", "a", None), (1, "Second text.", "Two", None, 5), (2, "", "Three", "b", 1), (3, "Third", " ", "c", 2)], "doc_id long, text string, name string, kind string, n int")
    rows = retrieval.passages(docs, "name", ["kind", "n"]).collect()
    assert sorted((r.doc_id, r.content, sorted(r.metadata.items())) for r in rows) == [(1, "One\n\nFirst text.", [("kind", "a")]), (1, "Two\n\nSecond text.", [("n", "5")]), (3, "Third", [("kind", "c"), ("n", "2")])]
    assert retrieval.passages(docs, "name", []).first().metadata == {}
    assert {r.doc_id: r.chunks for r in retrieval.chunk_counts(retrieval.passages(docs, "name", [])).collect()} == {1: 2, 3: 1}


def test_references_of_orders(spark):
    orders = spark.createDataFrame([("PO-2024-03-0001",), ("PO-2024-03-0007",), ("PO-2024-02-0044",), (None,)], "reference string")
    assert demand.next_reference(orders, dt.date(2024, 3, 9)) == "PO-2024-03-0003"  # the month's third
    assert demand.next_reference(orders, dt.date(2024, 4, 9)) == "PO-2024-04-0001"
