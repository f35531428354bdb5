"""Rules of forecasts, detectors, sync, mapping, retrieval and ledger on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.functions import transforms as tr
from tallyspark.operators import anomaly, demand, ledger, mapping, retrieval, scopes, stale, sync
from tallyspark.plans import tools
from tallyspark.sources import binding
from tallyspark.streaming import upserts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_forecast_rules(spark):
    L = F.lit
    weeks = [L(4.0), L(4.0), L(4.0), L(4.0)]
    assert one(spark, demand.velocity(weeks, L(0))) == 0.571
    assert one(spark, demand.velocity(weeks, L(14))) == 1.143
    assert one(spark, demand.seasonal(L(100.0), L(100.0))) == 2.5 and one(spark, demand.seasonal(L(0.0), L(0.0))) == 1.0
    assert one(spark, demand.rounded_to_pack(L(7.0), L(6.0), L(0.0))) == 12 and one(spark, demand.rounded_to_pack(L(1.0), L(6.0), L(20.0))) == 24
    assert one(spark, demand.rounded_to_pack(L(-1.0), L(6.0), L(20.0))) == 0
    assert one(spark, demand.skip_reason(L("Used Games"), L(3.0))) == "one-off inventory"
    assert one(spark, stale.bundle_price(F.lit(10).cast("decimal(14,4)"), F.lit(12).cast("decimal(14,4)"))) == 19.99


def test_planted_anomaly_is_found_and_a_quiet_stretch_is_silent(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), 1, 1000.0 + (i * 37 % 50), 10, False) for i in range(70)]
    quiet = spark.createDataFrame(rows, "day date, location_id int, net_sales double, orders int, is_event boolean")
    base = anomaly.weekday_baselines(quiet, start + dt.timedelta(days=63), 9)
    assert base.count() == 7 and all(r.observations == 9 and 1000 <= r.median <= 1050 for r in base.collect())
    spread = base.first()
    assert spread.spread_below >= 0 and spread.spread_above >= 0


def test_upsert_sweep_and_watermark(spark, tmp_path):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    once = sync.upsert(target, changes, ["id"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, sync.upsert(once, changes, ["id"], ["seq"]).collect())) == sorted(map(tuple, once.collect()))
    rows = target.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    at = F.lit("2024-01-01").cast("timestamp")
    assert sync.sweep(rows, target.filter("id = 1"), ["id"], at).filter("deleted_at is not null").first().id == 2
    assert sync.sweep(rows, target.limit(0), ["id"], at).filter("deleted_at is not null").count() == 0
    old = spark.createDataFrame([(5,)], "watermark int")
    assert sync.watermark(target.limit(0), "id", old).first().watermark == 5
    assert sync.resolved(spark.createDataFrame([("x",), ("y",)], "ext string"), spark.createDataFrame([("x", 1)], "external_id string, id int"), "ext", "pid", True).count() == 1


def test_stream_merges_each_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int").coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("id int, v string, seq int").parquet(source)
    run = lambda: upserts.merged_stream(read(), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], ["seq"]).awaitTermination()
    run()
    spark.createDataFrame([(2, "c", 2)], "id int, v string, seq int").coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/batch=1").collect())) == [(1, "a", 1), (2, "c", 2)]


def test_stream_rewrites_only_the_parts_of_a_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, v string, seq int"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: upserts.merged_stream(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"), ["id"], ["seq"], parts=8).awaitTermination()
    add([(i, "a", 1) for i in range(100)])
    run()
    add([(2, "c", 2), (2, "b", 3), (None, "n", 1), (200, "new", 1)])
    run()
    add([(3, "d", 2)])
    run()
    like = spark.createDataFrame([], schema)
    want = {i: "a" for i in range(100)} | {2: "b", None: "n", 200: "new", 3: "d"}
    got = upserts.state(like, out).collect()
    assert len(got) == len(want) and {r.id: r.v for r in got} == want
    assert spark.read.parquet(f"{out}/batch=2").select("part").distinct().count() == 1


def test_duplicates_over_chains(spark):
    d = dt.date
    rows = [(1, "A@x.io", None, d(2020, 1, 3)), (2, "a@x.io ", "555-123-4567", d(2020, 1, 2)), (3, None, "1 (555) 123-4567", d(2020, 1, 1)), (4, "b@x.io", None, d(2020, 1, 1)), (5, "junk", "12", d(2019, 1, 1))]
    got = sync.duplicates(spark.createDataFrame(rows, "customer_id int, email string, phone string, created_on date"))
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3)]


def test_transforms(spark):
    L = F.lit
    check = lambda c, want: one(spark, c) == want
    assert check(tr.parse_money(L(" $1,234.50 ")).cast("double"), 1234.5) and check(tr.parse_money(L("(5.00)")).cast("double"), -5.0)
    assert one(spark, tr.parse_money(L("n/a"))) is None and one(spark, tr.money_error(L("abc"))) and not one(spark, tr.money_error(L("-")))
    assert check(tr.parse_date(L("3/7/25")), dt.date(2025, 3, 7)) and check(tr.parse_date(L("31/12/2024")), dt.date(2024, 12, 31)) and one(spark, tr.parse_date(L("soon"))) is None
    assert check(tr.split_name(L("Last, First  M"), "last"), "Last") and check(tr.split_name(L("Only"), "last"), None) and check(tr.split_name(L("Only")), "Only")
    assert check(tr.to_int(L("7.9")), 7) and check(tr.cents_to_dollars(L(1234)).cast("double"), 12.34) and check(tr.default(L(" "), "x"), "x")
    assert one(spark, tr.hash_id(L(" "), "p")) is None and one(spark, tr.hash_id(L(" Ab  c"), "p")) == one(spark, tr.hash_id(L("aB C"), "p"))
    with pytest.raises(tr.UnknownTransform, match="price"):
        tr.apply_transforms(L(1), ["nope"], "price")


def test_mapping_spec(spark):
    spec = mapping.MappingSpec.parse({"product": {"group_by": "name", "skip_when_blank": ["name"], "fields": {"id": {"group_key": True, "transforms": [{"hash_id": {"prefix": "p-"}}]}, "label": {"column": "name", "transforms": ["trim"]}, "line": {"row_number": True}, "kind": {"constant": "x"}}}})
    rows = spark.createDataFrame([("S", 1, " A  b"), ("S", 2, " ")], "sheet string, row int, name string")
    got = mapping.records(rows, spec.entities["product"]).collect()
    assert [(r.label, r.line, r["kind"]) for r in got] == [("A b", "S:1", "x")] and got[0].id.startswith("p-")
    with pytest.raises(Exception, match="nope"):
        mapping.MappingSpec.parse({"e": {"fields": {}, "nope": 1}})


def test_mapping_file(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("""
source: shop
workbook: a.xlsx
capabilities: {has_costs: true}
settings: {assumed_time_of_day: "18:30", timezone: America/New_York}
sheets: {Sales: {match: "Sales .*"}, Items: {match: Items}}
entities:
  location: {constant: [{name: x}]}
  item: {from: Sales, distinct_by: {column: item, transforms: [fold_key]}, fields: {name: {column: item, transforms: [trim]}, note: blank}}
  order: {from: Sales, group_by: {column: day}, fields: {id: day}, lines: {fields: {id: {concat: [{group_key: true}, {constant: ":"}, {column: item, transforms: [fold_key]}]}}}}
  line:
    from: Sales
    fields:
      item: item
      cost: {lookup: {sheet: Items, key: name, value: cost, match_on: item}, transforms: [parse_money]}
      code: {concat: [{column: day}, {column: blank}, {lookup: {sheet: Items, key: name, value: cost, match_on: item}}], separator: "/"}
      at: {column: day, transforms: [parse_date, at_time]}
""")
    spec = mapping.MappingSpec.load(str(tmp_path / "m.yaml"))
    assert (spec.source, spec.display_name, spec.capabilities, list(spec.entities)) == ("shop", "shop", {"has_costs": True}, ["location", "item", "order", "line"])
    rows = spark.createDataFrame([("S", 1, " a  B", "2024-01-05", None), ("S", 2, " ", "2024-01-06", "x")], "sheet string, row int, item string, day string, blank string")
    items = spark.createDataFrame([(2, "A b", "$9"), (1, "a b", "$2"), (3, " ", "$7")], "row int, name string, cost string")
    got = sorted(mapping.records(rows, spec.entities["line"], sheets={"Items": items}).collect(), key=lambda r: r.code)
    assert [(None if r.cost is None else float(r.cost), r.code, str(r["at"])) for r in got] == [(2.0, "2024-01-05//$2", "2024-01-05 23:30:00"), (None, "2024-01-06/x/", "2024-01-06 23:30:00")]
    more = rows.unionByName(spark.createDataFrame([("S", 3, "A b ", "2024-01-05", "y")], rows.schema))
    items_found = mapping.records(mapping.distinct_rows(more, spec.entities["item"]), spec.entities["item"]).collect()
    assert sorted((r["name"] or "", r.note) for r in items_found) == [("", "x"), ("a B", "y")] and spec.entities["location"].constants == ({"name": "x"},)
    ids = [r.id for r in mapping.line_records(more, spec.entities["order"]).collect()]
    assert sorted(ids) == sorted(["2024-01-05:a b", "2024-01-05:a b", "2024-01-06:"])
    with pytest.raises(Exception, match="Items"):
        mapping.records(rows, spec.entities["line"])
    for text, error in (("source: a", "workbook"), ("{source: a, workbook: b, capabilities: {}, entities: {e: {from: S, fields: {x: y}}}}", "no sheet 'S'"), ("{source: a, workbook: b, capabilities: {}, entities: {e: {fields: {x: {transforms: []}}}}}", "e.x: no source")):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(Exception, match=error):
            mapping.MappingSpec.load(str(tmp_path / "bad.yaml"))


def test_chunking():
    text = "One two three. " * 400 + "\n\n" + "x" * 4500
    parts = retrieval.split_text(text)
    assert all(len(p) <= retrieval.CHUNK + retrieval.OVERLAP + 1 for p in parts) and len(parts) > 4 and retrieval.split_text("") == []
    assert retrieval.split_text("short") == ["short"]


def test_batches_and_vector_length(spark):
    items = spark.createDataFrame([(i, 50) for i in range(10)], "id int, size int").coalesce(1)
    assert {r.batch for r in retrieval.batches(items, "size", 4, 1000).collect()} == {0, 1, 2} and {r.batch for r in retrieval.batches(items, "size", 99, 100).collect()} == set(range(5))
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="2 components"):
        retrieval.checked(v, 2).collect()


def test_insights_keep_what_the_user_did(spark):
    schema = "dedupe_key string, kind string, status string, rating int, snoozed_until timestamp, created_at timestamp, dollar_impact double"
    t = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "k", "dismissed", 1, None, t, 5.0)], schema)
    drafts = spark.createDataFrame([("a", "k", "new", None, None, dt.datetime(2024, 2, 1), 9.0), ("b", "k", "new", None, None, t, 1.0)], schema)
    got = {r.dedupe_key: r for r in ledger.record(stored, drafts).collect()}
    assert (got["a"].status, got["a"].rating, got["a"].dollar_impact, got["a"].created_at) == ("dismissed", 1, 9.0, t) and got["b"].status == "new"


def test_delivery_policy(spark):
    rows = spark.createDataFrame([("a", True, "info", 30, 1320, 420, 0), ("b", True, "urgent", 30, 1320, 420, 9), ("c", True, "info", 600, 1320, 420, 3), ("d", False, "urgent", 600, 1320, 420, 0), ("e", True, "warn", 600, 1320, 420, 2)], "recipient string, enabled boolean, severity string, minute int, quiet_start int, quiet_end int, sent_today int")
    assert {r.recipient: r.suppressed for r in ledger.delivery(rows).collect()} == {"a": "quiet_hours", "b": None, "c": "daily_cap", "d": "channel_off", "e": None}


def test_a_customer_without_a_date_is_no_survivor(spark):
    rows = [(1, "a@b.c", None, None), (2, "a@b.c", None, dt.date(2020, 1, 1)), (3, "x@y.z", None, None), (4, "x@y.z", None, None)]
    found = sync.duplicates(spark.createDataFrame(rows, "customer_id long, email string, phone string, created_on date"))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (4, 3)]


def test_descendants_at_any_depth_and_in_cycles(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(12)] + [("a", "c"), ("b", "a"), ("c", "b")]
    tree = spark.createDataFrame(chain, "id string, parent_id string")
    assert {r.id for r in scopes.descendants(tree, ["3"]).collect()} == {str(i) for i in range(3, 12)}
    assert sorted(r.id for r in scopes.descendants(tree, ["a"]).collect()) == ["a", "b", "c"]
    assert scopes.descendants(tree, ["none"]).count() == 0


def test_passages_have_title_and_metadata(spark):
    docs = spark.createDataFrame([(1, "word " * 900, "Title", "en", None), (2, "short", None, "de", "s"), (3, None, "T", None, None)], "doc_id long, text string, title string, lang string, source string")
    found = sorted(retrieval.passages(docs, "title", ["lang", "source"]).collect(), key=lambda r: (r.doc_id, r.chunk_index))
    assert [(r.doc_id, r.chunk_index) for r in found] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert all(r.content.startswith("Title\n\n") and r.metadata == {"lang": "en"} for r in found[:3])
    assert found[3].content == "short" and found[3].metadata == {"lang": "de", "source": "s"}


def test_text_search_keeps_full_matches_only_if_there_are_some(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "fox fox"), (4, "red fox den")], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.text_search(docs, "red fox").collect()] == [1, 4]
    assert [r.doc_id for r in retrieval.text_search(docs, "red fox", 1).collect()] == [1]
    assert sorted(r.doc_id for r in retrieval.text_search(docs, "fox zzz").collect()) == [1, 3, 4]
    assert retrieval.text_search(docs, "zzz").count() == 0


def test_detectors_register_once_and_are_named(spark):
    with pytest.raises(BadArgument):
        anomaly.register(anomaly.DETECTORS["shrink"])
    with pytest.raises(BadArgument):
        anomaly.detected(None, dt.date(2001, 8, 1), ("nothing",))


def test_search_catalog_takes_names(spark):
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    name = shop.locations.filter("location_id = 1").first().name
    found = tools.call(shop, dt.date(2001, 8, 1), "search_catalog", {"query": "sku-1", "locations": [name.lower()], "limit": 5})
    rows = found.collect()
    assert len(rows) == 5 and rows[0].truncated and rows[0].total_rows > 5 and all(r.stock is None or r.stock.startswith("1=") for r in rows)
    with pytest.raises(BadArgument):
        tools.call(shop, dt.date(2001, 8, 1), "sales_summary", {"locations": ["nowhere"]})


def test_purchase_orders_nest_their_lines(spark):
    lines = [("A", 1, 10, "draft", 2.0, 0.0, 3.0), ("A", 1, 9, "sent", 1.0, 0.0, None), ("B", 2, 8, "canceled", 5.0, 0.0, 1.0)]
    lines = spark.createDataFrame(lines, "reference string, vendor_id long, variant_id long, status string, quantity double, received double, price double")
    vendors = spark.createDataFrame([(1, "V")], "vendor_id long, name string")
    (row,) = demand.purchase_orders(lines, vendors).collect()
    assert (row.vendor, row.n_lines, row.units, row.value, row.unpriced, [x.variant_id for x in row.lines]) == ("V", 2, 3.0, 6.0, 1, [9, 10])
    assert demand.purchase_orders(lines, vendors, canceled=True).count() == 2
