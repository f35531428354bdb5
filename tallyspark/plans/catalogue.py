"""The query catalogue: each operator over the bound star schema, with fixed periods so that results repeat."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Filters, Shop
from tallyspark.functions import transforms as tr
from tallyspark.functions.numbers import units
from tallyspark.operators import anomaly, demand, finance, inventory, jobs, ledger, mapping, retrieval, sales, scopes, staffing, stale, sync
from tallyspark.sources import binding

D = dt.date
AS_OF, MOVES_AS_OF = D(2001, 8, 1), D(2024, 1, 30)
#: A day in whose week sales are off, and vectors that are asked for.
ANOMALY_DAY, ASKED = D(1999, 10, 8), (7, 107, 207)
DECEMBER, QUARTER, YEAR = DateRange(D(2000, 12, 1), D(2000, 12, 31)), DateRange(D(2000, 10, 1), D(2000, 12, 31)), DateRange(D(2000, 1, 1), D(2000, 12, 31))
Query = Callable[[SparkSession, str], DataFrame]


def _shop(f: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, d: f(binding.shop(spark, d))


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/{name}.parquet"))


def _tree(shop: Shop) -> DataFrame:
    ids = scopes.descendants(shop.tree, ["R1", "N3"]).filter("id like 'N%'").select(F.substring("id", 2, 9).cast("int").alias("location_id"))
    lines = scopes.sold_lines(shop, DECEMBER).join(ids, "location_id", "left_semi")
    return lines.groupBy("location_id").agg(F.round(F.sum("gross"), 2).cast("double").alias("gross_sales"), F.countDistinct("order_id").alias("orders"))


def _purchase_lines(shop: Shop) -> DataFrame:
    rows = shop.terms.filter("is_primary").select("variant_id", "vendor_id")
    v = F.col("variant_id")
    status = F.when(v % 4 == 0, "draft").when(v % 4 == 1, "sent").when(v % 4 == 2, "received").otherwise("canceled")
    rows = rows.withColumns({"status": status, "quantity": (v % 30 + 1).cast("double"), "reference": F.concat(F.lit("PO-2001-07-"), F.lpad(F.col("vendor_id").cast("string"), 4, "0"))})
    return rows.withColumns({"received": F.when(status == "received", F.col("quantity")).when(status == "sent", F.floor(F.col("quantity") / 2).cast("double")).otherwise(0.0), "on_hand_at_draft": (v % 5).cast("double")}).join(shop.variants.select("variant_id", units("price").alias("price")), "variant_id")


def _purchase_orders(shop: Shop) -> DataFrame:
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["variant_id"].cast("string"), x["status"], x["quantity"].cast("int").cast("string"))), ";")
    return demand.purchase_orders(_purchase_lines(shop), shop.vendors).withColumn("lines", text)


def _insights(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return events.select(
        F.concat(F.lit("k"), i.cast("string")).alias("dedupe_key"), F.col("event_type").alias("kind"), F.when(i % 7 == 0, "urgent").when(i % 3 == 0, "warn").otherwise("info").alias("severity"), F.when(i % 5 != 0, F.round("value", 2)).alias("dollar_impact"),
        F.when(i % 6 == 0, "acted").when(i % 11 == 0, "dismissed").otherwise("new").alias("status"), F.col("ts").cast("timestamp").alias("created_at"), F.when(i % 4 == 0, F.col("ts").cast("timestamp") + F.expr("interval 20 days")).alias("expires_at"),
        F.when(i % 13 == 0, F.lit("2024-02-10").cast("timestamp")).alias("snoozed_until"), F.when(i % 9 == 0, (i % 2).cast("int")).alias("rating"),
    )


def _now():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def _ledger(events: DataFrame) -> DataFrame:
    rows = _insights(events)
    outcomes = rows.filter("status = 'acted'").select("dedupe_key", (F.col("dollar_impact") / 2).alias("attributed"))
    return ledger.value_ledger(rows, outcomes, F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-22").cast("timestamp"))


def _rung_up(shop: Shop) -> DataFrame:
    return sales.variant_sales(shop, DateRange.last(14, AS_OF)).select("variant_id", "units_sold")


def _two_places(shop: Shop) -> Shop:
    """The same shop at two locations, so that each weekday has sales enough to judge by."""
    return replace(shop, frames=shop.frames | {"orders": shop.orders.withColumn("location_id", F.col("location_id") % 2)})


def _recounted(shop: Shop) -> Shop:
    """The same shop after a count that found less on every shelf, so that some variants are below nothing."""
    return replace(shop, frames=shop.frames | {"levels": shop.levels.withColumn("on_hand", F.col("on_hand") - 30)})


def _rescue_outcome(shop: Shop) -> DataFrame:
    actions = shop.variants.filter("variant_id % 9 = 0").select("variant_id", F.lit("markdown").alias("kind"), (F.col("variant_id") % 20).cast("double").alias("on_hand_before"), units("cost").alias("unit_cost"))
    taken = D(2001, 7, 1)
    before = sales.variant_sales(shop, DateRange(taken - dt.timedelta(days=30), taken - dt.timedelta(days=1)))
    return stale.rescue_outcome(actions, before, sales.variant_sales(shop, DateRange(taken, taken + dt.timedelta(days=29))))


def _observed(shop: Shop) -> DataFrame:
    rota = shop.locations.select("location_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"), F.lit(17).alias("start_hour"), F.lit(21).alias("end_hour"), (F.col("location_id") % 3 + 1).alias("staff"))
    return staffing.observe(staffing.heatmap(shop, AS_OF), rota)


def _baselines(shop: Shop) -> DataFrame:
    return anomaly.weekday_baselines(anomaly.daily_observations(shop, DateRange(AS_OF - dt.timedelta(weeks=30), AS_OF)), AS_OF, 30)


def _sheet(events: DataFrame) -> DataFrame:
    """A messy export: keys in several spellings, amounts as text, blanks."""
    i = F.col("event_id")
    return events.select(
        F.lit("Sales").alias("sheet"), i.alias("row"), F.when(i % 17 != 0, F.concat(F.lit("  R"), (i % 400).cast("string"), F.when(i % 2 == 0, " a ").otherwise(" A"))).alias("receipt"), F.when(i % 3 == 0, F.concat(F.lit("$"), F.format_number(F.round("value", 2), 2))).when(i % 3 == 1, F.concat(F.lit("("), F.round("value", 2).cast("decimal(12,2)").cast("string"), F.lit(")"))).when(i % 5 == 0, "n/a").otherwise(F.round("value", 2).cast("decimal(12,2)").cast("string")).alias("amount"),
        F.when(i % 4 == 0, F.date_format("ts", "M/d/yy")).when(i % 4 == 1, F.date_format("ts", "M/d/yyyy")).when(i % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("date"), F.when(i % 3 == 0, F.concat(F.lit("Last"), i.cast("string"), F.lit(", First  X"))).when(i % 3 == 1, F.concat(F.lit("First Last"), i.cast("string"))).otherwise("Single").alias("who"),
        F.when(i % 9 != 0, F.col("event_type")).otherwise(" ").alias("category"), (i % 4 + 1).cast("decimal(14,4)").alias("quantity"), F.round("value", 2).cast("decimal(14,4)").alias("price"), F.lit(0.5).cast("decimal(14,4)").alias("discount"),
    )


def _modal(sheet: DataFrame) -> DataFrame:
    return mapping.modal_row(mapping.group_key(sheet, "receipt"), "group_key", ["category", "who"], "row")


def _looked_up(sheet: DataFrame) -> DataFrame:
    table = sheet.filter("row % 5 = 0").select(F.col("receipt").alias("k"), F.col("category").alias("v"), F.col("row").alias("o")).filter("k is not null")
    return mapping.lookup(sheet.select("row", "receipt"), "receipt", table, "k", "v", "o", "found").select("row", "found")


def _from_lines(sheet: DataFrame) -> DataFrame:
    return mapping.orders_from_lines(mapping.group_key(sheet, "receipt").withColumn("line_no", F.col("row"))).withColumn("lines", F.array_join("lines", ","))


def _upserted(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    target = orders.filter(key % 10 < 8).select(key.alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("note"))
    changes = orders.filter(key % 10 >= 7).select(key.alias("id"), (F.col("o_totalprice") + 1).alias("total"), F.lit("first").alias("note"), F.lit(1).alias("seq"))
    changes = changes.unionByName(changes.withColumns({"total": F.col("total") + 1, "note": F.lit("second"), "seq": F.lit(2)}))
    return sync.upsert(target, changes, ["id"], ["seq"])


def _swept(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    out = sync.sweep(rows, rows.filter("id % 6 <> 0"), ["id"], F.lit("2001-08-01").cast("timestamp"))
    return out.groupBy(F.col("deleted_at").isNotNull().alias("deleted")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _raw(orders: DataFrame) -> DataFrame:
    keyed = orders.select((F.col("o_orderkey") % 500).alias("external_id"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return sync.latest(keyed, ["external_id"], ["o_orderdate", "o_orderkey"]).select("external_id", "o_orderkey", "o_orderstatus")


def _vector(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return retrieval.vector_search(rows.filter("vec_id <> 7"), list(rows.filter("vec_id = 7").first().embedding), 10)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    vector = retrieval.vector_search(rows, list(rows.filter("vec_id = 7").first().embedding))
    return retrieval.hybrid(vector, retrieval.text_search(binding.documents(spark, d), "the and est"))


def _diff(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.sha2(F.concat(F.lit("m"), F.lit("\0"), "text"), 256).alias("content_hash"))
    stored = rows.filter("doc_id % 10 <> 1").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 2, "old").otherwise(F.col("content_hash")))
    return retrieval.ingest_diff(stored, rows.filter("doc_id % 10 <> 3")).groupBy("action").agg(F.count("*").alias("n"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether vector search finds a document in the asked one's language."""
    rows, docs = spark.read.parquet(f"{d}/embeddings.parquet"), binding.documents(spark, d).select("doc_id", "lang")
    found = None
    for q in ASKED:
        hits = retrieval.vector_search(rows.filter(F.col("vec_id") != q), list(rows.filter(F.col("vec_id") == q).first().embedding), 5)
        placed = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))).withColumn("question_id", F.lit(q))  # of 5 rows
        found = placed if found is None else found.unionByName(placed)
    titled = found.join(docs, F.col("vec_id") == F.col("doc_id")).select("question_id", "rank", F.col("lang").alias("title"))
    return retrieval.hit_at_k(docs.filter(F.col("doc_id").isin(*ASKED)).select(F.col("doc_id").alias("question_id"), F.col("lang").alias("expected")), titled, 5)


def _dims(shop: Shop) -> DataFrame:
    return shop.orders.filter("status <> 'canceled'").groupBy("channel").agg(F.count("*").alias("orders"))


def _answers(events: DataFrame) -> DataFrame:
    """An evaluation's answers: did it pass, what it cost, how long it took."""
    return events.select(F.col("event_type").alias("tenant"), (F.col("event_id") % 5 != 0).alias("passed"), F.round(F.col("value") / 1000, 3).cast("decimal(12,3)").alias("cost"), F.round("value", 2).alias("seconds"))


def _runs(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "running").when(i % 3 == 1, "succeeded").otherwise("failed")
    return events.select(F.col("event_type").alias("job"), F.col("ts").cast("timestamp").alias("started_at"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("due_at"), status.alias("status"), i.alias("run_id"))


def _last_succeeded(events: DataFrame) -> DataFrame:
    return jobs.last_succeeded(_runs(events)).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


def _claims(events: DataFrame) -> DataFrame:
    wanted = _runs(events).select("job").distinct().crossJoin(events.sparkSession.range(60).select(F.date_add(F.lit("2023-12-20").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("due_at")))
    return jobs.claim(_runs(events), wanted).select("job", F.col("due_at").cast("date").alias("due_on"))


def _drafts(shop: Shop) -> DataFrame:
    rows = _purchase_lines(shop).groupBy("reference", "vendor_id").agg(F.min("status").alias("status"))
    new = rows.filter("vendor_id % 3 = 0").select(F.concat("reference", F.lit("-new")).alias("reference"), "vendor_id", F.lit("draft").alias("status"))
    return jobs.replaced_drafts(rows, new)


def _resolved(spark: SparkSession, d: str, required: bool) -> DataFrame:
    """Orders whose customer is known by an external id; customers of one nation are missing."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("customer"))
    parents = spark.read.parquet(f"{d}/customer.parquet").filter("c_nationkey <> 3").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("external_id"), F.col("c_custkey").alias("id"))
    return sync.resolved(orders, parents, "customer", "customer_id", required).groupBy("customer_id").agg(F.count("*").alias("orders"))


def _recorded(events: DataFrame) -> DataFrame:
    rows = _insights(events)
    drafts = rows.filter(F.substring("dedupe_key", 2, 20).cast("long") % 2 == 0)
    found = drafts.withColumns({"severity": F.lit("urgent"), "dollar_impact": F.lit(1.5), "status": F.lit("new"), "rating": F.lit(None).cast("int"), "snoozed_until": F.lit(None).cast("timestamp")})
    stored = rows.filter(F.substring("dedupe_key", 2, 20).cast("long") % 3 != 0)
    return ledger.record(stored, found).groupBy("severity", "status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("dollar_impact").cast("decimal(14,2)")), 2).cast("double").alias("impact"), F.count("rating").alias("rated"))


def _deliveries(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    rows = events.select(i.alias("message_id"), F.col("user_id").alias("recipient"), (i % 8 != 0).alias("enabled"), F.when(i % 7 == 0, "urgent").otherwise("warn").alias("severity"), (i * 37 % 1440).alias("minute"), F.lit(1320).alias("quiet_start"), F.lit(420).alias("quiet_end"), (i % 5).alias("sent_today"))
    return ledger.delivery(rows).select("message_id", "suppressed")


def _scalars(events: DataFrame) -> DataFrame:
    """Cents, decimals, whole numbers and defaults, by steps as a mapping names them."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit(" "), F.round("value", 2).cast("decimal(12,2)").cast("string"), F.lit(" "))).when(i % 4 == 1, F.lit("  ")).when(i % 4 == 2, F.lit("junk")).otherwise(i.cast("string"))
    at = lambda *steps: tr.apply_transforms(text, list(steps), "amount")
    return events.select(
        i.alias("row"), units(tr.cents_to_dollars(i)).alias("dollars"), units(at("to_decimal")).alias("decimal"), at("to_int").alias("whole"), at({"default": {"to": "none"}}, "trim", "upper").alias("named")
    )


def _page(shop: Shop) -> DataFrame:
    return inventory.keyset_page(shop.orders.select("placed_at", "order_id", "status"), "placed_at", "order_id", (dt.datetime(1998, 1, 1), 100), 20).select("order_id", "status")


QUERIES: dict[str, Query] = {
    "sales_summary": _shop(lambda s: sales.sales_summary(s, DECEMBER)),
    "sales_summary_filtered": _shop(lambda s: sales.sales_summary(s, QUARTER, Filters(channels=("online", "event"), sources=("reg1",)))),
    "sales_summary_category": _shop(lambda s: sales.sales_summary(s, QUARTER, Filters(category_ids=("PROMO",)))),
    **{f"sales_series_{g}": _shop(lambda s, g=g, p=p: sales.sales_series(s, p, g)) for g, p in (("day", DECEMBER), ("week", QUARTER), ("month", YEAR))},
    **{f"breakdown_{x}": _shop(lambda s, x=x: sales.breakdown(s, QUARTER, x)) for x in sales.DIMENSION_COLUMNS},
    "worst_sellers": _shop(lambda s: sales.breakdown(s, QUARTER, "product", worst=True)),
    "sales_filtered_category_tree": _shop(_tree),
    "sales_previous_period": _shop(lambda s: sales.with_previous(s, DECEMBER)),
    "data_window": _shop(sales.data_window),
    "channel_counts": _shop(_dims),
    "margin_report": _shop(lambda s: sales.margin_report(s, QUARTER)),
    "customer_stats": _shop(lambda s: sales.customer_stats(s, QUARTER)),
    "returning_customers_semi": _shop(lambda s: sales.returning_customers(s, DECEMBER)),
    "variant_sales": _shop(lambda s: sales.variant_sales(s, DECEMBER)),
    "inventory_value": _shop(inventory.inventory_value),
    "sell_through": _shop(lambda s: inventory.sell_through(s, QUARTER)),
    "days_of_cover": _shop(lambda s: inventory.days_of_cover(s, AS_OF)),
    "low_stock": _shop(lambda s: inventory.low_stock(s, AS_OF)),
    "dead_stock": _shop(lambda s: inventory.dead_stock(s, AS_OF)),
    "negative_stock": _shop(lambda s: inventory.negative_stock(_recounted(s))),
    "inventory_snapshot": _shop(inventory.inventory_snapshot),
    "inventory_at": _shop(lambda s: inventory.inventory_at(s, D(2024, 1, 15))),
    "catalog_page": _shop(lambda s: inventory.catalog_page(s, AS_OF, sort="price", descending=True)),
    "catalog_search": _shop(lambda s: inventory.catalog_page(s, AS_OF, query="sku-1", sort="sku", limit=30, offset=10)),
    "keyset_page": _shop(_page),
    "weekly_units": _shop(lambda s: demand.weekly_units(s, AS_OF)),
    "vendor_terms_primary": _shop(demand.primary_terms),
    "stockout_days": _shop(lambda s: demand.stockout_days(s, MOVES_AS_OF)),
    "demand_inputs": _shop(lambda s: demand.demand_inputs(s, AS_OF, MOVES_AS_OF).select("variant_id", "location_id", "on_hand", "w0", "w1", "w2", "w3", "last_year", "trailing_year", "stockout_days", "lead_time_days")),
    "reorder_suggestions": _shop(lambda s: demand.suggestions(s, AS_OF)),
    "vendor_groups": _shop(lambda s: demand.vendor_groups(s, AS_OF)),
    "shortfall": _shop(lambda s: demand.shortfall(s, AS_OF)),
    "outstanding_quantities": _shop(lambda s: demand.outstanding(_purchase_lines(s))),
    "purchase_orders": _shop(_purchase_orders),
    "reorder_outcome": _shop(lambda s: demand.reorder_outcome(_purchase_lines(s), sales.variant_sales(s, QUARTER))),
    "stale_inventory": _shop(lambda s: stale.stale_inventory(s, AS_OF)),
    "co_purchases": _shop(lambda s: stale.co_purchases(s, s.variants, AS_OF)),
    "category_by_location": _shop(lambda s: stale.category_by_location(s, AS_OF)),
    "markdown_ladder": _shop(lambda s: stale.markdown_ladder(s, AS_OF)),
    "rescue_choice": _shop(lambda s: stale.rescue(s, AS_OF)),
    "rescue_outcome": _shop(_rescue_outcome),
    "financial_summary": _shop(lambda s: finance.financial_summary(s, DECEMBER)),
    "tender_split": _shop(lambda s: finance.tender_split(s, DECEMBER)),
    "reconciliation_net": _shop(lambda s: finance.reconciliation_net(s, DECEMBER)),
    "reconciliation_takings": _shop(lambda s: finance.reconciliation_takings(s, DECEMBER)),
    "month_end_packet": _shop(lambda s: finance.month_end_packet(s, DECEMBER)),
    "digest_comparison": _shop(lambda s: sales.digest_comparison(s, AS_OF)),
    "daily_observations": _shop(lambda s: anomaly.daily_observations(s, QUARTER)),
    "weekday_baselines": _shop(_baselines),
    "sales_anomalies": _shop(lambda s: anomaly.sales_anomalies(_two_places(s), ANOMALY_DAY, "high")),
    "sync_gap_p90": _shop(lambda s: anomaly.sync_health(s, dt.datetime(2001, 8, 3))),
    "shrink": _shop(lambda s: anomaly.shrink(s, MOVES_AS_OF, _rung_up(s))),
    "refund_shares": _shop(lambda s: anomaly.refund_shares(s, QUARTER)),
    "refund_spike": _shop(lambda s: anomaly.refund_spike(s, AS_OF)),
    "heatmap": _shop(lambda s: staffing.heatmap(s, AS_OF)),
    "busiest_hours": _shop(lambda s: staffing.busiest_hours(s, AS_OF)),
    "staffing_observations": _shop(_observed),
    "dq_catalog": _shop(lambda s: sync.quality_metrics(s, AS_OF)),
    "dq_reconciliation": _shop(lambda s: sync.reconciliation(s).groupBy("drifts").agg(F.count("*").alias("orders"), F.round(F.sum("gap"), 2).alias("gap"))),
    "dq_findings": _shop(lambda s: sync.findings(sync.quality_metrics(s, AS_OF))),
    "source_invariants": _shop(sync.source_invariants),
    "source_quirks": _shop(sync.quirks),
    "detectors": _shop(lambda s: anomaly.detected(_two_places(s), ANOMALY_DAY, ("sales_anomaly", "refund_spike", "shrink", "impossible_stock"))),
    "breakdown_totals": _shop(lambda s: sales.breakdown(s, QUARTER, "category", totals=True)),
    "catalog_totals": _shop(lambda s: inventory.catalog_page(s, AS_OF, query="sku-1", sort="sku", limit=30, totals=True).select("variant_id", "sku", "total_rows", "truncated")),
    "where_it_sits": _shop(stale.where_it_sits),
    "vendor_returns": _shop(stale.vendor_terms),
    "briefing": lambda spark, d: ledger.briefing(binding.shop(spark, d), _insights(spark.read.parquet(f"{d}/events.parquet")), _now()),
    "drafts_replaced": _shop(_drafts),
    "customer_dedupe": _shop(lambda s: sync.duplicates(s.customers)),
    "upsert_last_wins": _table("orders", _upserted),
    "sweep_anti_join": _table("orders", _swept),
    "watermark_max": _table("events", lambda e: sync.watermark(sync.since(e, "ts", F.lit("2024-01-10").cast("timestamp_ntz")), "ts")),
    "raw_latest": _table("orders", _raw),
    "map_trim_fold": _table("events", lambda e: _sheet(e).select("row", tr.trim(F.col("receipt")).alias("trimmed"), tr.fold_key(F.col("receipt")).alias("folded"), tr.upper(F.col("receipt")).alias("uppered"))),
    "map_parse_money": _table("events", lambda e: _sheet(e).select("row", units(tr.parse_money(F.col("amount"))).alias("amount"), tr.money_error(F.col("amount")).alias("bad"))),
    "map_parse_date": _table("events", lambda e: _sheet(e).select("row", tr.parse_date(F.col("date")).alias("day"))),
    "map_hash_id": _table("events", lambda e: _sheet(e).select("row", tr.hash_id(F.col("receipt"), "r-").alias("id"))),
    "map_split_name": _table("events", lambda e: _sheet(e).select("row", tr.split_name(F.col("who")).alias("first_name"), tr.split_name(F.col("who"), "last").alias("last_name"))),
    "map_at_time": _table("events", lambda e: _sheet(e).select("row", tr.at_time(tr.parse_date(F.col("date")), "18:30", "America/New_York").cast("timestamp_ntz").alias("at"))),
    "map_modal_row": _table("events", lambda e: _modal(_sheet(e))),
    "map_lookup": _table("events", lambda e: _looked_up(_sheet(e))),
    "map_orders_from_lines": _table("events", lambda e: _from_lines(_sheet(e))),
    "vector_topk": _vector,
    "text_and_or": _table("documents", lambda d: retrieval.text_search(d, "the and est")),
    "text_or_fallback": _table("documents", lambda d: retrieval.text_search(d, "the zzzqqq")),
    "hybrid_rrf": _hybrid,
    "ingest_diff": _table("documents", _diff),
    "hit_at_k": _hits,
    "chunk_documents": _table("documents", lambda d: retrieval.chunks(d)),
    "insights_ranked": _table("events", lambda e: ledger.ranked(_insights(e), _now()).select("dedupe_key", "kind", "severity", "dollar_impact")),
    "insights_expired": _table("events", lambda e: ledger.expire(_insights(e), _now()).groupBy("status").agg(F.count("*").alias("n"))),
    "value_ledger": _table("events", _ledger),
    "detector_precision": _table("events", lambda e: ledger.precision(_insights(e))),
    "eval_summary": _table("events", lambda e: jobs.eval_summary(_answers(e))),
    "runs_swept": _table("events", lambda e: jobs.swept(_runs(e), F.lit("2024-01-15").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))),
    "runs_last_succeeded": _table("events", _last_succeeded),
    "runs_claimed": _table("events", _claims),
    "messages_sent": _table("events", lambda e: jobs.sent_today(e.select(F.col("user_id").alias("recipient"), F.col("ts").cast("timestamp").alias("sent_at")), D(2024, 1, 15), binding.ZONE)),
    "messages_delivery": _table("events", _deliveries),
    "insights_recorded": _table("events", _recorded),
    "map_scalars": _table("events", _scalars),
    "raw_landing": _table("orders", lambda o: sync.raw_landing(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "order", ["o_orderkey"])),
    "fk_required": lambda spark, d: _resolved(spark, d, True),
    "fk_optional": lambda spark, d: _resolved(spark, d, False),
}
