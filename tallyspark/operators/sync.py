"""Bringing sources into the model: landing, merging, sweeping, watermarks, duplicates and quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.context import Shop
from tallyspark.functions.numbers import total
from tallyspark.functions.transforms import normalised_email, normalised_phone
from tallyspark.operators.inventory import signed
from tallyspark.session import written

#: Fixed order in which entities are loaded: parents before children.
ENTITIES = ("location", "category", "vendor", "product", "variant", "variant_vendor", "customer", "order", "refund", "payment", "inventory_level", "inventory_movement")
STALE_AFTER_DAYS, DRIFT = 3, 0.01
#: A customer without a date counts as the youngest.
NO_DATE = dt.date(9999, 12, 31)


def raw_landing(records: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Untouched payloads as JSON under their keys."""
    return records.select(F.lit(entity).alias("entity"), *keys, F.to_json(F.struct(*records.columns)).alias("payload"))


def landed(records: DataFrame, source: str, entity: str, keys: list[str], at: str | Column) -> DataFrame:
    """Rows of the raw store: untouched payloads by source, entity and the record's own id, with the time they came."""
    fetched = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return records.select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("external_id"), F.to_json(F.struct(*records.columns)).alias("payload"), fetched.alias("fetched_at"))


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last record."""
    newest = F.max_by(F.struct(*records.columns), F.struct(*order)).alias("r")
    return records.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest).select("r.*")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target rows with the last change of each key in their place, and the new keys."""
    last = latest(changes, keys, order).select(*target.columns)
    return target.join(last.select(*keys), keys, "left_anti").select(*target.columns).unionByName(last)


def sweep(target: DataFrame, seen: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Rows that a full pull did not see get deleted_at; an empty pull sweeps nothing."""
    marked = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    some = seen.select(F.lit(True).alias("__any")).limit(1)
    out = target.join(marked, keys, "left").join(some, F.lit(True), "left")
    gone = F.col("__any") & F.col("__seen").isNull() & F.col("deleted_at").isNull()
    return out.withColumn("deleted_at", F.when(gone, at).otherwise(F.col("deleted_at"))).drop("__seen", "__any")


def watermark(records: DataFrame, column: str, previous: DataFrame | None = None) -> DataFrame:
    """The largest source time seen; an empty pull keeps the old one."""
    found = records.agg(F.max(column).alias("watermark"))
    return found if previous is None else found.join(previous.select(F.col("watermark").alias("__p"))).select(F.greatest("watermark", "__p").alias("watermark"))


def since(records: DataFrame, column: str, mark: Column) -> DataFrame:
    """Inclusive: the boundary row comes again and the merge absorbs it."""
    return records.filter(F.col(column) >= mark)


def resolved(children: DataFrame, parents: DataFrame, external: str, id_col: str, required: bool) -> DataFrame:
    """Children with the id of the parent that has their external id; without one a required child is dropped."""
    keys = parents.select(F.col("external_id").alias("__external"), F.col("id").alias(id_col))
    return children.join(keys, children[external] == F.col("__external"), "inner" if required else "left").drop("__external")


def duplicates(customers: DataFrame) -> DataFrame:
    """(customer_id, merged_into): the oldest customer with the same e-mail or phone, over any chain of these; ties to the smaller id.

    Customers point at the smallest member of their e-mail and phone groups; labels spread through the groups until no
    label changes. No group is collected.
    """
    people = customers.select("customer_id", normalised_email(F.col("email")).alias("email"), normalised_phone(F.col("phone")).alias("phone"), "created_on")
    keys = people.select("customer_id", F.concat(F.lit("e:"), "email").alias("key")).unionByName(people.select("customer_id", F.concat(F.lit("p:"), "phone").alias("key"))).filter("key is not null")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = written(keys.join(shared, "key"), "keys")
    labels = written(keys.groupBy("customer_id").agg(F.min("customer_id").alias("label")), "labels")
    while True:
        least = keys.join(labels, "customer_id").groupBy("key").agg(F.min("label").alias("label"))
        step = keys.join(least, "key").groupBy("customer_id").agg(F.min("label").alias("label"))
        jump = step.select(F.col("customer_id").alias("at"), F.col("label").alias("next"))
        following = written(step.join(jump, F.col("label") == F.col("at"), "left").select("customer_id", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = following.join(labels.withColumnRenamed("label", "before"), "customer_id").filter("label <> before").limit(1).count()
        labels = following
        if not changed:
            break
    both = labels.join(people.select("customer_id", "created_on"), "customer_id")
    oldest = both.groupBy("label").agg(F.min(F.struct(F.coalesce("created_on", F.lit(NO_DATE)).alias("d"), "customer_id")).alias("o")).select("label", F.col("o.customer_id").alias("survivor"))
    return both.join(oldest, "label").filter("customer_id <> survivor").select("customer_id", F.col("survivor").alias("merged_into"))


def quality_metrics(shop: Shop, as_of: dt.date) -> DataFrame:
    """(metric, value): counts of what makes figures unreliable."""
    variants = shop.variants.agg(F.count("*").alias("variants"), F.count_if(F.expr("cost is null")).alias("variants_missing_cost"), F.count_if(F.expr("category_id is null")).alias("products_uncategorised"))
    negative = shop.levels.agg(F.count_if(F.expr("on_hand < 0")).alias("negative_stock_levels"))
    drift = reconciliation(shop).agg(F.count_if(F.col("drifts")).alias("orders_not_reconciling"))
    lines = shop.lines.agg(F.count_if(F.expr("variant_id is null")).alias("custom_lines"), F.count("*").alias("lines"))
    last = shop.orders.filter("status <> 'canceled'").agg(F.date_diff(F.lit(as_of), shop.local_day(F.max("placed_at"))).alias("days_since_last_order"))
    one = variants.join(negative).join(drift).join(lines).join(last)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("m")).select("m.*")


def reconciliation(shop: Shop) -> DataFrame:
    """Each order's total beside what its lines, discounts and tax add up to."""
    sums = shop.lines.groupBy("order_id").agg(total(F.col("gross") - F.col("discount") + F.col("tax")).alias("lines_total"))
    both = shop.orders.join(sums, "order_id", "left").fillna(0, ["lines_total"])
    gap = F.col("total") - F.col("lines_total")
    return both.select("order_id", F.round(gap, 2).cast("double").alias("gap"), (F.abs(gap) > DRIFT).alias("drifts"))


def findings(metrics: DataFrame) -> DataFrame:
    """(code, severity, count, share) of the rules that apply, worst first."""
    m = metrics.groupBy().pivot("metric", ["variants", "variants_missing_cost", "products_uncategorised", "negative_stock_levels", "orders_not_reconciling", "custom_lines", "lines", "days_since_last_order"]).agg(F.first("value"))
    none = F.lit(None).cast("double")
    rule = lambda code, severity, when, count, of=none: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), count.alias("count"), F.round(of, 4).alias("share")))
    error, warning, info = F.lit("error"), F.lit("warning"), F.lit("info")
    missing, custom = F.col("variants_missing_cost") / F.col("variants"), F.col("custom_lines") / F.col("lines")
    rules = F.array(
        rule("missing_costs", F.when(1 - missing > 0.7, warning).otherwise(error), F.col("variants_missing_cost") > 0, F.col("variants_missing_cost"), missing),
        rule("uncategorised_products", warning, F.col("products_uncategorised") > 0, F.col("products_uncategorised")),
        rule("custom_amount_sales", info, custom > 0.01, F.lit(0.0), custom),
        rule("orders_not_reconciling", error, F.col("orders_not_reconciling") > 0, F.col("orders_not_reconciling")),
        rule("negative_stock", warning, F.col("negative_stock_levels") > 0, F.col("negative_stock_levels")),
        rule("no_sales", error, F.col("days_since_last_order").isNull(), F.lit(0.0)),
        rule("stale_data", error, F.col("days_since_last_order") > STALE_AFTER_DAYS, F.col("days_since_last_order")),
    )
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return m.select(F.explode(F.array_compact(rules)).alias("f")).select("f.*").orderBy(rank, F.desc("count"), "code")


def source_invariants(shop: Shop) -> DataFrame:
    """(name, checked, broken) of what must hold in a source: counts are the sum of their history, orders that of their
    lines, refunds are no more than was paid, and no shelf is below zero."""

    def rule(name: str, rows: DataFrame, broken: Column) -> DataFrame:
        return rows.agg(F.lit(name).alias("name"), F.count("*").alias("checked"), F.count_if(broken).alias("broken"))

    moved = shop.movements.groupBy("variant_id", "location_id").agg(total(F.col("quantity") * signed()).alias("moved"))
    shelves = shop.levels.join(moved, ["variant_id", "location_id"], "left").fillna(0, ["moved"])
    sums = shop.lines.groupBy("order_id").agg(total(F.col("gross") - F.col("discount") + F.col("tax")).alias("lines"), total(F.col("gross") - F.col("discount")).alias("paid"))
    orders = shop.orders.join(sums, "order_id", "left").fillna(0, ["lines"])
    refunds = shop.refunds.groupBy("order_id").agg(total("amount").alias("back")).join(sums, "order_id")
    rules = [
        rule("counts_are_history", shelves, F.col("on_hand") != F.col("moved")), rule("orders_are_lines", orders, F.abs(F.col("total") - F.col("lines")) > DRIFT),
        rule("refunds_within_payment", refunds, F.col("back") > F.col("paid")), rule("no_negative_stock", shop.levels, F.col("on_hand") < 0),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def quirks(shop: Shop) -> DataFrame:
    """(quirk, share) of a source: orders of nobody, custom lines, customers with another's e-mail, variants without cost."""
    mails = shop.customers.select(normalised_email(F.col("email")).alias("email")).filter("email is not null").groupBy("email").agg(F.count("*").alias("n"))
    part = lambda name, rows, of: rows.agg(F.lit(name).alias("quirk"), F.round(F.avg(of.cast("double")), 4).alias("share"))
    shared = mails.agg(F.lit("shared_emails").alias("quirk"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("share"))
    out = part("anonymous_orders", shop.orders, F.col("customer_id").isNull()).unionByName(part("custom_lines", shop.lines, F.col("variant_id").isNull()))
    return out.unionByName(shared).unionByName(part("variants_without_cost", shop.variants, F.col("cost").isNull()))
