"""Readers and sinks: a registry of adapters, spreadsheet exports, a cloud register's JSON, documents, and CSV."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.operators.asof import asof


@dataclass(frozen=True)
class Adapter:
    """read(spark, config, entity) gives an entity's rows; capabilities are what its source reports."""

    read: Callable[[SparkSession, dict, str], DataFrame]
    describe: str
    capabilities: frozenset[str] = frozenset()


_adapters: dict[str, Adapter] = {}


def register(name: str, adapter: Adapter) -> None:
    _adapters[name] = adapter


def available() -> dict[str, str]:
    return {n: a.describe for n, a in sorted(_adapters.items())}


def adapter(name: str) -> Adapter:
    if name not in _adapters:
        raise BadArgument(f"there is no adapter {name!r}; there are {', '.join(sorted(_adapters))}")
    return _adapters[name]


def capability_changes(before: dict[str, bool], after: dict[str, bool]) -> dict[str, tuple[bool, bool]]:
    return {k: (before.get(k, False), after.get(k, False)) for k in sorted({*before, *after}) if before.get(k, False) != after.get(k, False)}


def load_entities(spark: SparkSession, source: Adapter, config: dict, entities: tuple[str, ...], sink: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Each entity in order; one that fails is reported and the others go on."""
    errors = {}
    for entity in entities:
        try:
            sink(entity, source.read(spark, config, entity))
        except Exception as e:  # an entity's failure is its own
            errors[entity] = str(e)[:500]
    return errors


def normalised_header(name: str) -> str:
    return re.sub(r"\s+", " ", str(name)).strip().lower()


def numbered(df: DataFrame, name: str = "row", first: int = 1) -> DataFrame:
    """Rows of files with their number in the file, however the files are split.

    Rows of each split are counted, a split's first number is the sum of those before it in its file, and a row adds its place
    in the split. df reads files and nothing else: two reads of them must give the same rows in the same tasks.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = at.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__id").alias("__least"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("__file", "__start", "__least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return at.join(begins, ["__file", "__start"]).withColumn(name, F.col("__before") + F.col("__id") - F.col("__least") + first).drop("__file", "__start", "__id", "__least", "__before")


def sheets(spark: SparkSession, files: dict[str, str], pattern: str) -> DataFrame:
    """The union of the CSV exports of all sheets whose name matches, with columns sheet and row (the row's number in its sheet, of which the header is 1).

    Headers differ in case and spaces between years; blank rows and the closing TOTAL row go.
    """
    out = None
    for name, path in sorted(files.items()):
        if not re.fullmatch(pattern, name):
            continue
        df = numbered(spark.read.csv(path, header=True), "\0row", 2)
        df = df.select(*[F.col(f"`{c}`").alias("row" if c == "\0row" else normalised_header(c)) for c in df.columns if c == "\0row" or normalised_header(c) not in ("row", "sheet")]).withColumn("sheet", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise BadArgument(f"no sheet matches {pattern!r}; there are {', '.join(sorted(files))}")
    values = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in out.columns if c not in ("sheet", "row")]
    text = F.concat(*values)
    is_total = F.exists(F.array(*values), lambda v: F.upper(v).startswith("TOTAL"))
    return out.filter((text != "") & ~is_total)


def sample(files: dict[str, str], spark: SparkSession, rows: int = 5) -> dict[str, list]:
    return {name: [list(r) for r in spark.read.csv(path).limit(rows).collect()] for name, path in sorted(files.items())}


#: The register's words for states, tenders and movements.
STATUS = {"OPEN": "open", "COMPLETED": "completed", "CANCELED": "canceled"}
TENDER = {"CARD": "card", "CASH": "cash", "EXTERNAL": "other"}
MOVEMENT = {("", "IN_STOCK"): "received", ("IN_STOCK", "SOLD"): "sold", ("IN_STOCK", "WASTE"): "damaged", ("SOLD", "IN_STOCK"): "returned"}


def _word(column: Column, words: dict[str, str], other: str | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), column), F.lit(other))


def cents(column: str) -> Column:
    return (F.coalesce(F.col(column), F.lit(0)).cast("decimal(18,0)") / 100).cast("decimal(14,4)")


def register_orders(raw: DataFrame, event_locations: tuple[str, ...] = ()) -> DataFrame:
    """Canonical orders of a register that counts cents: subtotal is gross, so total = subtotal - discount + tax + tip."""
    channel = F.when(F.col("location_id").isin(*event_locations), "event").when(F.col("source") == "ONLINE", "online").when(F.col("source") == "POS", "in_store").otherwise("other")
    total, tax, tip, discount = (cents(f"total_{c}money") for c in ("", "tax_", "tip_", "discount_"))
    return raw.select(F.col("id").alias("external_id"), "location_id", "customer_id", _word(F.col("state"), STATUS).alias("status"), channel.alias("channel"), (total - tax - tip + discount).cast("decimal(14,4)").alias("subtotal"), discount.alias("discount_total"), tax.alias("tax_total"), tip.alias("tip_total"), total.alias("total"), F.to_timestamp("created_at").alias("placed_at"))


def register_lines(raw: DataFrame, costs: DataFrame) -> DataFrame:
    """Canonical order lines of a register that counts cents, each with the cost its variant had then.

    costs: (variant_id, changed_at, cost), what is known of when costs changed. A line without variant is a custom amount.
    """
    name = F.when(F.col("variation_name").isNotNull() & (F.col("variation_name") != ""), F.concat("name", F.lit(" ("), "variation_name", F.lit(")"))).otherwise(F.col("name"))
    quantity = F.coalesce(F.col("quantity").try_cast("decimal(14,4)"), F.lit(0).cast("decimal(14,4)"))
    lines = raw.select(F.col("uid").alias("external_id"), "order_id", F.col("catalog_object_id").alias("variant_id"), name.alias("name_snapshot"), quantity.alias("quantity"), cents("base_price_money").alias("unit_price"), cents("total_discount_money").alias("discount"), F.to_timestamp("created_at").alias("sold_at"))
    known = costs.select("variant_id", "changed_at", F.col("cost").cast("decimal(14,4)").alias("unit_cost_snapshot"))
    return asof(lines, known, "variant_id", "sold_at", "changed_at", "unit_cost_snapshot")


def register_movements(raw: DataFrame) -> DataFrame:
    pair = F.concat_ws(">", F.coalesce("from_state", F.lit("")), "to_state")
    kinds = {f"{a}>{b}": k for (a, b), k in MOVEMENT.items()}
    return raw.select(F.col("id").alias("external_id"), F.col("variation_id").alias("variant_id"), "location_id", _word(pair, kinds, "adjusted").alias("kind"), F.coalesce(F.col("quantity").try_cast("decimal(14,4)"), F.lit(0)).alias("quantity"), F.to_timestamp("occurred_at").alias("occurred_at"))


def register_payments(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("external_id"), "order_id", cents("amount_money").alias("amount"), cents("tip_money").alias("tip"), _word(F.col("source_type"), TENDER, "other").alias("tender"), F.to_timestamp("created_at").alias("occurred_at"))


def with_parents(categories: DataFrame) -> DataFrame:
    """Second pass: parent ids of categories whose parent may have come after them."""
    keys = categories.select(F.col("external_id").alias("__parent"), F.col("id").alias("parent_id"))
    return categories.drop("parent_id").join(keys, F.col("parent_external_id") == F.col("__parent"), "left").drop("__parent")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown and text files: title is the first heading or line, else the file's name; other kinds and empty files are left out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown,txt,text}").select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
    line = F.trim(F.regexp_extract("content", r"\S[^\n]*", 0))
    heading = F.trim(F.regexp_replace(line, r"^#+", ""))
    return files.select(F.when(line == "", F.regexp_replace("filename", r"\.[^.]*$", "")).otherwise(F.substring(heading, 1, 200)).alias("title"), "filename", "content")


def product_texts(variants: DataFrame, stock: DataFrame) -> DataFrame:
    """One text a product to search in: name, category, price or range, variants with their SKUs, and stock by location."""
    price = F.when(F.min("price") == F.max("price"), F.format_string("Price: $%.2f", F.min("price").cast("double"))).otherwise(F.format_string("Price: $%.2f to $%.2f", F.min("price").cast("double"), F.max("price").cast("double")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sku"))), lambda v: F.concat(v["name"], F.lit(" ("), v["sku"], F.lit(")"))), ", ")
    rows = variants.groupBy("product_id", "category_id").agg(price.alias("price_line"), names.alias("variant_line"))
    held = stock.join(variants.select("variant_id", "product_id", "category_id"), "variant_id").groupBy("product_id", "category_id", "location_id").agg(F.sum("on_hand").alias("n")).groupBy("product_id", "category_id").agg(F.sum("n").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("location_id", "n"))), lambda s: F.concat(s["n"].cast("bigint").cast("string"), F.lit(" at "), s["location_id"].cast("string"))), ", ").alias("where"))
    both = rows.join(held, ["product_id", "category_id"], "left")
    line = F.when(F.col("all") > 0, F.concat(F.lit("In stock: "), F.col("where"))).when(F.col("all").isNotNull(), F.lit("In stock: none left"))
    return both.select("product_id", "category_id", F.concat_ws("\n", "product_id", F.concat(F.lit("Category: "), "category_id"), "price_line", F.concat(F.lit("Variants: "), "variant_line"), line).alias("content"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
