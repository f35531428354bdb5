"""Queries over what is written and kept up: raw records, indexes, sales by day; and over orders of all rows. With their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.numbers import exact, units
from tallyspark.operators import inventory, ordering, retrieval, stale, sync
from tallyspark.operators.asof import asof
from tallyspark.operators.sales_days import SalesDays
from tallyspark.operators.text_index import TextIndex
from tallyspark.operators.vector_index import VectorIndex
from tallyspark.plans.oracle import ORACLE as BASE
from tallyspark.session import shared_dir
from tallyspark.sources import binding
from tallyspark.streaming.store import raw_store

AS_OF = dt.date(2001, 8, 1)
#: The row that is asked for, and words.
ASKED, WORDS = 7, "the and est"
Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Three pulls of orders, each with some that came before."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    store, key = raw_store(spark, _folder(spark, "raw"), parts=8), F.col("o_orderkey")
    for day, some, columns in ((1, key % 4 < 3, ["o_orderkey", "o_orderstatus"]), (2, key % 4 >= 2, ["o_orderkey", "o_orderpriority"]), (3, key % 10 == 0, ["o_orderkey", "o_orderstatus", "o_orderpriority"])):
        store.merge(sync.landed(orders.filter(some).select(*columns), "register", "order", ["o_orderkey"], f"2001-08-0{day} 00:00:00"))
    return store.read().select("entity", "external_id", "payload", F.dayofmonth("fetched_at").alias("pull"))


def _text(spark: SparkSession, d: str, by: str) -> DataFrame:
    """Hits of an index that was built from other texts before it was brought to these."""
    docs = binding.documents(spark, d).select("doc_id", "text")
    index = TextIndex(spark, _folder(spark, "text"), parts=16)
    i = F.col("doc_id")
    index.update(docs.filter(i % 10 != 1).withColumn("text", F.when(i % 10 == 2, F.concat("text", F.lit(" the and est"))).otherwise(F.col("text"))).unionByName(docs.filter(i % 10 == 3).withColumn("doc_id", -i - 1)))
    index.update(docs)
    return index.search(WORDS, by=by)


def _vector(spark: SparkSession, d: str) -> DataFrame:
    """The exact nearest rows, by cells, as many as the bounds leave."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    index = VectorIndex(spark, _folder(spark, "vectors"), cells=16)
    index.update(rows.filter("vec_id % 5 <> 0"), ["label"])
    index.update(rows, ["label"])
    asked = list(rows.filter(F.col("vec_id") == ASKED).first().embedding)
    return index.search(asked, 10, probes=4, where=F.col("vec_id") != ASKED, exact=True)


def _vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    index = VectorIndex(spark, _folder(spark, "vectors"), cells=16)
    index.update(rows, ["label"])
    asked = list(rows.filter(F.col("vec_id") == ASKED).first().embedding)
    return index.search(asked, 10, probes=2, having={"label": "3"}, exact=True)


def _kept(f: Callable) -> Query:
    """A metric from written days: taken in up to three dates, the last of them some days before it is asked for."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        shop = binding.shop(spark, d)
        kept = SalesDays(spark, _folder(spark, "days"))
        for days in (500, 100, 6):
            kept.refresh(shop, AS_OF - dt.timedelta(days=days))
        return f(shop, kept)

    return run


def _cost_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the cost of their variant that was last known when they were sold; what came back says what a unit cost."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    sold = lines.join(spark.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.col("o_orderdate").cast("timestamp").alias("sold_at"))
    costs = lines.filter("l_returnflag = 'A'").select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("changed_at"), exact(F.floor(60 * F.col("l_extendedprice") / F.col("l_quantity")) / 100).alias("unit_cost"))
    return asof(sold, costs, "l_partkey", "sold_at", "changed_at", "unit_cost").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", units("unit_cost").alias("unit_cost"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return ordering.row_numbers(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id"), ["ts", "event_id"], "n").select("event_id", "n")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    items = binding.documents(spark, d).select("doc_id", F.length("text").alias("chars"))
    return ordering.batches(items, "chars", ["doc_id"], retrieval.BATCH_ITEMS, retrieval.BATCH_CHARS).select("doc_id", "batch")


QUERIES: dict[str, Query] = {
    "raw_store": _raw,
    "text_index_search": lambda spark, d: _text(spark, d, "share"),
    "text_index_ranked": lambda spark, d: _text(spark, d, "frequencies"),
    "vector_index_topk": _vector,
    "vector_index_filtered": _vector_filtered,
    "dead_stock_kept": _kept(lambda shop, kept: inventory.dead_stock(shop, AS_OF, kept=kept)),
    "stale_inventory_kept": _kept(lambda shop, kept: stale.stale_inventory(shop, AS_OF, kept=kept)),
    "cost_snapshot": _cost_snapshot,
    "row_numbers": _numbers,
    "embedding_batches": _batches,
}

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
ORACLE: dict[str, str] = {
    "raw_store": """SELECT 'order' AS entity, o_orderkey::VARCHAR AS external_id, CASE WHEN o_orderkey % 10 = 0 THEN 3 WHEN o_orderkey % 4 >= 2 THEN 2 ELSE 1 END AS pull,
      '{"o_orderkey":' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' WHEN o_orderkey % 4 >= 2 THEN ',"o_orderpriority":"' || o_orderpriority || '"}' ELSE ',"o_orderstatus":"' || o_orderstatus || '"}' END AS payload FROM orders""",
    "text_index_search": BASE["text_and_or"],
    "text_index_ranked": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(list_distinct(w)) AS size FROM d), a AS (SELECT count(*) AS everyone, avg(size) AS usual FROM s),
      q AS (SELECT doc_id, size, t, len(list_filter(w, lambda x: x = t)) AS n FROM s, (VALUES ('and'), ('est'), ('the')) AS v(t)), p AS (SELECT * FROM q WHERE n > 0), f AS (SELECT t, count(*) AS docs FROM p GROUP BY 1),
      h AS (SELECT doc_id, count(*) AS hits, round(sum(ln(1 + (everyone - docs + 0.5::DOUBLE) / (docs + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / usual))), 6) AS score FROM p JOIN f USING (t), a GROUP BY 1)
      SELECT doc_id, score FROM h WHERE hits = 3 OR NOT (SELECT coalesce(bool_or(hits = 3), false) FROM h) ORDER BY 2 DESC, 1 LIMIT 30""",
    "vector_index_topk": BASE["vector_topk"],
    "vector_index_filtered": "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY 2 DESC, 1 LIMIT 10",
    "dead_stock_kept": BASE["dead_stock"],
    "stale_inventory_kept": BASE["stale_inventory"],
    "cost_snapshot": """WITH c AS (SELECT l_partkey, l_shipdate AS changed_at, max(CAST(floor(60 * l_extendedprice / l_quantity) / 100 AS DECIMAL(14,4))) AS unit_cost FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
      s AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_orderdate AS sold_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT l_orderkey, s.l_partkey, l_linenumber, l_quantity, CAST(unit_cost AS DOUBLE) AS unit_cost FROM s ASOF LEFT JOIN c ON s.l_partkey = c.l_partkey AND s.sold_at >= c.changed_at""",
    "row_numbers": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events",
    "embedding_batches": """WITH RECURSIVE o AS (SELECT doc_id, length(text) AS s, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
      r AS (SELECT i, doc_id, CAST(0 AS BIGINT) AS batch, 1 AS n, s AS total FROM o WHERE i = 1 UNION ALL
        SELECT o.i, o.doc_id, CASE WHEN n >= 128 OR total + s > 120000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 128 OR total + s > 120000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 128 OR total + s > 120000 THEN s ELSE total + s END FROM r JOIN o ON o.i = r.i + 1)
      SELECT doc_id, batch FROM r""",
}
