"""Queries of the detectors that speak once a day, week or month, of labels, and of search over passages. With their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.context import DateRange, Shop
from tallyspark.operators import anomaly, inventory, sales
from tallyspark.operators.knowledge import Knowledge
from tallyspark.plans.oracle import _DEMAND, _STALE, ORACLE, _q
from tallyspark.session import shared_dir
from tallyspark.sources import binding

D = dt.date
AS_OF, SILENT = D(2001, 8, 1), D(2001, 8, 6)
QUARTER = DateRange(D(2000, 10, 1), D(2000, 12, 31))
#: What passages are searched for, and the barcode digits.
QUESTION, DIGITS = "red widget economy", "00040000"
Query = Callable[[SparkSession, str], DataFrame]


def _shop(f: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, d: f(binding.shop(spark, d))


def _weekly(shop: Shop) -> DataFrame:
    """What is said on a day without orders for days: of the data, of stock that stands still or runs out, and of the rota."""
    rota = shop.locations.select("location_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"), F.lit(17).alias("start_hour"), F.lit(21).alias("end_hour"), (F.col("location_id") % 3 + 1).alias("staff"))
    staffed = replace(shop, frames=shop.frames | {"rota": rota}, hourly_labour_cost=16.0)
    said = anomaly.detected(staffed, AS_OF, ("dead_stock", "reorder", "staffing", "stale_data"))
    return said.unionByName(anomaly.detected(shop, SILENT, ("stale_data", "sales_anomaly", "staffing")))


def _labelled(dimension: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        shop = replace(binding.shop(spark, d), source_names={"reg0": "Front till"})
        return sales.labelled(sales.breakdown(shop, QUARTER, dimension), shop, dimension).select("key", "label", "net_sales")

    return run


def _knowledge(kind: str | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        parts, docs = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/documents.parquet")
        products = parts.select(F.lit("product").alias("kind"), F.col("p_partkey").alias("source_id"), F.lit(0).alias("chunk_index"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("content"))
        texts = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
        index = Knowledge(spark, f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}", parts=8, cells=16)
        index.update(products.unionByName(texts))
        return index.search(QUESTION, 8, kind)

    return run


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Each product name, with its words turned round, asked of passages of products: does a title among the first five have it?"""
    parts = spark.read.parquet(f"{d}/part.parquet")
    products = parts.select(F.lit("product").alias("kind"), F.col("p_partkey").alias("source_id"), F.lit(0).alias("chunk_index"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("content"))
    index = Knowledge(spark, f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}", parts=8, cells=16)
    index.update(products)
    questions = parts.select(F.col("p_name").alias("question_id"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("query"), F.col("p_name").alias("expected")).distinct()
    return index.evaluate(questions)


QUERIES: dict[str, Query] = {
    "detectors_of_stock": _shop(_weekly),
    **{f"labels_{x}": _labelled(x) for x in sales.DIMENSION_COLUMNS},
    "catalog_barcode": _shop(lambda s: inventory.catalog_page(s, AS_OF, query=DIGITS, sort="sku", limit=20).select("variant_id", "sku", "on_hand")),
    "search_catalog": _knowledge(None),
    "search_catalog_products": _knowledge("product"),
    "retrieval_eval": _evaluated,
}

_SILENCE = """g AS (SELECT placed_at, order_id FROM o WHERE status <> 'canceled' AND placed_at <= TIMESTAMP '{now}' ORDER BY 1 DESC, 2 DESC LIMIT 400),
  gh AS (SELECT placed_at, (epoch(placed_at) - epoch(lag(placed_at) OVER (ORDER BY placed_at, order_id))) / 3600 AS h FROM g),
  sh AS (SELECT (epoch(TIMESTAMP '{now}') - epoch(max(placed_at))) / 3600 > greatest(coalesce(3 * quantile_cont(h, 0.9), 30), 30) AS stale FROM gh)"""


def _stale_at(day: str, now: str) -> str:
    return _q(f"SELECT 'stale_data' AS kind, '{day}' AS subject, 'urgent' AS severity, CAST(NULL AS DOUBLE) AS impact FROM sh WHERE coalesce(stale, true)", _SILENCE.format(now=now))


_KINDS = {"channel": "CASE key WHEN 'in_store' THEN 'In store' WHEN 'online' THEN 'Online' WHEN 'event' THEN 'Events and pop-ups' ELSE 'Other' END", "source": "CASE key WHEN 'reg0' THEN 'Front till' ELSE key END", "location": "coalesce((SELECT n_name FROM nation WHERE CAST(n_nationkey AS VARCHAR) = key), 'Unknown location')"}
_KINDS |= {"product": "key", "category": "coalesce(key, 'Uncategorised')", "variant": "(SELECT p_brand || ' ' || chr(8212) || ' ' || p_name FROM part WHERE CAST(p_partkey AS VARCHAR) = key)"}


def _found(kind: str | None) -> str:
    only = f"WHERE kind = '{kind}'" if kind else ""
    return f"""WITH p AS (SELECT 'product:' || p_partkey || ':0' AS id, 'product' AS kind, p_name AS title, p_type || ' ' || p_brand AS content, p_name || chr(10) || chr(10) || p_type || ' ' || p_brand AS text FROM part
      UNION ALL SELECT 'document:' || doc_id || ':0', 'document', '', coalesce(text, ''), coalesce(text, '') FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ws FROM p {only}),
    v AS (SELECT *, list_transform(range(64), lambda i: CAST(len(list_filter(list_transform(ws, lambda t: CAST('0x' || md5(t)[1:4] AS INT) % 64), lambda b: b = i)) AS DOUBLE)) AS e, len(list_distinct(ws)) AS n, len(list_intersect(list_distinct(ws), ['economy', 'red', 'widget'])) AS hits FROM w WHERE len(ws) > 0),
    q AS (SELECT list_transform(range(64), lambda i: CAST(len(list_filter(list_transform(['red', 'widget', 'economy'], lambda t: CAST('0x' || md5(t)[1:4] AS INT) % 64), lambda b: b = i)) AS DOUBLE)) AS a),
    x AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, round(list_dot_product(e, a) / sqrt(list_dot_product(e, e) * list_dot_product(a, a)), 6) AS s FROM v, q ORDER BY 2 DESC, 1 LIMIT 30)),
    y AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, round(hits / (1 + ln(CAST(n AS DOUBLE))), 6) AS s FROM v WHERE hits > 0 AND (hits = 3 OR NOT (SELECT coalesce(bool_or(hits = 3), false) FROM v)) ORDER BY 2 DESC, 1 LIMIT 30)),
    f AS (SELECT id, round(coalesce(CAST(1 AS DOUBLE) / (60 + x.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + y.r), 0), 8) AS score FROM x FULL JOIN y USING (id) ORDER BY 2 DESC, 1 LIMIT 8)
    SELECT id, kind, title, substr(content, 1, 600) AS text, score FROM f JOIN p USING (id)"""


_EVALUATED = r"""WITH p AS (SELECT 'product:' || p_partkey || ':0' AS id, p_name AS title, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part),
    place AS (SELECT t, CAST('0x' || md5(t)[1:4] AS INT) % 64 AS b FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM p)),
    w AS (SELECT id, t, b, count(*) AS c FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM p) JOIN place USING (t) GROUP BY ALL),
    e AS (SELECT id, b, CAST(sum(c) AS DOUBLE) AS v FROM w GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(v * v)) AS l FROM e GROUP BY 1), m AS (SELECT id, count(*) AS size FROM w GROUP BY 1),
    q AS (SELECT DISTINCT p_name AS question_id, string_split(p_name, ' ') AS ts FROM part), qt AS (SELECT question_id, len(list_distinct(ts)) AS asked, unnest(ts) AS t FROM q),
    qe AS (SELECT question_id, b, CAST(count(*) AS DOUBLE) AS v FROM qt JOIN place USING (t) GROUP BY 1, 2), qn AS (SELECT question_id, sum(v * v) AS l FROM qe GROUP BY 1),
    dots AS (SELECT question_id, id, sum(qe.v * e.v) AS d FROM qe JOIN e USING (b) GROUP BY 1, 2),
    x AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS r FROM (SELECT q.question_id, n.id, round(coalesce(d, 0) / sqrt(n.l * n.l * qn.l), 6) AS s FROM qn JOIN q USING (question_id) CROSS JOIN n LEFT JOIN dots ON dots.question_id = q.question_id AND dots.id = n.id) QUALIFY r <= 30),
    h AS (SELECT question_id, id, count(*) AS hits, any_value(asked) AS asked FROM (SELECT DISTINCT question_id, asked, t FROM qt) JOIN (SELECT id, t FROM w) USING (t) GROUP BY 1, 2),
    y0 AS (SELECT question_id, id, hits = asked AS whole, round(hits / (1 + ln(CAST(size AS DOUBLE))), 6) AS s FROM h JOIN m USING (id)),
    y AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY whole DESC, s DESC, id) AS r FROM (SELECT *, bool_or(whole) OVER (PARTITION BY question_id) AS has_whole FROM y0) WHERE whole OR NOT has_whole QUALIFY r <= 30),
    z AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS r FROM (SELECT question_id, id, round(coalesce(CAST(1 AS DOUBLE) / (60 + x.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + y.r), 0), 8) AS s FROM x FULL JOIN y USING (question_id, id))),
    a AS (SELECT *, 'vector' AS mode FROM x UNION ALL SELECT *, 'text' FROM y UNION ALL SELECT *, 'hybrid' FROM z),
    f AS (SELECT q.question_id, k.mode, coalesce(bool_or(contains(lower(title), lower(q.question_id))), false) AS hit FROM q CROSS JOIN (VALUES ('vector'), ('text'), ('hybrid')) AS k(mode) LEFT JOIN (SELECT a.*, title FROM a JOIN p USING (id) WHERE r <= 5) g ON g.question_id = q.question_id AND g.mode = k.mode GROUP BY 1, 2)
    SELECT mode, count(*) AS questions, count(*) FILTER (WHERE hit) AS hits, round(avg(CAST(hit AS INT)), 4) AS hit_rate FROM f GROUP BY 1"""
_SEEN = ORACLE["staffing_observations"]
ORACLE_SQL: dict[str, str] = {
    "detectors_of_stock": f"""SELECT * FROM ({_stale_at("2001-08-01", "2001-08-01 10:00:00")}) UNION ALL SELECT * FROM ({_stale_at("2001-08-06", "2001-08-06 10:00:00")})
      UNION ALL SELECT 'dead_stock', '2001-W31', CASE WHEN cash >= 750 THEN 'warn' ELSE 'info' END, cash FROM (SELECT CAST(round(sum(cash), 2) AS DOUBLE) AS cash FROM ({_q("SELECT cash FROM st", *_STALE)})) WHERE cash >= 100
      UNION ALL SELECT 'reorder', '2001-W31', CASE WHEN impact >= 250 THEN 'urgent' ELSE 'warn' END, impact FROM (SELECT round(CASE WHEN count(m * (price - cost)) * 2 >= count(*) THEN sum(coalesce(m * (price - cost), m * price)) ELSE sum(coalesce(m * price, 0)) END, 2) AS impact, count(*) AS n
        FROM ({_q("SELECT price, cost, round_even(velocity * (lead - cover), 2) AS m FROM rg WHERE cover IS NOT NULL AND stocks_out AND lead - cover > 0", *_DEMAND)})) WHERE n > 0
      UNION ALL SELECT 'staffing', '2001-08:' || location_id, 'info', round(sum(CASE WHEN kind <> 'busy' THEN location_id % 3 + 1 END) * 16.0, 2) FROM ({_SEEN}) GROUP BY location_id""",
    **{f"labels_{x}": f"SELECT key, {label} AS label, net_sales FROM ({ORACLE[f'breakdown_{x}']})" for x, label in _KINDS.items()},
    "catalog_barcode": _q("SELECT variant_id, sku, CAST(sum(on_hand) AS DOUBLE) AS on_hand FROM v LEFT JOIN lv USING (variant_id) WHERE lpad(CAST(variant_id * 7 + 40000000 AS VARCHAR), 12, '0') LIKE '%00040000%' GROUP BY ALL ORDER BY sku LIMIT 20"),
    "search_catalog": _found(None),
    "search_catalog_products": _found("product"),
    "retrieval_eval": _EVALUATED,
}
