import datetime as dt
import random

import pytest

from tallyspark.operators.asof import asof
from tallyspark.sources import readers

T = dt.datetime(2024, 1, 1)


def _brute(rows, changes):
    out = []
    for i, key, at in rows:
        known = [(t, v) for k, t, v in changes if k == key and k is not None and t is not None and v is not None and at is not None and t <= at]
        out.append((i, key, at, max(known)[1] if known else None))
    return out


@pytest.mark.parametrize("days", [1, 30, 4000])
def test_against_brute_force(spark, days):
    rng = random.Random(days)
    hours = lambda: T + dt.timedelta(hours=rng.randrange(24 * 200))
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([hours(), hours(), None]) if i % 9 == 0 else hours()) for i in range(500)]
    changes = [(rng.choice(["hot", "a", "c", None]), rng.choice([hours(), T + dt.timedelta(days=30)]), rng.choice([1.0, 2.0, 3.5, None])) for _ in range(120)] + [("hot", None, 9.0)]
    rows += [(1000 + j, k, t) for j, (k, t, _) in enumerate(changes[:20])]  # at the very time of a change
    rows += rows[:3]
    left = spark.createDataFrame(rows, "id int, variant string, sold_at timestamp").withColumn("cost", __import__("pyspark").sql.functions.lit("old"))
    right = spark.createDataFrame([(k, t, v, 0) for k, t, v in changes], "variant string, at timestamp, cost double, id int")
    got = asof(left, right, "variant", "sold_at", "at", "cost", days)
    assert got.columns == ["id", "variant", "sold_at", "cost"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_brute(rows, changes), key=str)


def test_nothing_on_either_side(spark):
    left = spark.createDataFrame([(1, "a", T)], "id int, variant string, sold_at timestamp")
    right = spark.createDataFrame([], "variant string, at timestamp, cost double")
    assert [tuple(r) for r in asof(left, right, "variant", "sold_at", "at", "cost").collect()] == [(1, "a", T, None)]
    assert asof(left.limit(0), right, "variant", "sold_at", "at", "cost").collect() == []


def test_register_lines_know_the_cost_of_their_day(spark):
    raw = spark.createDataFrame(
        [("u1", "o1", "v1", "Mug", "Red", "2", 1250, 100, "2024-01-05T10:00:00Z"), ("u2", "o1", None, "Gift", None, "1", 500, None, "2024-01-05T10:00:00Z"), ("u3", "o2", "v1", "Mug", None, "0.5", 1250, 0, "2024-03-01T10:00:00Z")],
        "uid string, order_id string, catalog_object_id string, name string, variation_name string, quantity string, base_price_money long, total_discount_money long, created_at string",
    )
    costs = spark.createDataFrame([("v1", dt.datetime(2024, 1, 1), 4.0), ("v1", dt.datetime(2024, 2, 1), 4.5)], "variant_id string, changed_at timestamp, cost double")
    rows = {r.external_id: r for r in readers.register_lines(raw, costs).collect()}
    assert [(rows[u].name_snapshot, float(rows[u].quantity), float(rows[u].unit_price), float(rows[u].discount)) for u in ("u1", "u2", "u3")] == [("Mug (Red)", 2.0, 12.5, 1.0), ("Gift", 1.0, 5.0, 0.0), ("Mug", 0.5, 12.5, 0.0)]
    assert [rows[u].unit_cost_snapshot and float(rows[u].unit_cost_snapshot) for u in ("u1", "u2", "u3")] == [4.0, None, 4.5]
