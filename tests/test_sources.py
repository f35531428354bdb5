import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.operators import jobs
from tallyspark.sources import binding, readers


def test_registry():
    readers.register("none", readers.Adapter(lambda s, c, e: s.range(0), "nothing"))
    assert readers.available()["none"] == "nothing" and readers.capability_changes({"a": True}, {"b": True}) == {"a": (True, False), "b": (False, True)}
    with pytest.raises(BadArgument, match="there are none"):
        readers.adapter("missing")


def test_failures_stay_with_their_entity(spark):
    def read(s, c, e):
        if e == "bad":
            raise ValueError("broken")
        return s.range(1)

    seen = []
    assert readers.load_entities(spark, readers.Adapter(read, ""), {}, ("a", "bad", "b"), lambda e, df: seen.append(e)) == {"bad": "broken"} and seen == ["a", "b"]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Sale  Amt \n3/7/25,$1.00\n,\nTOTAL,$1.00\n")
    (tmp_path / "b.csv").write_text("DATE,Sale Amt\n3/8/25,$2.00\n")
    files = {"Sales 2024": str(tmp_path / "a.csv"), "Sales 2025": str(tmp_path / "b.csv"), "Inventory": str(tmp_path / "b.csv")}
    got = readers.sheets(spark, files, r"Sales \d+").select("sheet", "date", "sale amt").collect()
    assert sorted(map(tuple, got)) == [("Sales 2024", "3/7/25", "$1.00"), ("Sales 2025", "3/8/25", "$2.00")]
    with pytest.raises(BadArgument):
        readers.sheets(spark, files, "Nope")
    assert len(readers.sample(files, spark, 1)) == 3


def test_register(spark):
    raw = spark.createDataFrame([("o1", "L1", None, "OPEN", "POS", 1100, 100, 50, 50, "2024-01-01T10:00:00Z")], "id string, location_id string, customer_id string, state string, source string, total_money long, total_tax_money long, total_tip_money long, total_discount_money long, created_at string")
    r = readers.register_orders(raw).first()
    assert (r.status, r.channel, float(r.subtotal), float(r.total)) == ("open", "in_store", 10.0, 11.0) and readers.register_orders(raw, ("L1",)).first().channel == "event"
    moves = spark.createDataFrame([("m", "v", "L", a, b, q, "2024-01-01T00:00:00Z") for a, b, q in ((None, "IN_STOCK", "2"), ("IN_STOCK", "SOLD", "0.5"), ("X", "Y", "junk"))], "id string, variation_id string, location_id string, from_state string, to_state string, quantity string, occurred_at string")
    assert [(r["kind"], float(r.quantity)) for r in readers.register_movements(moves).collect()] == [("received", 2.0), ("sold", 0.5), ("adjusted", 0.0)]
    pay = spark.createDataFrame([("p", "o1", 1250, None, "EXTERNAL", "2024-01-01T00:00:00Z")], "id string, order_id string, amount_money long, tip_money long, source_type string, created_at string")
    assert [(float(r.amount), float(r.tip), r.tender) for r in readers.register_payments(pay).collect()] == [(12.5, 0.0, "other")]
    cats = spark.createDataFrame([("1", "x", "y"), ("2", "y", None)], "id string, external_id string, parent_external_id string")
    assert {r.id: r.parent_id for r in readers.with_parents(cats).collect()} == {"1": "2", "2": None}


def test_documents_and_products(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n# Policy  one\ntext")
    (tmp_path / "b.txt").write_text(" ")
    (tmp_path / "c.pdf").write_text("x")
    assert {r.filename: r.title for r in readers.text_documents(spark, str(tmp_path)).collect()} == {"a.md": "Policy  one", "b.txt": "b"}
    shop = binding.shop(spark, "/root/testdata/sf0.001")
    texts = readers.product_texts(shop.variants, shop.levels)
    assert texts.filter(F.col("content").contains("Price: $") & F.col("content").contains("Variants: ")).count() == texts.count() > 0
    readers.write_csv(texts, str(tmp_path / "out"))
    assert spark.read.option("multiLine", True).csv(str(tmp_path / "out"), header=True).count() == texts.count()


def test_schedules():
    now = dt.datetime(2024, 3, 10, 12, tzinfo=dt.UTC)  # New York changes its clocks on this day
    ny = "America/New_York"
    assert jobs.Schedule("daily", hour=6).last_due(ny, now) == dt.datetime(2024, 3, 10, 10, tzinfo=dt.UTC)
    assert jobs.Schedule("hourly", minute=5).last_due(ny, now) == dt.datetime(2024, 3, 10, 11, 5, tzinfo=dt.UTC)
    assert jobs.Schedule("weekly", hour=7, weekday=0).last_due(ny, now) == dt.datetime(2024, 3, 4, 12, tzinfo=dt.UTC)
    assert jobs.Schedule("monthly", hour=6, day=15).last_due(ny, now) == dt.datetime(2024, 2, 15, 11, tzinfo=dt.UTC)
    assert not jobs.Schedule("weekly", hour=7).due_within(ny, dt.timedelta(days=1), now)


def test_jobs(spark):
    t = dt.datetime
    runs = spark.createDataFrame([("sync", t(2024, 1, 1), t(2024, 1, 1), "running"), ("sync", t(2024, 1, 2), t(2024, 1, 2), "succeeded")], "job string, due_at timestamp, started_at timestamp, status string")
    assert jobs.swept(runs, F.lit("2024-01-01 12:00:00").cast("timestamp")).filter("status = 'failed'").count() == 1
    assert jobs.last_succeeded(runs).first().due_at == t(2024, 1, 2)
    assert jobs.claim(runs, spark.createDataFrame([("sync", t(2024, 1, 2)), ("sync", t(2024, 1, 3))], "job string, due_at timestamp")).count() == 1
    sent = spark.createDataFrame([("a", t(2024, 1, 2, 3)), ("a", t(2024, 1, 2, 12))], "recipient string, sent_at timestamp")
    assert jobs.sent_today(sent, dt.date(2024, 1, 2), "America/New_York").first().sent == 1
    orders = spark.createDataFrame([(1, None, "draft"), (2, 7, "draft"), (3, None, "sent")], "id int, vendor_id int, status string")
    got = jobs.replaced_drafts(orders, spark.createDataFrame([(4, None, "draft")], "id int, vendor_id int, status string"))
    assert {r.id: r.status for r in got.collect()} == {1: "canceled", 2: "draft", 3: "sent", 4: "draft"}
    answers = spark.createDataFrame([("a", True, 0.01, float(i)) for i in range(20)], "tenant string, passed boolean, cost double, seconds double")
    assert jobs.eval_summary(answers).first().p95_seconds == 18.0


def test_row_numbers_of_any_splits(spark, tmp_path):
    """A sheet's rows keep their numbers whether it is read in one split or in hundreds."""
    lines = ["Key,Row,Note"] + [f"k{i},x,{'y' * (i % 50)}" if i % 10 else ",," for i in range(4000)] + ["TOTAL,,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("key\nonly\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    found = {}
    try:
        for size in ("128m", "20k", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            df = readers.sheets(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}, "A|B")
            found[size] = sorted((r.sheet, r.row, r.key) for r in df.collect())
            many = spark.read.csv(str(tmp_path / "a.csv"), header=True).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert many > 20
    want = sorted([("A", i + 2, f"k{i}") for i in range(4000) if i % 10] + [("B", 2, "only")])
    assert found == dict.fromkeys(found, want)
