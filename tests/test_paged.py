import datetime as dt
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql.types import StructType

from tallyspark.context import BadArgument
from tallyspark.sources import paged, readers
from tallyspark.streaming.store import KeyedStore

ENTITIES = {"orders": paged.Entity("id string, total long, updated_at string"), "vendors": paged.Entity("id string", None)}
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


class Api:
    """A shop's API with pages of ten, in the order of update times and ids."""

    def __init__(self):
        self.orders, self.asked, self.busy = [], [], 0
        self.lock = threading.Lock()
        api = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with api.lock:
                    api.answer(self)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def add(self, *rows):
        self.orders += [{"id": i, "total": total, "updated_at": (START + dt.timedelta(minutes=minute)).isoformat(), "note": "kept"} for i, total, minute in rows]

    def answer(self, request):
        where = urlparse(request.path)
        query = {k: v[0] for k, v in parse_qs(where.query).items()}
        self.asked.append((where.path, query))
        if request.headers["Authorization"] != "Bearer s3cret":
            return self.send(request, 401, {})
        if self.busy:
            self.busy -= 1
            return self.send(request, 503 if self.busy % 2 else 429, {}, {"Retry-After": "0.01"})
        if where.path == "/vendors":
            return self.send(request, 200, {"items": [{"id": "v1"}, {"id": "v2"}]})
        if where.path != "/orders" and where.path != "/orders/newest":
            return self.send(request, 404, {"error": "no such path"})
        rows = sorted(self.orders, key=lambda r: (r["updated_at"], r["id"]))
        if where.path.endswith("newest"):
            return self.send(request, 200, {"updated_at": rows[-1]["updated_at"] if rows else None})
        rows = [r for r in rows if r["updated_at"] >= query.get("begin_time", "")]
        if "cursor" in query:
            at, i = query["cursor"].split("|")
            rows = [r for r in rows if (r["updated_at"], r["id"]) > (at, i)]
        page, more = rows[:10], len(rows) > 10
        return self.send(request, 200, {"items": page, "cursor": f"{page[-1]['updated_at']}|{page[-1]['id']}" if more else None})

    @staticmethod
    def send(request, code, body, headers=None):
        data = json.dumps(body).encode()
        request.send_response(code)
        for k, v in {"Content-Length": str(len(data)), **(headers or {})}.items():
            request.send_header(k, v)
        request.end_headers()
        request.wfile.write(data)


@pytest.fixture
def api():
    out = Api()
    yield out
    out.server.shutdown()


@pytest.fixture
def pages(spark):
    out = paged.http_pages("till", ENTITIES, {"orders": "orders", "vendors": "vendors"}, size=10)
    paged.use(spark, out)
    return out


def _options(api, **more):
    return {"url": api.url, "token": "s3cret", "interval": "0", "entity": "orders", **more}


def test_every_split_reads_the_same(spark, api, pages):
    api.add(*((f"o{i:03}", i, i // 3) for i in range(137)))
    for parts in (1, 3, 8, 40):
        got = spark.read.format("till").options(**_options(api, partitions=str(parts))).load()
        assert got.columns == ["id", "total", "updated_at", "raw", "cursor"]
        rows = got.collect()
        assert sorted(r.id for r in rows) == [f"o{i:03}" for i in range(137)]
        assert got.rdd.getNumPartitions() == parts
    assert json.loads(rows[0].raw)["note"] == "kept"
    since = spark.read.format("till").options(**_options(api, since=(START + dt.timedelta(minutes=40)).isoformat())).load()
    assert sorted(r.id for r in since.collect()) == [f"o{i:03}" for i in range(120, 137)]
    until = (START + dt.timedelta(minutes=2)).isoformat()
    assert spark.read.format("till").options(**_options(api, until=until)).load().count() == 9
    assert spark.read.format("till").options(**_options(api, entity="vendors")).load().count() == 2


def test_a_window_is_read_again_alone(api, pages):
    api.add(*((f"o{i:03}", i, i) for i in range(100)))
    source = paged.data_source(pages)(_options(api, partitions="5"))
    reader = source.reader(StructType.fromDDL("id string, cursor string"))
    windows = reader.partitions()
    assert len(windows) == 5
    api.asked.clear()
    first, again = (sorted(reader.read(windows[2])) for _ in range(2))
    assert first == again and 19 <= len(first) <= 21
    assert all(q["begin_time"] == windows[2].begin for _, q in api.asked) and len(api.asked) <= 6


def test_a_chain_goes_on_from_its_cursor(spark, api, pages):
    api.add(*((f"o{i:03}", i, i) for i in range(45)))
    rows = sorted(spark.read.format("till").options(**_options(api, partitions="1")).load().collect(), key=lambda r: r.id)
    left = rows[12].cursor  # behind the second page
    rest = spark.read.format("till").options(**_options(api, cursor=left)).load().collect()
    assert sorted(r.id for r in rest) == [f"o{i:03}" for i in range(20, 45)]


def test_busy_and_refusing_sources(spark, api, pages):
    api.add(("a", 1, 0))
    api.busy = 3
    assert spark.read.format("till").options(**_options(api)).load().count() == 1
    with pytest.raises(Exception, match="does not accept the token"):
        spark.read.format("till").options(**_options(api, token="x")).load().count()
    with pytest.raises(paged.SourceError, match="failed with 404"):
        paged.request(f"{api.url}/nowhere", "s3cret", interval=0)
    api.busy, waits = 99, []
    with pytest.raises(paged.SourceError, match="still fails after 3"):
        paged.request(f"{api.url}/orders", "s3cret", attempts=3, wait=waits.append)
    assert waits[0] == paged.MIN_INTERVAL and 0.0075 <= waits[1] <= 0.0125
    with pytest.raises(Exception, match="has no 'nothing'"):
        spark.read.format("till").options(**_options(api, entity="nothing")).load()
    silent = []
    with pytest.raises(paged.SourceError, match="URLError"):
        paged.request("http://127.0.0.1:9/x", "s3cret", attempts=4, wait=silent.append)
    assert len(silent) == 8 and silent[-1] > silent[1]


def test_a_cursor_that_does_not_move(api):
    stuck = paged.Pages("stuck", ENTITIES, lambda c, e, b, cursor: ([], "same"), lambda c, e: None)
    with pytest.raises(paged.SourceError, match="came twice"):
        list(paged.walk(stuck, {}, "vendors", StructType.fromDDL("id string"), paged.Window()))


def test_empty_source(spark, api, pages):
    assert spark.read.format("till").options(**_options(api)).load().count() == 0


def test_stream_into_the_store_resumes(spark, api, pages, tmp_path):
    """A restarted stream asks for what is new, and the store absorbs the border's records."""
    schema = StructType.fromDDL("id string, total long, updated_at string")
    store = KeyedStore(spark, str(tmp_path / "store"), schema, ["id"], ["updated_at"], parts=4)

    def run():
        changes = spark.readStream.format("till").options(**_options(api, partitions="3")).load()
        store.follow(changes.select("id", "total", "updated_at"), str(tmp_path / "cp")).awaitTermination()
        return {r.id: r.total for r in store.read().collect()}

    api.add(*((f"o{i:03}", i, i) for i in range(60)))
    want = {f"o{i:03}": i for i in range(60)}
    assert run() == want
    api.asked.clear()
    assert run() == want and Counter(p for p, _ in api.asked)["/orders"] <= 1  # nothing new: no page is read but the first time's
    api.add(("o003", 300, 70), ("new", 1, 71), ("o003", 301, 72))
    api.orders = [r for r in api.orders if (r["id"], r["total"]) != ("o003", 300)]  # the source has the last version alone
    api.asked.clear()
    assert run() == want | {"o003": 301, "new": 1}
    begins = [q["begin_time"] for p, q in api.asked if p == "/orders" and "begin_time" in q]
    assert begins and min(begins) == (START + dt.timedelta(minutes=59)).isoformat()


def test_registry_of_adapters(spark, api, pages):
    readers.register("till", readers.Adapter(lambda s, c, e: paged.read(s, "till", c, e), "a shop's till", frozenset({"orders"})))
    api.add(("a", 1, 0), ("b", 2, 1))
    seen = {}
    config = {k: v for k, v in _options(api).items() if k != "entity"}
    errors = readers.load_entities(spark, readers.adapter("till"), config, ("orders", "refunds", "vendors"), lambda e, df: seen.update({e: df.count()}))
    assert seen == {"orders": 2, "vendors": 2} and list(errors) == ["refunds"]


def test_streams_need_an_update_time(api, pages):
    with pytest.raises(BadArgument, match="can't be streamed"):
        paged.data_source(pages)(_options(api, entity="vendors")).streamReader(StructType.fromDDL("id string"))
