import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from larkspan.sources import feeds
from larkspan.sources.snapshots import Snapshots

SEEN = []
FAILS = []


class Feed(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        SEEN.append(query)
        if FAILS:
            self.send_response(FAILS.pop())
            self.send_header("Retry-After", "3")
            self.end_headers()
            return
        first = int(query.get("older", "100"))
        items = [{"id": i, "promoted": i, "image": f"{i}.jpg", "user": "u"} for i in range(first - 1, first - 4, -1)]
        body = json.dumps({"items": items, "atEnd": first <= (40 if query.get("tags") == "many" else 94), "atStart": first == 100}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/items"
    server.shutdown()


def test_paged_feed(spark, address):
    SEEN.clear()
    spark.dataSource.register(feeds.FeedSource)
    rows = spark.read.format("paged_feed").option("url", address).option("tags", "cat").load().collect()
    assert [r.promoted for r in rows] == list(range(99, 90, -1)) and SEEN[0] == {"tags": "cat"} and SEEN[1]["older"] == "97"


def test_a_feed_is_read_to_its_end(spark, address):
    spark.dataSource.register(feeds.FeedSource)
    rows = lambda **o: spark.read.format("paged_feed").options(url=address, tags="many", **o).load().count()
    assert rows() == 63 and rows(pages="2") == 6


def test_retries(address):
    FAILS[:] = [503, 429]
    waits = []
    assert feeds.fetch_page(address, {"older": None}, sleep=waits.append)["items"] and waits == [3.0, 3.0]
    FAILS[:] = [403]
    with pytest.raises(Exception, match="403"):
        feeds.fetch_page(address, {})
    assert [feeds.wait_after(429, {}, n) for n in range(7)] == [2, 4, 8, 16, 32, 60, 60]
    assert feeds.wait_after(429, {"Retry-After": "Thu, 01 Jan 1970 00:01:40 GMT"}, 0, now=40) == 60
    assert feeds.cursor_of([], "id") == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"items": [{"id": 1, "promoted": 100, "image": "a.jpg", "user": "alice"}, {"id": 2, "promoted": 90, "image": "b.png", "user": "bob"}], "atEnd": False, "atStart": True}))
    assert [(r.id, r.promoted, r.user) for r in feeds.landed_items(spark, str(tmp_path / "page.json")).collect()] == [(1, 100, "alice"), (2, 90, "bob")]
    text = spark.createDataFrame([('{"post_id":1,"filename":"f","thumbnail_filename":"t"}',), ("nonsense",)], "value string")
    assert [r[:] for r in feeds.queue_items(text).collect()] == [(1, "f", "t", "")]
    stream = spark.createDataFrame([('data: {"n":1}\n\n: beat\n\ndata: {"n":2}\n\ndata: {"n":',)], "value string")
    assert [r.n for r in feeds.sse_events(stream, "n int").collect()] == [1, 2]
    assert feeds.sse_frames(spark.createDataFrame([(1,)], "n int")).first().value == 'data: {"n":1}\n\n'
    posts = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, False)], "id int, dirty boolean, deleted boolean")
    status = spark.createDataFrame([("2024-01-01 00:00:30", '{"pending":10,"total":20,"running":true,"rate_per_sec":4}')], "ts string, value string").selectExpr("cast(ts as timestamp_ntz) ts", "value")
    fresh = feeds.queue_snapshot(status, posts, "2024-01-01 00:01:00").first()
    stale = feeds.queue_snapshot(status, posts, "2024-01-01 00:02:00").first()
    assert (fresh.pending, fresh.total, fresh.running, fresh.eta_sec) == (10, 20, True, 3) and (stale.pending, stale.running, stale.eta_sec) == (2, False, -1)
    lit = F.lit
    told = spark.range(1).select(feeds.status_row(lit(3), lit(9), lit(6), lit(5), lit(1), lit(True), lit(2.0), lit(2)).alias("value"), F.expr("timestamp_ntz'2024-01-01 00:00:30'").alias("ts"))
    assert feeds.queue_snapshot(told, posts, "2024-01-01 00:01:00").first()[:] == (3, 9, 6, 5, 1, True, 2.0, 2)
    assert spark.range(1).select(feeds.duplicates_row(lit(7), F.array(lit(1), lit(2)))).first()[0] == '{"post_id":7,"duplicates":[1,2]}'
    (tmp_path / "d/skip").mkdir(parents=True)
    (tmp_path / "d/a.bin").write_bytes(b"12345")
    (tmp_path / "d/skip/b.bin").write_bytes(b"1")
    assert feeds.directory_usage(spark, {"all": str(tmp_path / "d")}, ["skip"]).first()[:] == ("all", 5, 1)


def test_snapshots(spark, tmp_path):
    tables = Snapshots(spark, f"file://{tmp_path}/t")
    assert tables.read("x", "n int").count() == 0
    for n in range(3):
        old = tables.read("x", "n int")
        tables.write("x", old.unionByName(spark.createDataFrame([(n,)], "n int")))
    assert sorted(r.n for r in tables.read("x").collect()) == [0, 1, 2]
    assert len(tables.names("data")) == 3 and len(tables.names("manifests")) == 3
