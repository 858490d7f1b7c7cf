import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from flowkit.errors import ConfigError
from flowkit.schema import declared
from flowkit.sinks.rest import rest as post
from flowkit.sources.http import Client, Retry
from flowkit.sources.rest import rest

FAST = {"backoff": 0.01}


@pytest.fixture
def server():
    """A server whose ``answer`` gives (status, object) for each request; requests are recorded."""
    seen, keys = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            size = int(self.headers.get("Content-Length") or 0)
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            seen.append((q, self.rfile.read(size)))
            keys.append(self.headers.get("Idempotency-Key"))
            status, value = httpd.answer(q, len(seen))
            body = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_POST = do_GET

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    httpd.seen, httpd.keys, httpd.url = seen, keys, f"http://127.0.0.1:{httpd.server_port}/x"
    yield httpd
    httpd.shutdown()


SCHEMA = declared([{"name": "id", "type": "long"}, {"name": "buoy", "type": "text"}])


def test_plain_list(spark, server, rows):
    server.answer = lambda q, n: (200, [{"id": 41, "buoy": "north reef"}, {"id": 17, "buoy": None}, {"buoy": "harbour", "depth": 3}])
    assert rows(rest(spark, server.url, SCHEMA)) == [(17, None), (41, "north reef"), (None, "harbour")]


def test_records_path_and_inference(spark, server, rows):
    server.answer = lambda q, n: (200, {"day": {"tides": {"list": [{"height": 2.5, "low": False}, {"height": 0.25, "low": True}]}, "moon": "new"}})
    assert rows(rest(spark, server.url, records_path="day.tides.list")) == [(0.25, True), (2.5, False)]


def test_absent_path_shows_what_came(spark, server):
    server.answer = lambda q, n: (200, {"day": {"moon": "new"}})
    with pytest.raises(Exception, match="day.tides"):
        rest(spark, server.url, SCHEMA, records_path="day.tides").collect()


def test_pages_end_at_the_first_empty_one(spark, server):
    pages = {"1": [{"id": i} for i in range(5)], "2": [{"id": 9}], "3": [{"id": 11}, {"id": 12}]}
    server.answer = lambda q, n: (200, pages.get(q["p"], []))
    assert rest(spark, server.url, SCHEMA, pagination={"type": "page", "param": "p"}).count() == 8
    assert [q["p"] for q, _ in server.seen] == ["1", "2", "3", "4"]


def test_bounded_pages_are_partitions(spark, server):
    server.answer = lambda q, n: (200, [{"id": int(q["p"])}])
    df = rest(spark, server.url, SCHEMA, pagination={"type": "page", "param": "p", "max_pages": 20})
    assert df.rdd.getNumPartitions() == 3 and sorted(r.id for r in df.collect()) == list(range(1, 21))


def test_cursor(spark, server):
    server.answer = lambda q, n: (200, {"tides": [{"id": n}], "more": {"2": "k2", "3": "k3"}.get(str(n + 1))})
    df = rest(spark, server.url, SCHEMA, records_path="tides", pagination={"type": "cursor", "param": "c", "next_path": "more"})
    assert df.count() == 3 and [q for q, _ in server.seen] == [{}, {"c": "k2"}, {"c": "k3"}]


def test_offset_advances_by_rows(spark, server):
    server.answer = lambda q, n: (200, [{"id": int(q["o"]) + i} for i in range(3)] if int(q["o"]) < 9 else [])
    df = rest(spark, server.url, SCHEMA, pagination={"type": "offset", "param": "o"})
    assert sorted(r.id for r in df.collect()) == list(range(9)) and [q["o"] for q, _ in server.seen] == ["0", "3", "6", "9"]


def test_retry(spark, server):
    server.answer = lambda q, n: (503 if n < 3 else 200, [{"id": 1}])
    assert rest(spark, server.url, SCHEMA, retry=FAST).count() == 1 and len(server.seen) == 3


def test_other_errors_fail_at_once(spark, server):
    server.answer = lambda q, n: (401, {})
    with pytest.raises(Exception, match="status 401"):
        rest(spark, server.url, SCHEMA, retry=FAST).collect()


def test_requests_keep_their_distance(server):
    server.answer = lambda q, n: (200, n)
    client, began = Client(per_second=20), time.monotonic()
    for _ in range(5):
        client.send("GET", server.url)
    assert time.monotonic() - began >= 4 / 20 and len(server.seen) == 5


def test_retries_keep_their_distance_too(server):
    server.answer = lambda q, n: (503 if n < 3 else 200, n)
    client, began = Client(Retry(backoff=0.0), per_second=10), time.monotonic()
    assert client.send("GET", server.url) == b"3" and time.monotonic() - began >= 2 / 10


def test_options_are_checked(spark, server):
    with pytest.raises(ConfigError):
        rest(spark, server.url, SCHEMA, pages=3)
    with pytest.raises(ConfigError):
        rest(spark, server.url, SCHEMA, pagination={"type": "cursor", "param": "c"})


def test_post_in_chunks(spark, server):
    server.answer = lambda q, n: (200, {})
    post(spark.range(31).coalesce(1), server.url, rows_per_request=8)
    sent = [json.loads(b) for _, b in server.seen]
    assert sorted(map(len, sent)) == [7, 8, 8, 8] and sorted(r["id"] for part in sent for r in part) == list(range(31))


def test_post_wrapped_and_lines(spark, server):
    server.answer = lambda q, n: (200, {})
    two = spark.createDataFrame([(1, None), (2, "x")], "a long, b string").coalesce(1)
    post(two, server.url, wrap_in="tides")
    post(two, server.url, form="ndjson")
    assert server.seen[0][1].startswith(b'{"tides":[') and json.loads(server.seen[0][1])["tides"][0] == {"a": 1, "b": None}
    assert len(server.seen[1][1].splitlines()) == 2
    with pytest.raises(ConfigError):
        post(two, server.url, form="ndjson", wrap_in="x")


def test_a_write_that_fails_half_way_leaves_each_chunk_once(spark, server):
    """Repeated under its id, a write sends the keys it sent before: a receiver that heeds them has every row once."""
    kept = {}

    def take(q, n):
        if n == 3:
            return 400, {}
        kept.setdefault(server.keys[n - 1], server.seen[n - 1][1])
        return 200, {}

    server.answer = take
    df = spark.range(10).selectExpr("id % 2 AS v").coalesce(1)  # chunks of equal content
    with pytest.raises(Exception, match="400"):
        post(df, server.url, rows_per_request=2, write_id="w1")
    assert len(kept) == 2
    post(df, server.url, rows_per_request=2, write_id="w1")
    assert len(server.seen) == 3 + 5 and len(kept) == 5 and None not in kept
    assert sum(len(json.loads(b)) for b in kept.values()) == 10
    post(df, server.url, rows_per_request=2)
    assert len(kept) == 10  # another write has keys of its own
