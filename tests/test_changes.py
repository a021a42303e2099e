"""The change feed as a source: page ends, ranges read side by side, and streams that are stopped and started again."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.sources.changes import ChangeFeed


class Server:
    """Pages of `changes`; a cursor that stands still from `stuck` on; one 503 for every page at first, if `busy`."""

    def __init__(self):
        self.changes, self.stuck, self.busy, self.asked = [], None, set(), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                query = parse_qs(urlparse(self.path).query)
                since, limit = int(query["since"][0]), int(query["limit"][0])
                if self.headers.get("Authorization") != "Bearer t":
                    self.send_error(401)
                elif since in outer.busy:
                    outer.busy.discard(since)
                    self.send_response(503)
                    self.send_header("retry-after", "0")
                    self.end_headers()
                else:
                    outer.asked.append(since)
                    rows = [c for c in outer.changes if c["lsn"] > since][:limit]
                    next_lsn = rows[-1]["lsn"] if rows else since
                    body = json.dumps({"changes": rows, "next_lsn": since if outer.stuck is not None and since >= outer.stuck else next_lsn}).encode()
                    self.send_response(200)
                    self.end_headers()
                    self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def add(self, *numbers):
        self.changes += [{"path": f"n/{i}.md", "lsn": i, "modified": "m"} for i in numbers]


@pytest.fixture
def server(spark):
    spark.dataSource.register(ChangeFeed)
    s = Server()
    yield s
    s.http.shutdown()


def source(reader, server, **options):
    url = f"http://127.0.0.1:{server.http.server_port}/changes?since={{since}}&limit={{limit}}"
    for k, v in ({"url": url, "token": "t", "limit": 10} | options).items():
        reader = reader.option(k, v)
    return reader.format("tidemark_changes").load()


def seqs(df):
    return sorted(r.change_seq for r in df.collect())


def test_batch(spark, server):
    every = list(range(3, 200, 3))
    server.add(*every)
    df = source(spark.read, server)
    assert seqs(df) == every and df.columns == ["path", "change_seq", "file_mtime", "modified", "indexed_at"]
    assert seqs(source(spark.read, server, since=30)) == [i for i in every if i > 30]
    parted = source(spark.read, server, since=7, until=150, parts=5)
    assert parted.rdd.getNumPartitions() == 5 and seqs(parted) == [i for i in every if 7 < i <= 150]
    assert seqs(source(spark.read, server, since=50, until=50, parts=3)) == []
    server.busy = {0, 30}
    assert seqs(source(spark.read, server)) == every
    with pytest.raises(Exception, match="401"):
        source(spark.read, server, token="wrong").collect()


def test_a_standing_cursor_ends_the_feed(spark, server):
    server.add(*range(1, 100))
    server.stuck = 20
    assert seqs(source(spark.read, server)) == list(range(1, 31))


def test_empty_feed(spark, server):
    assert seqs(source(spark.read, server)) == []


def test_restarted_stream_gives_each_change_once(spark, server, tmp_path):
    def run():
        q = source(spark.readStream, server, pages=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return seqs(spark.read.schema(q_schema).parquet(str(tmp_path / "out")))

    q_schema = source(spark.readStream, server).schema
    server.add(*range(1, 56))
    assert run() == list(range(1, 56))
    assert run() == list(range(1, 56))
    server.add(*range(60, 90, 2))
    server.asked.clear()
    assert run() == [*range(1, 56), *range(60, 90, 2)]
    assert min(server.asked) >= 50  # earlier pages are not asked for again


def test_an_uncommitted_batch_is_read_again(spark, server, tmp_path):
    server.add(*range(1, 41))
    seen = []

    def fail_once(batch, number):
        rows = seqs(batch)
        if not seen:
            seen.append(("failed", number, rows))
            raise RuntimeError("lost")
        seen.append(("done", number, rows))

    for _ in range(2):
        q = source(spark.readStream, server, pages=3).writeStream.foreachBatch(fail_once).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        except Exception:
            pass
        finally:
            q.stop()
    assert seen[0] == ("failed", 0, seen[1][2]) and seen[1][:2] == ("done", 0)
    assert sum((rows for kind, _, rows in seen if kind == "done"), []) == list(range(1, 41))
