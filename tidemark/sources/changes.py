"""The change feed of a server as a data source, for batches and streams.

    spark.dataSource.register(ChangeFeed)
    spark.read.format("tidemark_changes").option("url", "https://host/changes?since={since}&limit={limit}").load()
    spark.readStream.format("tidemark_changes").option("url", ...).load()

A page is a JSON object of `changes` (path, lsn and the times) in order of lsn, and of `next_lsn`, the cursor of the page behind it. A feed
ends at an empty page, or where the cursor stands still (the rows of that page count). Pages are fetched by tasks and never
pass the driver. A cursor is known only with the page before it, so one range of the feed is read page by page; a batch with `until` and
`parts` is cut into ranges of sequence numbers that are read side by side, and a micro-batch into the pages that the driver stepped over.

A stream's offset is the last cursor: a restarted query goes on behind it, and a batch that was not committed is read again between
the same two cursors, so each change comes once.

Options: url (with {since} and {limit}), token, limit (5000), since (0), until and parts (batches), pages (64, of a micro-batch), retries (3).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path STRING, change_seq BIGINT, file_mtime DOUBLE, modified STRING, indexed_at STRING"
MAX_WAIT = 60


class Span(InputPartition):
    """Changes behind `since`, up to and with `until` (None: to the end)."""

    def __init__(self, since: int, until: int | None):
        self.since, self.until = since, until


class Pages:
    def __init__(self, options):
        self.url, self.token = options["url"], options.get("token")
        self.limit, self.retries = int(options.get("limit", 5000)), int(options.get("retries", 3))

    def fetch(self, since: int) -> tuple[list[tuple], int]:
        """The rows of one page and the next cursor. A busy server is asked again after the time that it names."""
        request = urllib.request.Request(self.url.replace("{since}", str(since)).replace("{limit}", str(self.limit)))
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=120) as answer:
                    page = json.load(answer)
                break
            except urllib.error.HTTPError as e:
                if e.code != 503 or not left:
                    raise
                wait = e.headers.get("retry-after", "")
                time.sleep(min(int(wait) if wait.isdigit() else MAX_WAIT, MAX_WAIT))
        rows = [(str(c["path"]), int(c["lsn"]), float(c.get("file_mtime", 0)), c.get("modified", ""), c.get("indexed_at", "")) for c in page.get("changes", [])]
        return rows, int(page.get("next_lsn", 0))

    def walk(self, since: int, until: int | None = None) -> Iterator[tuple]:
        while until is None or since < until:
            rows, cursor = self.fetch(since)
            yield from (r for r in rows if until is None or r[1] <= until)
            if not rows or cursor <= since:
                return
            since = cursor


class ChangeReader(DataSourceReader):
    def __init__(self, options):
        self.pages, self.since = Pages(options), int(options.get("since", 0))
        self.until = int(options["until"]) if "until" in options else None
        self.parts = int(options.get("parts", 1)) if self.until is not None else 1

    def partitions(self) -> Sequence[InputPartition]:
        if self.until is None:
            return [Span(self.since, None)]
        width = max(self.until - self.since, 0)
        edges = sorted({self.since + width * i // self.parts for i in range(self.parts + 1)})
        return [Span(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Span | None) -> Iterator[tuple]:
        # an empty range has no partition
        return iter(()) if partition is None else self.pages.walk(partition.since, partition.until)


class ChangeStream(DataSourceStreamReader):
    def __init__(self, options):
        self.pages, self.since, self.most = Pages(options), int(options.get("since", 0)), int(options.get("pages", 64))
        #: The last cursor, and the cursors of pages stepped over that no batch has committed yet.
        self.cursor: int | None = None
        self.steps: list[int] = []

    def initialOffset(self) -> dict:
        return {"since": self.since}

    def latestOffset(self) -> dict:
        if self.cursor is None:
            self.cursor = self.since
        for _ in range(self.most):
            rows, cursor = self.pages.fetch(self.cursor)
            if rows and cursor <= self.cursor:
                # the cursor stands still: what lies behind the last row of the page is asked for next time
                cursor = max(r[1] for r in rows)
            if not rows or cursor <= self.cursor:
                break
            self.cursor = cursor
            self.steps.append(cursor)
        return {"since": self.cursor}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["since"], end["since"]
        if self.cursor is None:  # a restarted query plans its last batch first
            self.cursor = b
        edges = [a, *[s for s in self.steps if a < s < b], b]
        return [Span(x, y) for x, y in zip(edges, edges[1:]) if x < y]

    def read(self, partition: Span | None) -> Iterator[tuple]:
        # an empty range has no partition
        return iter(()) if partition is None else self.pages.walk(partition.since, partition.until)

    def commit(self, end: dict) -> None:
        self.steps = [s for s in self.steps if s > end["since"]]


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeStream(self.options)
