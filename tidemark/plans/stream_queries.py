"""Files, feeds and live guards (SRC-1, SRC-9..11, §2.11 rows). Streams run to the end of their input."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.guard_queries import BREAKER_SQL
from tidemark.plans.registry import query
from tidemark.plans.staging import release, shared_dir
from tidemark.sources import fixtures as X
from tidemark.sources import folders
from tidemark.sources.files import candidate_files, file_manifest
from tidemark.sources.tables import table
from tidemark.streaming import feeds
from tidemark.streaming import materialize as M

_DATA = """'{"path": "src' || (user_id % 20) || '/n' || (event_id % 200) || '.md", "phase": "done", "lsn": ' || event_id || CASE WHEN event_id % 9 = 0 THEN ', "op": "DELETE"' ELSE '' END || '}'"""


def _feed(e):
    n = lambda c: c.cast("string")
    data = F.concat(
        F.lit('{"path": "src'), n(F.col("user_id") % 20), F.lit("/n"), n(F.col("event_id") % 200), F.lit('.md", "phase": "done", "lsn": '), n(F.col("event_id")),
        F.when(F.col("event_id") % 9 == 0, F.lit(', "op": "DELETE"')).otherwise(F.lit("")), F.lit("}"),
    )
    kind = F.when(F.col("event_type") == "view", "lint_complete").otherwise("enrichment_complete")
    return e.select("event_id", kind.alias("event_type"), F.when(F.col("event_id") % 23 == 0, F.lit("{broken")).otherwise(data).alias("data"))


_FEED_SQL = """WITH e AS (SELECT event_id, 'src' || (user_id % 20) || '/n' || (event_id % 200) || '.md' AS path, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'DELETE' ELSE 'UPSERT' END AS op
 FROM events WHERE event_type <> 'view' AND event_id % 23 <> 0 AND NOT starts_with('src' || (user_id % 20), 'src11')) SELECT path, max(seq) AS seq, arg_max(event_id, seq) AS event_id, arg_max(op, seq) AS op FROM e GROUP BY path"""


@query("src9_feed_replay_batch", _FEED_SQL)
def src9(spark, sf):
    return feeds.latest(feeds.decode_feed(_feed(table(spark, sf, "events")), excludes=("src11",)))


@query("src9_feed_replay_stream", _FEED_SQL)
def src9_src10_src11_snk9(spark, sf):
    """The same store from a stream of files, in micro-batches, with its offset in the checkpoint."""
    static = table(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    return feeds.replay(feeds.decode_feed(_feed(stream), excludes=("src11",)), spark, f"feed-{uuid.uuid4().hex}")


def _stream(spark, sf, view):
    """A fixture view over a stream of the events table, in order of time."""
    events = feeds.in_order(table(spark, sf, "events"), ["ts", "event_id"], f"events-{uuid.uuid4().hex}")
    if view == "echo":
        e = events.filter("event_type IN ('click', 'view')")
        sha = F.pmod(F.floor(F.col("value")).cast("long"), F.lit(4))
        return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "record").otherwise("probe").alias("kind"), sha.alias("sha"))
    return events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("user_id") % 8).alias("root"))


def _echo_sql() -> str:
    from tidemark.plans.registry import _SQL
    from tidemark.plans import guard_queries  # noqa: F401

    return _SQL["win3_join6_echo"]


@query("win3_live_echo", _echo_sql())
def win3_live(spark, sf):
    return feeds.drain(feeds.live_echo(_stream(spark, sf, "echo"), 6 * 3600), spark, f"echo-{uuid.uuid4().hex}")


@query("win9_live_breaker", BREAKER_SQL)
def win9_live(spark, sf):
    return feeds.drain(feeds.live_breaker(_stream(spark, sf, "conflicts"), 5, 6 * 3600), spark, f"breaker-{uuid.uuid4().hex}")


@query("win12_live_debounce", """WITH g AS (SELECT event_id, ts, user_id AS key, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new::INT) OVER (PARTITION BY key ORDER BY ts) AS k FROM g) SELECT key, min(ts) AS start, count(*)::BIGINT AS n, max(event_id) AS last_id FROM s GROUP BY key, k
 HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def win12_live(spark, sf):
    """The bursts that are over by the stream's watermark when the feed ends."""
    events = feeds.in_order(table(spark, sf, "events"), ["ts", "event_id"], f"events-{uuid.uuid4().hex}")
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"))
    return feeds.drain(feeds.live_bursts(e, "30 minutes"), spark, f"bursts-{uuid.uuid4().hex}")


_SNK4 = X.with_sql("""WITH j AS (SELECT coalesce(l.path, s.path) AS path, l.content_hash AS own, s.fs_hash AS sent, s.change_seq, s.doc_id % 17 = 0 AS bad, w.server_hash AS base
  FROM local_manifest l FULL JOIN server_state s ON l.path = s.path LEFT JOIN shadow w ON w.path = l.path),
 d AS (SELECT *, CASE WHEN sent IS NULL THEN 'none' WHEN bad THEN 'failed' WHEN own IS NULL THEN 'create' WHEN own = sent THEN 'equal' WHEN base IS NULL THEN 'conflict' WHEN base = sent THEN 'kept' WHEN own = base THEN 'pulled' ELSE 'conflict' END AS d FROM j)
 SELECT path, CASE WHEN d IN ('create', 'conflict', 'pulled') THEN sent ELSE own END AS sha, CASE WHEN d IN ('create', 'conflict', 'pulled', 'equal') THEN sent ELSE base END AS server_hash,
  CASE WHEN d IN ('create', 'conflict', 'pulled', 'equal') THEN change_seq END AS seq, CASE WHEN d = 'equal' THEN 'observed' WHEN d IN ('create', 'conflict', 'pulled') THEN 'adopted' END AS prov,
  CASE WHEN d = 'failed' THEN 1 END::BIGINT AS attempts, CASE WHEN d = 'conflict' THEN path[:-4] || '.conflict-from-dev-a-' || change_seq || '.md' END AS stash, CASE WHEN d = 'conflict' THEN own END AS stashed_sha FROM d""", "local_manifest", "server_state", "shadow")


#: A commit writes all rows of the buckets that it touches (texts only where they are new), and every batch here touches all. So the number of batches
#: is fixed (up to the filling of files) where the table is large, and their size follows it.
COMMITS, ROWS_A_COMMIT = 4, 100_000


@query("snk4_commit_stores", _SNK4)
def snk4(spark, sf):
    """Server notes against local ones, in micro-batches, each written to all stores at once; some come with bytes that are not theirs."""
    base = f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}"
    edited = (F.col("doc_id") % 7 == 0) & ~F.startswith("path", F.lit("remote/"))
    sent = X.server_state(spark, sf, "text").withColumn("content", F.when(F.col("doc_id") % 17 == 0, "cut").when(edited, F.concat("text", F.lit("\nserver-edit"))).otherwise(F.col("text")))
    stream = feeds.in_order(sent.select("path", "content", F.col("fs_hash").alias("server_hash"), F.col("change_seq").alias("seq")), ["seq"], f"sent-{uuid.uuid4().hex}", max(ROWS_A_COMMIT, -(-sent.count() // COMMITS)))
    release(spark)
    local = X.local_manifest(spark, sf, "text").select("path", F.col("text").alias("content"), F.col("content_hash").alias("sha"))
    M.Stores(spark, base).commit({"notes": local, "baseline": X.shadow(spark, sf)}, set(range(M.BUCKETS)), -1)
    release(spark)
    end = M.materialize(stream, spark, base, f"{base}-checkpoint", X.DEVICE)
    stashes = end.read("stashes").select("path", "stash", F.sha2("content", 256).alias("stashed_sha"))
    rows = end.index("notes").select("path", "sha")
    for more in (end.read("baseline"), end.read("lineage"), end.read("ledger").drop("last_error"), stashes):
        rows = rows.join(more, "path", "full")
    return rows


@query("src1_file_scan", None)
def src1_ord1(spark, sf):
    """Files of the folder by name and size; contents are read for none of them."""
    files = candidate_files(spark, sf, roots=(), allowed=(".parquet",))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "decision")


@query("src2_file_manifest", None)
def src2_files(spark, sf):
    """Every file of the folder, hashed whole."""
    return file_manifest(candidate_files(spark, sf, roots=(), allowed=(".parquet",)))


_NOTE = "a' || coalesce(doc_id % 16, 0) || '/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 1 THEN 'rules/' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '._' ELSE 'n' END || coalesce(doc_id::STRING, '') || '-' || left(sha, 8) || CASE WHEN doc_id % 5 = 0 THEN '.conflict-from-dev-a-3' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '.TXT' ELSE '.Md' END"
_TREE = f"""WITH d AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, ''))::BIGINT AS n FROM documents), p AS (SELECT *, '{_NOTE} AS path FROM d),
 o AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'symlink' WHEN doc_id % 7 = 0 THEN 'exclude' WHEN doc_id % 5 = 0 AND path LIKE '%.md' THEN 'conflict_copy' WHEN doc_id % 11 = 0 THEN 'junk' WHEN doc_id % 7 = 1 THEN 'substrate' WHEN doc_id % 3 = 0 THEN 'extension' ELSE 'take' END AS outcome FROM p)
 SELECT path, outcome, CASE WHEN outcome = 'take' THEN sha END AS content_hash, CASE WHEN outcome = 'take' THEN n END AS size_bytes FROM o"""


@query("src1_src2_folder_walk", _TREE)
def src1_src2_walk(spark, sf):
    """All documents as files of a tree, links and refused names among them; walked, tested and hashed on executors."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = d.select(F.expr(f"'{_NOTE}").alias("path"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 13 == 0, "nowhere.md").alias("link"))
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    folders.write_tree(rows, root)
    scanned = folders.scan(spark, root, rules=[("prefix", "rules/", "")])
    hashed = folders.hash_files(scanned.filter("outcome = 'take'"))
    return scanned.select("path", "outcome").join(hashed.select("path", "content_hash", "size_bytes"), "path", "left")


_VIEWS = ("local_manifest", "server_state", "shadow", "base_seq", "journal", "burst_events", "echo_events", "paths", "notes")


@query("entry_fixture_counts", X.with_sql(" UNION ALL ".join(f"SELECT '{v}' AS view, count(*)::BIGINT AS n FROM {v}" for v in _VIEWS), *_VIEWS))
def counts(spark, sf):
    """Rows of each derived view."""
    one = [getattr(X, v)(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n") for v in _VIEWS]
    return reduce(DataFrame.unionByName, one)
