"""Stores, journal files and lineage (SRC-3..5, SRC-8, AGG-8/9, DEC-10, DEC-13, KV, SNK-3/8 rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.operators import reconcile as R
from tidemark.operators import stash as K
from tidemark.operators import stores as St
from tidemark.plans.registry import query
from tidemark.plans.staging import shared_dir
from tidemark.sources import fixtures as X
from tidemark.sources import journals as J
from tidemark.sources.fixtures import with_sql
from tidemark.sources.tables import table

_HEAD, _TAIL = '{"schema_version":1,', '"path":"{p}","action":"{a}","content_sha":"{c}","queued_at":"{q}","device_id":"d"}'
#: Lines that live, lines that are skipped, and lines that end a file; {i} {p} {a} {c} {q} id, path, action, hash and time.
LIVE = (
    _HEAD + '"id":"{i}",' + _TAIL, _HEAD + '"id":"",' + _TAIL, _HEAD + _TAIL, _HEAD + '"id":"{i}","base_hash":null,"content_bytes":null,"more":[1],' + _TAIL,
    _HEAD + '"id":"{i}","base_hash":"","content_bytes":"aGk=",' + _TAIL, '  ' + _HEAD + '"id":"{i}","base_hash":"b1","content_bytes":[104,0,255],' + _TAIL + '  ', _HEAD + '"content_bytes":[],"id":"{i}",' + _TAIL,
)
SKIPPED = (
    "  ", "\t \u00a0", '{"schema_version":2,"id":"x"}', '{"schema_version":0,' + _TAIL, '{"schema_version":4294967295,' + _TAIL, '{"schema_version":1,"id":"x"}',
    _HEAD + '"path":5,"action":"{a}","content_sha":"{c}","queued_at":"{q}","device_id":"d"}', _HEAD + '"path":"{p}","action":"{a}","content_sha":"{c}","device_id":"d"}', _HEAD + _TAIL.replace("{q}", "q"),
    _HEAD + _TAIL.replace("{q}", "2026-13-40T00:00:00Z"), _HEAD + _TAIL.replace("{a}", "rename"), _HEAD + _TAIL.replace("{a}", "Create"), _HEAD + _TAIL.replace('"{c}"', "null"), _HEAD + _TAIL.replace(',"device_id":"d"', ""),
    _HEAD + '"id":null,' + _TAIL, _HEAD + '"id":7,' + _TAIL, _HEAD + '"base_hash":7,' + _TAIL, _HEAD + '"content_bytes":"***",' + _TAIL, _HEAD + '"content_bytes":[256],' + _TAIL, _HEAD + '"content_bytes":["a"],' + _TAIL,
)
ENDING = (
    '{"schema', '{"schema_version":-1,"id":"x"}', '{"schema_version":"1",' + _TAIL, '{"schema_version":1.0,' + _TAIL, '{"schema_version":4294967296,' + _TAIL, "{" + _TAIL, "null", "7",
    _HEAD + _TAIL + " x", _HEAD + _TAIL + _HEAD + _TAIL, _HEAD + _TAIL + "," + _HEAD + _TAIL, _HEAD + _TAIL + "}]", _HEAD + _TAIL + "\x00", '{"schema_version":null,' + _TAIL,
)


#: kind 0 lives, 1 is skipped, 2 ends the file (the last of them by a byte that is no UTF-8).
_KIND = "CASE WHEN event_id % 1009 = 0 AND event_id % 4 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"
_SHAPE = f"CASE {_KIND} WHEN 0 THEN event_id % {len(LIVE)} WHEN 1 THEN event_id // 5 % {len(SKIPPED)} ELSE event_id // 4036 % {len(ENDING) + 1} END"


def _lines(spark, sf):
    """file, n (its order there) and line as bytes; lines of odd files end in CR."""
    e = F.col("event_id")
    kind = F.expr(_KIND)
    shape = F.when(kind == 0, e % len(LIVE)).when(kind == 1, F.floor(e / 5) % len(SKIPPED)).otherwise(F.floor(e / 4036) % (len(ENDING) + 1)).cast("int")
    of = lambda texts: F.get(F.array(*map(F.lit, texts)), shape)
    line = F.when(kind == 0, of(LIVE)).when(kind == 1, of(SKIPPED)).otherwise(of((*ENDING, "")))
    at = F.date_format(F.col("queued_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    for mark, value in (("{i}", e.cast("string")), ("{p}", F.col("path")), ("{a}", F.col("action")), ("{c}", F.col("content_sha")), ("{q}", at)):
        line = F.replace(line, F.lit(mark), value)
    broken = (kind == 2) & (shape == len(ENDING))
    raw = F.concat(F.encode(line, "UTF-8"), F.when(broken, F.lit(b"\xff")).otherwise(F.lit(b"")))
    return X.journal(spark, sf).select((e % 64).alias("file"), e.alias("n"), raw.cast("string").alias("line"))


_SRC3_SQL = with_sql(f"""WITH l AS (SELECT event_id % 64 AS file, row_number() OVER (PARTITION BY event_id % 64 ORDER BY event_id) AS line_no, event_id, path, action, content_sha, queued_at, {_KIND} AS kind, {_SHAPE} AS shape FROM journal),
 s AS (SELECT file, min(line_no) AS stop FROM l WHERE kind = 2 GROUP BY file)
 SELECT l.file, line_no, CASE WHEN shape IN (1, 2) THEN 'legacy-' || left(sha256(path || chr(31) || content_sha || chr(31) || epoch_us(queued_at::TIMESTAMP) || chr(31) || action), 16) ELSE event_id::VARCHAR END AS id, path, action,
  CASE shape WHEN 4 THEN '' WHEN 5 THEN 'b1' END AS base_hash, content_sha
 FROM l LEFT JOIN s ON l.file = s.file WHERE (stop IS NULL OR line_no < stop) AND kind = 0""", "journal")


@query("src3_journal_lines", _SRC3_SQL)
def src3(spark, sf):
    number = F.row_number().over(Window.partitionBy("file").orderBy("n")).cast("long")
    return St.journal_lines(_lines(spark, sf).withColumn("line_no", number))


@query("src3_kv6_journal_files", _SRC3_SQL)
def src3_files(spark, sf):
    """The lines written to files, one a journal, some with CR and LF, and read back from them."""
    path = f"{shared_dir(spark)}/journals-{uuid.uuid4().hex}"
    ended = F.when(F.col("file") % 2 == 1, F.concat("line", F.lit("\r"))).otherwise(F.col("line"))
    rows = _lines(spark, sf).repartition("file").sortWithinPartitions("file", "n")
    rows.select(F.col("file").alias("journal"), ended.alias("value")).write.partitionBy("journal").option("lineSep", "\n").text(path)
    entries, _ = J.open_journal(spark, path)
    return entries.withColumn("file", F.regexp_extract("file", "journal=([0-9]+)", 1).cast("long"))


def _store_files(spark, sf):
    """One JSON object for each source, every seventh broken, every eleventh missing."""
    d = table(spark, sf, "documents")
    entry = F.concat(F.lit('"'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('.md":"'), F.sha2("lang", 256), F.lit('"'))
    one = d.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 7 == 0, F.lit('{"a":')).when(F.col("doc_id") % 11 != 0, F.concat(F.lit("{"), entry, F.lit(',"k":"v"}'))).alias("body"))
    return one


@query("src4_src5_map_store", """SELECT doc_id AS file, unnest([source || '/' || doc_id || '.md', 'k']) AS key, unnest([sha256(lang), 'v']) AS value FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""")
def src4_src5(spark, sf):
    return St.map_store(_store_files(spark, sf))


@query("src8_diagnose", """SELECT doc_id, doc_id % 3 <> 0 AS failed, CASE doc_id % 3 WHEN 1 THEN 9 WHEN 2 THEN 300 END::INT AS size, CASE WHEN doc_id % 3 = 2 THEN repeat('x', 256) END AS sample, CASE WHEN doc_id % 3 = 0 THEN 'p' END AS path FROM documents""")
def src8(spark, sf):
    d = F.col("doc_id")
    body = F.when(d % 3 == 0, F.lit('{"path":"p"}')).when(d % 3 == 1, F.lit('{"q":"p"}')).otherwise(F.repeat(F.lit("x"), 300))
    return St.diagnose(table(spark, sf, "documents").select("doc_id", body.alias("body")), "path STRING").drop("body")


_KEYS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/n' || (doc_id % 90) || '.md' WHEN 1 THEN source || '\\n' || (doc_id % 90) || '.md' ELSE 'n' || (doc_id % 90) || '.md' END AS key FROM documents"


def _keyed(spark, sf):
    n = F.concat(F.lit("n"), (F.col("doc_id") % 90).cast("string"), F.lit(".md"))
    key = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/"), n)).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("\\"), n)).otherwise(n)
    return table(spark, sf, "documents").select(key.alias("key"), F.col("doc_id").alias("id"))


_CANON = f"""WITH k AS (SELECT key, min(doc_id) AS value FROM ({_KEYS}) GROUP BY key), c AS (SELECT key, value, replace(key, '\\', '/') AS p FROM k),
 d AS (SELECT key, value, CASE WHEN split_part(p, '/', 1) IN ('src0', 'src1', 'src2') AND contains(p, '/') THEN substr(p, strpos(p, '/') + 1) ELSE p END AS n FROM c)"""


@query("agg9_migrate_keys", _CANON + " SELECT n AS key, value FROM d QUALIFY row_number() OVER (PARTITION BY n ORDER BY key <> n, key) = 1")
def agg9_kv5(spark, sf):
    """Canonical keys win; among old ones the smallest (the reference leaves that open)."""
    store = _keyed(spark, sf).groupBy("key").agg(F.min("id").alias("value"))
    return St.migrate_keys(store, X.FOLDERS)


@query("agg8_scope_suspect", f"SELECT nullif(count(*) FILTER (WHERE contains(key, '/')), 0)::BIGINT AS suspect FROM ({_KEYS})")
def agg8(spark, sf):
    return St.scope_suspect(_keyed(spark, sf), ())


_WRITES = "SELECT event_id AS line_no, 'p' || (user_id % 50) AS path, (event_id // 300) % 5 + user_id % 2 AS seq, CASE WHEN event_type = 'click' THEN 'adopted' ELSE 'observed' END AS prov FROM events"


@query("dec10_lineage", f"""WITH w AS ({_WRITES}), n AS (SELECT *, coalesce((lag(seq) OVER (PARTITION BY path ORDER BY line_no) <> seq)::INT, 1) AS new FROM w),
 r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_no) AS run FROM n), m AS (SELECT *, max(run) OVER (PARTITION BY path) AS last FROM r)
 SELECT path, max(seq) AS seq, CASE WHEN bool_or(prov = 'adopted') THEN 'adopted' ELSE 'observed' END AS prov FROM m WHERE run = last GROUP BY path""")
def dec10_kv2(spark, sf):
    """Tests hold it against the plain loop."""
    seq = F.floor(F.col("event_id") / 300) % 5 + F.col("user_id") % 2
    prov = F.when(F.col("event_type") == "click", "adopted").otherwise("observed")
    return St.lineage(table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("path"), seq.alias("seq"), prov.alias("prov")))


@query("dec13_conflict_refetch", with_sql("""SELECT j.event_id, CASE WHEN s.fs_hash IS NULL THEN CASE WHEN action = 'delete' THEN 'accept_delete' ELSE 'recreate_no_row' END
 WHEN s.doc_id % 3 <> 0 AND s.doc_id % 4 <> 3 THEN 'receipt_and_merge' ELSE 'merge' END AS action
 FROM (SELECT event_id, action, event_id % 1200 AS doc_id FROM journal) j LEFT JOIN (SELECT s.doc_id, min(s.fs_hash) AS fs_hash FROM server_state s GROUP BY s.doc_id) s ON s.doc_id = j.doc_id""", "journal", "server_state"))
def dec13(spark, sf):
    """Refused pushes of the journal against the notes fetched again; a receipt needs the declared hash, the head and a sequence."""
    d = F.col("doc_id")
    fetched = X.server_state(spark, sf).groupBy("doc_id").agg(F.min("fs_hash").alias("fs_hash"), F.max("change_seq").alias("change_seq"))
    fetched = fetched.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    receipt = S.receipt(F.col("text"), F.when(d % 3 == 0, "x").otherwise(F.sha2("text", 256)), F.when(d % 4 == 3, "y").when(d % 4 == 2, F.sha2("text", 256)), F.col("change_seq"))
    fetched = fetched.select("doc_id", F.lit(True).alias("found"), receipt.alias("receipt"))
    refused = X.journal(spark, sf).select("event_id", "action", (F.col("event_id") % 1200).alias("doc_id"))
    rows = refused.join(fetched, "doc_id", "left").select("event_id", "action", F.coalesce("found", F.lit(False)).alias("found"), "receipt")
    return rows.select("event_id", R.after_conflict(F.col("found"), F.col("action"), F.col("receipt")).alias("action"))


@query("fn3_stash_positions", with_sql("SELECT l.path, coalesce(b.seq, 0) AS lsn FROM local_manifest l LEFT JOIN base_seq b ON l.path = b.path", "local_manifest", "server_state", "base_seq"))
def fn3(spark, sf):
    return R.stash_positions(X.local_manifest(spark, sf), X.base_seq(spark, sf)).select("path", "lsn")


@query("snk8_stash_manifest", """SELECT '{"original":"' || source || '/' || doc_id || '.md","stash":"' || source || '/' || doc_id || '.conflict-from-dev-a-' || doc_id || '.md","device":"dev-a","lsn":' || doc_id || ',"ts":' || (1700000000 + doc_id) || '}' AS line FROM documents""")
def snk8(spark, sf):
    """The lines that a pass appends for its stashes; written to a folder and read again."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".conflict-from-dev-a-"), F.col("doc_id").cast("string"), F.lit(".md"))
    stashes = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("original"), F.concat("source", F.lit("\\"), name).alias("stash"), F.lit(X.DEVICE).alias("device"),
        F.col("doc_id").alias("lsn"), (F.lit(1_700_000_000).cast("long") + F.col("doc_id")).alias("ts"),
    )
    folder = f"{shared_dir(spark)}/stash-manifest-{uuid.uuid4().hex}"
    for half in (0, 1):
        St.record_stash_manifest(stashes.filter(F.col("lsn") % 2 == half), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("snk3_kv5_rewrite", with_sql("SELECT path, server_hash FROM shadow WHERE server_hash >= '8'", "local_manifest", "server_state", "shadow"))
def snk3_kv5(spark, sf):
    """A store saved, rewritten whole, and saved again unchanged, which writes nothing; then its current version."""
    folder, schema = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "path STRING, server_hash STRING"
    St.save(X.shadow(spark, sf), folder)
    St.save(St.load(spark, folder, schema).filter("server_hash >= '8'"), folder)
    St.save_if_changed(X.shadow(spark, sf).filter("server_hash >= '8'"), folder, schema)
    return St.load(spark, folder, schema)


#: Losing texts of notes of few names, many of them equal, and the files that lie there already, some under numbers.
_LOSING = """SELECT doc_id AS ord, source || CASE WHEN doc_id % 50 = 49 THEN '/../' ELSE '/' END || CASE WHEN doc_id % 40 = 7 THEN repeat('long', 70) ELSE 'n' || doc_id % 40 END || '.md' AS path, doc_id % 3 AS lsn,
  CASE WHEN doc_id % 4 = 0 THEN 'same' || doc_id % 8 ELSE text END AS content FROM documents"""


def _losing(spark, sf):
    d = F.col("doc_id")
    note = F.when(d % 40 == 7, "long" * 70).otherwise(F.concat(F.lit("n"), (d % 40).cast("string")))
    path = F.concat("source", F.when(d % 50 == 49, "/../").otherwise("/"), note, F.lit(".md"))
    content = F.when(d % 4 == 0, F.concat(F.lit("same"), (d % 8).cast("string"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(d.alias("ord"), path.alias("path"), (d % 3).alias("lsn"), content.alias("content"))


def _lying(losing):
    """Conflict copies that were written before: every fifth row's, in slots 1 to 4 of its name."""
    o = F.col("ord")
    name, slot = P.stash_path(F.col("path"), F.lit(X.DEVICE), F.col("lsn")), o % 4 + 1
    path = F.when(slot == 1, name).otherwise(F.concat(F.left(name, F.length(name) - 3), F.lit("-"), slot.cast("string"), F.lit(".md")))
    content = F.when(o % 10 == 0, F.col("content")).otherwise(F.concat(F.lit("other"), (o % 7).cast("string")))
    return losing.filter((o % 5 == 0) & (o % 50 != 49) & F.col("path").isNotNull()).select(path.alias("path"), F.coalesce(content, F.lit("")).alias("content")).groupBy("path").agg(F.min("content").alias("content"))


@query("snk7_join10_stash_write", f"""WITH l AS ({_LOSING}),
 n AS (SELECT *, left(path, strpos(path, '/')) AS dir, substr(path, strpos(path, '/') + 1)[:-4] AS stem, CASE WHEN path IS NULL THEN 'refused' WHEN contains(path, '/../') THEN 'refused' END AS bad FROM l),
 b AS (SELECT ord, path, lsn, sha256(coalesce(content, '')) AS sha, coalesce(content, '') AS content, bad, CASE WHEN bad IS NULL THEN octet_length(encode(stem || '.conflict-from-{X.DEVICE}-' || lsn || '.md')) > 250 ELSE false END AS hashed,
  CASE WHEN bad IS NULL THEN dir || CASE WHEN octet_length(encode(stem || '.conflict-from-{X.DEVICE}-' || lsn || '.md')) > 250 THEN left(stem, 48) || '.' || left(sha256(path), 16) ELSE stem END || '.conflict-from-' END AS family FROM n),
 c AS (SELECT *, family || '{X.DEVICE}-' || lsn || '.md' AS base FROM b),
 e AS (SELECT base[:-4] || CASE WHEN ord % 4 = 0 THEN '' ELSE '-' || (ord % 4 + 1) END || '.md' AS path, family, min(CASE WHEN ord % 10 = 0 THEN content ELSE 'other' || ord % 7 END) AS content FROM c WHERE ord % 5 = 0 AND base IS NOT NULL GROUP BY ALL),
 h AS (SELECT family, sha256(content) AS sha, min(path) AS there FROM e GROUP BY ALL),
 f AS (SELECT c.family, c.sha, min(ord) AS first_ord, arg_min(base, ord) AS base, any_value(there) AS there FROM c LEFT JOIN h ON c.family = h.family AND c.sha = h.sha WHERE c.family IS NOT NULL GROUP BY ALL),
 w AS (SELECT base, first_ord, row_number() OVER (PARTITION BY base ORDER BY first_ord) AS k FROM f WHERE there IS NULL),
 r AS (SELECT base, unnest(range(1, max(k) + 5)) AS slot FROM w GROUP BY base),
 s AS (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY slot) AS k FROM (SELECT base, slot, CASE WHEN slot = 1 THEN base ELSE base[:-4] || '-' || slot || '.md' END AS name FROM r) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = x.name))
 SELECT c.ord, c.path, c.lsn, c.sha, coalesce(f.there, s.name) AS stash, CASE WHEN bad IS NOT NULL THEN bad WHEN f.there IS NOT NULL THEN 'reused' WHEN c.ord = f.first_ord THEN 'written' ELSE 'shared' END AS status, c.hashed
 FROM c LEFT JOIN f ON c.family = f.family AND c.sha = f.sha LEFT JOIN w ON w.first_ord = f.first_ord LEFT JOIN s ON s.base = w.base AND s.k = w.k""")
def snk7_join10_snk8(spark, sf):
    """Tests hold it against the plain loop and follow the files and the manifest lines to disk."""
    losing = _losing(spark, sf)
    return K.place_stashes(losing, _lying(losing), X.DEVICE)
