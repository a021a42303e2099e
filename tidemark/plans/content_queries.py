"""Note content and small scalar functions (SCL-3..13, 18..31, PRED-14, FN rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import with_sql
from tidemark.sources.tables import table

_BOM1 = "CASE WHEN starts_with(note, chr(65279)) THEN substr(note, 2) ELSE note END"
_FOLD = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_PULL = _FOLD.format(_BOM1)
#: The block of a text: from an opening `---` line to the next one; '' without.
_BLOCK = "regexp_extract({0}, '(?s)^---\\r?\\n(?:.*?\\n)??---\\r?\\n', 0)"


def _fm_sql(source: str) -> str:
    """doc_id and the comparison form of a text without the fields of STRIP."""
    return f"""src AS (SELECT doc_id, {source} AS s FROM notes), blk AS (SELECT doc_id, s, {_BLOCK.format('s')} AS b FROM src),
 inn AS (SELECT doc_id, s, b, substr(b, 5, length(b) - 4 - CASE WHEN suffix(b, '---' || chr(13) || chr(10)) THEN 5 ELSE 4 END) AS i, substr(s, length(b) + 1) AS body FROM blk),
 lin AS (SELECT doc_id, u.ord AS ord, regexp_replace(u.line, '\\r$', '') AS line FROM inn, unnest(string_split(regexp_replace(i, '\\n$', ''), chr(10))) WITH ORDINALITY AS u(line, ord) WHERE b <> '' AND i <> ''),
 top AS (SELECT *, CASE WHEN NOT starts_with(line, ' ') AND NOT starts_with(line, chr(9)) THEN CASE WHEN contains(line, ':') AND trim(split_part(line, ':', 1)) IN ('modified', 'sha') THEN 1 ELSE 0 END END AS t FROM lin),
 skp AS (SELECT *, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS skip FROM top),
 agg AS (SELECT doc_id, coalesce(string_agg(line || chr(10), '' ORDER BY ord) FILTER (WHERE skip = 0), '') AS kept FROM skp GROUP BY doc_id),
 frm AS (SELECT inn.doc_id, CASE WHEN b = '' THEN s ELSE '---' || chr(10) || CASE WHEN suffix(coalesce(kept, ''), chr(10)) THEN kept ELSE coalesce(kept, '') || chr(10) END || '---' || chr(10) || body END AS form FROM inn LEFT JOIN agg ON inn.doc_id = agg.doc_id)"""


@query("scl3_canonical_form", with_sql(f"SELECT doc_id, CASE WHEN contains(note, chr(0)) THEN NULL ELSE {_FOLD.format('ltrim(note, chr(65279))')} END AS text, CASE WHEN contains(note, chr(0)) THEN 'nul' END AS error FROM notes", "notes"))
def scl3(spark, sf):
    return X.notes(spark, sf).select("doc_id", C.canonical_form(F.col("note").cast("binary")).alias("c")).select("doc_id", "c.text", "c.error")


@query("scl6_pull_form", with_sql("WITH " + _fm_sql(_PULL) + " SELECT doc_id, form, sha256(form) AS sha FROM frm", "notes"))
def scl6_scl9(spark, sf):
    return X.notes(spark, sf).select("doc_id", C.pull_form(F.col("note"), X.STRIP).alias("form")).withColumn("sha", C.sha(F.col("form")))


@query("scl7_push_form", with_sql("WITH " + _fm_sql("note") + " SELECT doc_id, form FROM frm", "notes"))
def scl7(spark, sf):
    return X.notes(spark, sf).select("doc_id", C.push_form(F.col("note"), X.STRIP).alias("form"))


@query("scl4_scl8_scl10_scl11_parts", with_sql(f"""WITH p AS (SELECT doc_id, note, {_BOM1} AS n, {_PULL} AS f FROM notes)
 SELECT doc_id, sha256(note) AS sha, starts_with(n, '---' || chr(10)) OR starts_with(n, '---' || chr(13) || chr(10)) OR n = '---' AS has_block,
 length({_BLOCK.format('f')})::INT AS body_at, substr(f, length({_BLOCK.format('f')}) + 1) AS body FROM p""", "notes"))
def scl4_scl8_scl10_scl11(spark, sf):
    f = C.fold_eol(C.strip_one_bom(F.col("note")))
    n = X.notes(spark, sf).withColumn("body", C.body_only(F.col("note")))
    return n.select("doc_id", C.sha(F.col("note")).alias("sha"), C.has_frontmatter(F.col("note")).alias("has_block"), (F.length(f) - F.length("body")).alias("body_at"), "body")


#: Lines of a text without their ends, as content.lines() has them.
_LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split_regex(regexp_replace({0}, '\\r?\\n$', ''), '\\r?\\n') END"


@query("scl12_contained", with_sql(f"""WITH RECURSIVE p AS (SELECT a.doc_id, {_LINES.format('a.note')} AS want, {_LINES.format('b.note')} AS have FROM notes a JOIN notes b ON b.doc_id = a.doc_id + 15),
 r AS (SELECT doc_id, 0 AS i, 0 AS k FROM p UNION ALL SELECT p.doc_id, i + 1, k + coalesce(want[k + 1] = have[i + 1], false)::INT FROM r JOIN p ON p.doc_id = r.doc_id WHERE i < len(have))
 SELECT p.doc_id, max(k) >= len(any_value(want)) AS contained FROM p JOIN r ON r.doc_id = p.doc_id GROUP BY p.doc_id""", "notes"))
def scl12(spark, sf):
    """Each note against the next one of its shape, line by line."""
    a = X.notes(spark, sf)
    b = a.select((F.col("doc_id") - 15).alias("doc_id"), F.col("note").alias("local"))
    return a.join(b, "doc_id").select("doc_id", C.contained_in_order(F.col("note"), F.col("local")).alias("contained"))


@query("fn2_same_after_folding", with_sql("WITH " + _fm_sql(_PULL) + " SELECT a.doc_id, a.form = b.form AS same FROM frm a JOIN frm b ON b.doc_id = a.doc_id + 15", "notes"))
def fn2(spark, sf):
    a = X.notes(spark, sf).select("doc_id", C.pull_form(F.col("note"), X.STRIP).alias("form"))
    b = a.select((F.col("doc_id") - 15).alias("doc_id"), F.col("form").alias("other"))
    return a.join(b, "doc_id").select("doc_id", (F.col("form") == F.col("other")).alias("same"))


@query("scl5_base64", with_sql("SELECT doc_id, to_base64(encode(note)) AS b64, strlen(note)::BIGINT AS bytes FROM notes", "notes"))
def scl5(spark, sf):
    """Base64 out and in again; an array of numbers is read too (tests)."""
    return X.notes(spark, sf).select("doc_id", C.to_base64(F.col("note").cast("binary")).alias("b64")).withColumn("bytes", F.octet_length(F.unbase64("b64")).cast("long"))


#: Strings that a YAML reader would take for something else, and how they are written.
_TITLES = {"true": "'true'", "123": "'123'", "null": "'null'", "- x": "'- x'", "a: b": "'a: b'", "it's": "it's", "plain words": "plain words", "": "''"}


def _sql_texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("scl13_serialize", f"""SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text ELSE concat('---', chr(10), 'id: ', doc_id, chr(10), 'lang: ', lang, chr(10), 'tags:', chr(10), '- ', source, chr(10), '- ''', doc_id % 2 = 0, '''', chr(10),
 'title: ', {_sql_texts(_TITLES.values())}[doc_id % 8 + 1], chr(10), '---', chr(10), chr(10), text) END) AS sha FROM documents""")
def scl13(spark, sf):
    """Keys in rising order, whatever order they come in."""
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("doc_id") % 8 + 1).cast("int"))
    tags = F.array("source", (F.col("doc_id") % 2 == 0).cast("string"))
    given = F.to_json(F.struct(title.alias("title"), tags.alias("tags"), "lang", F.col("doc_id").alias("id")))
    meta = F.when(F.col("doc_id") % 4 > 0, given).when(F.col("doc_id") % 8 == 0, F.lit("{}"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(C.with_frontmatter(meta, F.col("text")), 256).alias("sha"))


@query("scl26_byte_check", """SELECT doc_id, CASE WHEN strlen(text) <> strlen(text) + (doc_id % 3 = 0)::INT THEN 'size_mismatch' WHEN doc_id % 5 = 0 THEN 'sha_mismatch:' || left(sha256(text), 16) ELSE 'ok' END AS result FROM documents""")
def scl26(spark, sf):
    digest = F.when(F.col("doc_id") % 5 == 0, "0").otherwise(F.upper(F.sha2("text", 256)))
    return table(spark, sf, "documents").select("doc_id", C.byte_check(F.col("text"), F.octet_length("text") + (F.col("doc_id") % 3 == 0).cast("int"), digest).alias("result"))


#: Files by ending with a sound and a broken text; endings that are not known are skipped.
_FILES = (
    ("a.json", '{"a": 1}', '{"a": ', True), ("a.yaml", "a: 1\nb:\n  - 2\n  - 3\n", "a: 1\n\tb: [unterminated\n", True), ("A.YML", "- x\n- 'y'\n", "'open", True), ("b.json", '{"a": 1, "a": [2]}', '{"a": 1} trailing', True), ("c.JSON", ' "x" ', '{"a":1}{"b":2}', True),
    ("d.json", "1e5", "NaN", True), ("b.yaml", "a: 1\nb: {a: 2}\n", "a: 1\na: 2\n", True), ("b.py", "def f():\n    return 1\n", "return 1\n", True), ("a.toml", "a = 1\n", "a = \n", True),
    ("d/a.py", "x = 1\n", "def f(:\n", True), ("a.md", "---", "\t", False), ("noext", "{", "", False), ("x.d/.json", "{", "", False),
)


@query("scl27_fn1_integrity", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'size_mismatch' WHEN doc_id % 11 = 0 THEN 'sha_mismatch:' || left(sha256(t), 16) WHEN NOT {[k for *_, k in _FILES]}[i] THEN 'skipped' WHEN broken THEN 'invalid' ELSE 'ok' END AS result
 FROM (SELECT doc_id, doc_id % {len(_FILES)} + 1 AS i, (doc_id // {len(_FILES)}) % 2 = 1 AS broken, CASE WHEN (doc_id // {len(_FILES)}) % 2 = 1 THEN {_sql_texts(f[2] for f in _FILES)}[doc_id % {len(_FILES)} + 1] ELSE {_sql_texts(f[1] for f in _FILES)}[doc_id % {len(_FILES)} + 1] END AS t FROM documents)""")
def scl27_fn1(spark, sf):
    """Bytes first, then the syntax by ending."""
    d, n = F.col("doc_id"), len(_FILES)
    pick = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in _FILES]), (d % n + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", pick(0).alias("path"), F.when(F.floor(d / n) % 2 == 1, pick(2)).otherwise(pick(1)).alias("t"))
    digest = F.when(d % 11 == 0, "0").otherwise(F.sha2("t", 256))
    return rows.select("doc_id", C.integrity(F.col("path"), F.col("t"), F.octet_length("t") + (d % 7 == 0).cast("int"), digest).alias("result"))


@query("pred14_pre_journal", with_sql("WITH " + _fm_sql("note") + """ SELECT n.doc_id, CASE WHEN n.doc_id % 10 = 9 THEN 'managed' WHEN n.doc_id % 10 = 8 THEN 'extension' WHEN n.note = '' THEN 'empty'
 WHEN n.doc_id % 2 = 0 AND sha256(f.form) = sha256(n.note) THEN 'identical' END AS skip FROM notes n JOIN frm f ON n.doc_id = f.doc_id""", "notes"))
def pred14(spark, sf):
    d = F.col("doc_id")
    path = F.when(d % 10 == 9, "a.conflict-from-x-1.md").when(d % 10 == 8, "a.txt").otherwise("a.md")
    server = F.when(d % 2 == 0, F.sha2("note", 256))
    skip = C.pre_journal(F.col("path"), F.col("note"), C.push_form(F.col("note"), X.STRIP), F.col("server"))
    return X.notes(spark, sf).withColumn("path", path).withColumn("server", server).select("doc_id", skip.alias("skip"))


@query("dec12_materialize_back", with_sql(f"""WITH c AS (SELECT doc_id, note, {_FOLD.format('ltrim(note, chr(65279))')} AS f FROM notes WHERE NOT contains(note, chr(0)))
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN sha256(note) = h THEN 'none' WHEN sha256(f) = h THEN 'align_form_c' ELSE 'fetch' END AS action
 FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN sha256('other') ELSE sha256(f) END AS h FROM c)""", "notes"))
def dec12(spark, sf):
    """After an accepted push whose server hash differs: the canonical form if it has that hash, else a fetch. Deletes: none."""
    n = X.notes(spark, sf).withColumn("c", C.canonical_form(F.col("note").cast("binary"))).filter("c.error IS NULL")
    h = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("c.text", 256))
    act = F.when(F.col("doc_id") % 4 == 0, "delete").otherwise("modify")
    action = S.materialize_back(F.lit(True), act, F.sha2("note", 256), F.sha2("c.text", 256), h)
    return n.select("doc_id", action.alias("action"))


@query("dec9_receipts", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 4 < 3 THEN sha256(text) END AS receipt FROM documents")
def dec9_kv3(spark, sf):
    d = F.col("doc_id")
    r = S.receipt(F.col("text"), F.when(d % 3 == 0, "x").otherwise(F.sha2("text", 256)), F.when(d % 4 == 3, "y").when(d % 4 == 2, F.sha2("text", 256)), F.when(d % 5 != 0, d))
    return table(spark, sf, "documents").select("doc_id", r.alias("receipt"))


#: Positions and operations as a feed may send them ({n} a number), with what they are read as; no operation means that the message is refused.
_POSITIONS = (("{n}", 1), ('"{n}"', 1), ("null", 0), ('"x1"', 0), ("-{n}", 0), ('" {n} "', 0), ('"+{n}"', 1), ('"-{n}"', 0), ("{n}.0", 0), ("[{n}]", 0), ('"00{n}"', 1), ("true", 0), ('""', 0))
_OPERATIONS = ((', "op": "DELETE"}', "DELETE"), ("}", "UPSERT"), (', "op": null}', None), (', "op": 5}', None), (', "op": ""}', ""), (', "op": ["x"]}', None), (', "op": "odd"', None))
_WHOLE = f"(event_id // {len(_POSITIONS)}) % {len(_OPERATIONS)} <> {len(_OPERATIONS) - 1}"


@query("scl18_scl19_envelopes", f"""SELECT event_id, CASE WHEN {_WHOLE} THEN {[k for _, k in _POSITIONS]}[event_id % {len(_POSITIONS)} + 1] * event_id ELSE 0 END::BIGINT AS seq,
 [{", ".join("NULL" if o is None else f"'{o}'" for _, o in _OPERATIONS)}][(event_id // {len(_POSITIONS)}) % {len(_OPERATIONS)} + 1] AS op FROM events""")
def scl18_scl19(spark, sf):
    e = F.col("event_id")
    one = lambda texts, n: F.get(F.array(*[F.lit(t) for t, _ in texts]), (n % len(texts)).cast("int"))
    body = F.concat(F.lit('{"lsn": '), F.replace(one(_POSITIONS, e), F.lit("{n}"), e.cast("string")), one(_OPERATIONS, F.floor(e / len(_POSITIONS))))
    return table(spark, sf, "events").select("event_id", S.seq_of(body).alias("seq"), S.op_of(body).alias("op"))


@query("scl20_event_ids", with_sql("SELECT event_id, 'legacy-' || left(sha256(path || chr(31) || content_sha || chr(31) || strftime(queued_at, '%Y-%m-%d %H:%M:%S') || chr(31) || action), 16) AS id, (epoch_us(queued_at) * 1000) || '-' || (event_id % 7) AS fresh FROM journal", "journal"))
def scl20(spark, sf):
    """Ids of old entries without one, which equal entries share, and of fresh ones."""
    j = X.journal(spark, sf)
    fresh = S.new_event_id(F.unix_micros(F.col("queued_at").cast("timestamp")) * 1000, F.col("event_id") % 7)
    return j.select("event_id", S.legacy_id("path", "content_sha", F.date_format("queued_at", "yyyy-MM-dd HH:mm:ss"), "action").alias("id"), fresh.alias("fresh"))


@query("scl22_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS text, epoch_us(ts) AS micros FROM events")
def scl22(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    e = table(spark, sf, "events").select("event_id", "ts", text.alias("text"))
    return e.select("event_id", "text", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


@query("scl23_truncate", "SELECT doc_id, CASE WHEN length(t) <= 512 THEN t ELSE left(t, 512) || '...' END AS t FROM (SELECT doc_id, repeat('x', (doc_id % 1100)::INT) AS t FROM documents)")
def scl23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.truncated(F.expr("repeat('x', cast(doc_id % 1100 AS int))"), 512).alias("t"))


@query("scl28_staleness", "SELECT event_id, CASE WHEN event_id * 37 < 60 THEN event_id * 37 || 's ago' WHEN event_id * 37 < 3600 THEN (event_id * 37) // 60 || 'm ago' WHEN event_id * 37 < 86400 THEN (event_id * 37) // 3600 || 'h ago' ELSE (event_id * 37) // 86400 || 'd ago' END AS age FROM events")
def scl28(spark, sf):
    return table(spark, sf, "events").select("event_id", S.staleness(F.col("event_id") * 37).alias("age"))


_OS, _ARCH = ("windows", "macos", "linux", "linux", "beos", None), ("x86_64", "aarch64", "aarch64", "riscv", "x86_64", None)
_PLATFORM = f"CASE WHEN concat_ws('-', {_sql_texts(_OS[:5])}[event_id % 6 + 1], {_sql_texts(_ARCH[:5])}[event_id % 6 + 1]) IN ('windows-x86_64', 'macos-x86_64', 'macos-aarch64', 'linux-x86_64', 'linux-aarch64') THEN concat_ws('-', {_sql_texts(_OS[:5])}[event_id % 6 + 1], {_sql_texts(_ARCH[:5])}[event_id % 6 + 1]) ELSE 'unknown' END"
_SEEN = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'"


@query("scl29_heartbeat_body", f"""SELECT event_id, '{{"daemon_version":"1.2","daemon_platform":"' || {_PLATFORM} || '","last_seen":"' || {_SEEN} || '"' || CASE WHEN event_id % 2 = 0 THEN ',"last_sync":"' || {_SEEN} || '"' ELSE '' END || '}}' AS body, 'tidemark/1.2/' || {_PLATFORM} AS agent FROM events""")
def scl29(spark, sf):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 6 + 1).cast("int"))
    seen = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    e = table(spark, sf, "events").select("event_id", S.platform_name(pick(_OS), pick(_ARCH)).alias("platform"), seen.alias("seen"))
    body = S.heartbeat_body(F.lit("1.2"), F.col("platform"), F.col("seen"), F.when(F.col("event_id") % 2 == 0, F.col("seen")))
    return e.select("event_id", body.alias("body"), S.user_agent(F.lit("tidemark"), F.lit("1.2"), F.col("platform")).alias("agent"))


@query("scl30_subscribers", "SELECT doc_id, coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END, ''), CASE WHEN doc_id % 2 = 0 THEN 'main' ELSE lang END) AS subscriber FROM documents")
def scl30(spark, sf):
    d = F.col("doc_id")
    own = F.when(d % 3 == 0, F.col("source")).when(d % 3 == 1, "")
    return table(spark, sf, "documents").select("doc_id", S.subscriber_id(own, F.when(d % 2 == 0, "main").otherwise(F.col("lang"))).alias("subscriber"))


@query("scl31_settings", "SELECT doc_id, coalesce(nullif(greatest(TRY_CAST(CASE doc_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '-3' WHEN 2 THEN 'x' END AS BIGINT), 0), 0), 600) AS seconds FROM documents")
def scl31(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", S.positive_or(F.when(d % 4 == 0, "12").when(d % 4 == 1, "-3").when(d % 4 == 2, "x"), 600).alias("seconds"))


_PARTS = "concat_ws(' / ', CASE WHEN doc_id % 5 = 0 THEN doc_id || ' integrity' END, CASE WHEN doc_id % 7 = 0 THEN doc_id || ' conflicts' END, CASE WHEN doc_id % 11 = 0 THEN 'delete-propagation paused (inbound sync OK)' END)"


@query("dec17_tooltip", f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '🛑 redflag.md present — sync HALTED' WHEN doc_id % 17 = 0 THEN '⟳ Verifying vault… scanning files' WHEN doc_id % 19 = 0 THEN '❌ Disconnected • unknown'
 WHEN {_PARTS} <> '' THEN '⚠ ' || {_PARTS} WHEN doc_id % 3 = 0 THEN 'Syncing ⟳ • ' || doc_id || ' pending • last error: none' ELSE 'Synced ✓ • ' || doc_id || ' ↓ ' || doc_id || ' ↑ last ' || CASE WHEN doc_id % 2 = 0 THEN 'never' ELSE (doc_id % 60) || 's ago' END END AS line FROM documents""")
def dec17(spark, sf):
    d = F.col("doc_id")
    zero = F.lit(0).cast("long")
    state = dict(
        redflag=d % 13 == 0, verifying=d % 17 == 0, broken=d % 19 == 0, error=F.lit(None).cast("string"), integrity=F.when(d % 5 == 0, d).otherwise(zero), conflicts=F.when(d % 7 == 0, d).otherwise(zero),
        paused=d % 11 == 0, pending=F.when(d % 3 == 0, d).otherwise(zero), received=d, sent=d, idle=F.when(d % 2 != 0, d % 60),
    )
    return table(spark, sf, "documents").select("doc_id", S.tooltip(**state).alias("line"))
