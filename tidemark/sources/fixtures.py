"""Replica tables derived from the star-schema tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

DEVICE, FOLDERS = "dev-a", ("src0", "src1", "src2")
#: Shapes of paths, {s} source, {l} language, {d} document number.
PATHS = (
    "{s}/{l}/{d}.md", "{s}\\{l}\\{d}.md", "/abs/{d}.md", "{s}/../{d}.md", "a/b..c/{d}.md", "C:\\x\\{d}.md", "x:/{d}.md", "",
    ".obsidian/{d}.json", "{s}/node_modules/{d}.md", "{s}/.%cache/{d}.md", "{s}/._{d}.md", "{s}/.DS_Store", "{s}/{d}.tmp", "{s}/{d}.MD", "{s}/{d}", ".md",
    "{s}/n{d}.conflict-from-dev-a-{d}.md", "{s}/n{d}.conflict-from-dev-a-{d}-2.md", "{s}/n.conflict-from-{d}.md", "{s}/n.conflict-from-x-99999999999999999999.md", "{s}/.conflict-from-a-1.md",
    "{s}/Credentials.md", "credentials/{d}.md", "02_Projects/Protocols/Infrastructure/{d}.md", "{s}/caf\u0065\u0301/{d}.md", "{s}/né/{d}.txt", "..", "{s}/.trash/{d}.md", "{s}/rules/{l}.md",
)
#: Shapes of notes, {T} the text of a document, {R} {N} {B} {Z} CR, LF, BOM, NUL.
NOTES = (
    "{T}", "---{N}title: {T}{N}modified: 1{N}---{N}{T}", "---{R}{N}title: x{R}{N}---{R}{N}{T}{R}{N}", "{B}---{N}a: 1{N}---{N}{T}", "{B}{B}{T}", "{T}{R}{T}{R}{N}{T}",
    "---{N}modified:{N}  - 1{N}  - 2{N}tags: y{N}\t z{N}sha : q{N}---{N}body{N}", "---{N}---{N}{T}", "---{N}open {T}", "---", "a{Z}b", "", "a{N}{T}{N}b{N}", "x{R}{R}{N}", "---{N}k: v{N}---",
)
STRIP = ("modified", "sha")


def pick(templates: tuple[str, ...], n: Column, values: dict[str, Column]) -> Column:
    t = F.element_at(F.array(*[F.lit(x) for x in templates]), (n % len(templates) + 1).cast("int"))
    return reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), kv[1]), values.items(), t)


def local_manifest(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """`more`: columns of the documents that stay beside."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), *more)


def server_state(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """`more`: columns of the documents that stay beside."""
    d = table(spark, sf, "documents")
    rest = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nserver-edit"))).otherwise(F.col("text"))
    here = d.filter("doc_id % 11 <> 0").select("doc_id", F.concat("source", rest).alias("path"), F.sha2(text, 256).alias("fs_hash"), (F.lit(1000000000).cast("long") + F.col("doc_id")).alias("change_seq"), *more)
    there = d.filter("doc_id % 13 = 0").select("doc_id", F.concat(F.lit("remote"), rest).alias("path"), F.sha2("text", 256).alias("fs_hash"), (F.lit(1000500000).cast("long") + F.col("doc_id")).alias("change_seq"), *more)
    return here.unionByName(there)


def shadow(spark: SparkSession, sf: str) -> DataFrame:
    both = local_manifest(spark, sf).join(server_state(spark, sf).select("path", "fs_hash"), "path").filter("doc_id % 5 <> 0")
    h = F.when(F.col("doc_id") % 3 == 0, F.col("fs_hash")).when(F.col("doc_id") % 3 == 1, F.col("content_hash")).otherwise(F.sha2(F.concat(F.lit("base-"), F.col("doc_id").cast("string")), 256))
    return both.select("path", h.alias("server_hash"))


def base_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage per path: `adopted` or `observed`, some ahead of the server's sequence."""
    s = server_state(spark, sf).filter("doc_id % 4 <> 0")
    return s.select("path", (F.col("change_seq") + F.col("doc_id") % 3 - 1).alias("seq"), F.when(F.col("doc_id") % 2 == 0, F.lit("adopted")).otherwise(F.lit("observed")).alias("prov"))


def journal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    base = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.sha2(F.col("event_id").cast("string"), 256))
    return e.select(
        "event_id", F.concat(F.lit("notes/"), (F.col("user_id") % 40).cast("string"), F.lit(".md")).alias("path"), action.alias("action"), F.sha2("props", 256).alias("content_sha"), base.alias("base_hash"),
        F.col("ts").alias("queued_at"), (200 + F.octet_length("props")).cast("long").alias("line_bytes"), F.col("event_id").alias("line_no"),
    )


def burst_events(spark: SparkSession, sf: str) -> DataFrame:
    """Deletes by watcher root; every 50th event of a root is a reset."""
    e = table(spark, sf, "events").filter("event_type = 'error' OR event_id % 97 = 0")
    return e.select("event_id", "ts", (F.col("user_id") % 8).alias("root"), (F.col("event_id") % 97 == 0).alias("is_reset"))


def echo_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type IN ('click', 'view')")
    return e.select("event_id", "ts", F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "record").otherwise("probe").alias("kind"), F.floor(F.col("value")).cast("long").alias("v")).withColumn("sha", F.pmod("v", F.lit(4))).drop("v")


def paths(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", pick(PATHS, F.col("doc_id"), {"{s}": F.col("source"), "{l}": F.col("lang"), "{d}": F.col("doc_id").cast("string")}).alias("path"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of each document, with its line ends, in the note templates."""
    t = F.array(*[F.lit(x) for x in NOTES])
    note = F.element_at(t, (F.col("doc_id") % len(NOTES) + 1).cast("int"))
    for mark, value in (("{R}", "\r"), ("{N}", "\n"), ("{B}", "\ufeff"), ("{Z}", "\x00")):
        note = F.replace(note, F.lit(mark), F.lit(value))
    # the text goes in last, so that no mark in it is taken for one of the template
    return table(spark, sf, "documents").select("doc_id", F.replace(note, F.lit("{T}"), F.col("text")).alias("note"))


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, root, ts, local, server, now, base: whole notes of both sides, the local one as found later, and what
    the last-synced hash is of (server, local, other or null)."""
    from tidemark.functions import content as C

    d, note, edit = F.col("doc_id"), F.col("note"), F.lit("\nserver-edit")
    body = C.body_only(note)
    kinds = (note, body, F.concat(note, edit), C.fold_eol(note), F.concat(body, edit), F.concat(F.lit("---\nk: v\n---\n"), body))
    server = reduce(lambda out, i: F.when(d % 7 == i, kinds[i]).otherwise(out), range(len(kinds)), note)
    now = F.when(d % 11 == 0, F.concat(note, F.lit("\nlater"))).otherwise(note)
    base = F.when(d % 4 == 0, "server").when(d % 4 == 1, "local").when(d % 4 == 2, "other")
    places = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(d.cast("string"), F.lit(".md"))).alias("path"))
    rows = notes(spark, sf).join(places, "doc_id").withColumn("server", server)
    return rows.select("doc_id", "path", (d % 3).alias("root"), F.timestamp_seconds(d * 600).alias("ts"), note.alias("local"), "server", now.alias("now"), base.alias("base"))


def _sql_list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_REST = "'/' || lang || '/' || doc_id || '.md'"
SQL = {
    "local_manifest": f"SELECT doc_id, source || {_REST} AS path, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents",
    "server_state": f"SELECT doc_id, source || {_REST} AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'server-edit' ELSE text END) AS fs_hash, 1000000000 + doc_id AS change_seq FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, 'remote' || {_REST}, sha256(text), 1000500000 + doc_id FROM documents WHERE doc_id % 13 = 0",
    "shadow": "SELECT l.path, CASE l.doc_id % 3 WHEN 0 THEN s.fs_hash WHEN 1 THEN l.content_hash ELSE sha256('base-' || l.doc_id) END AS server_hash FROM local_manifest l JOIN server_state s ON l.path = s.path WHERE l.doc_id % 5 <> 0",
    "base_seq": "SELECT path, change_seq + doc_id % 3 - 1 AS seq, CASE WHEN doc_id % 2 = 0 THEN 'adopted' ELSE 'observed' END AS prov FROM server_state WHERE doc_id % 4 <> 0",
    "journal": "SELECT event_id, 'notes/' || (user_id % 40) || '.md' AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action, sha256(props) AS content_sha, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN sha256(event_id::VARCHAR) END AS base_hash, ts AS queued_at, (200 + strlen(props))::BIGINT AS line_bytes, event_id AS line_no FROM events",
    "burst_events": "SELECT event_id, ts, user_id % 8 AS root, event_id % 97 = 0 AS is_reset FROM events WHERE event_type = 'error' OR event_id % 97 = 0",
    "echo_events": "SELECT event_id, ts, user_id AS key, CASE WHEN event_type = 'click' THEN 'record' ELSE 'probe' END AS kind, ((floor(value)::BIGINT % 4) + 4) % 4 AS sha FROM events WHERE event_type IN ('click', 'view')",
    "paths": f"SELECT doc_id, replace(replace(replace({_sql_list(PATHS)}[doc_id % {len(PATHS)} + 1], '{{s}}', source), '{{l}}', lang), '{{d}}', doc_id::VARCHAR) AS path FROM documents",
    "notes": f"SELECT doc_id, replace(replace(replace(replace(replace({_sql_list(NOTES)}[doc_id % {len(NOTES)} + 1], '{{R}}', chr(13)), '{{N}}', chr(10)), '{{B}}', chr(65279)), '{{Z}}', chr(0)), '{{T}}', text) AS note FROM documents",
}
_NEEDS = {"shadow": ("local_manifest", "server_state"), "base_seq": ("server_state",)}


def with_sql(body: str, *names: str) -> str:
    """`body` behind the fixture views that it reads."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    head, own = "WITH ", body.lstrip()
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {own[15:]}"
    return head + ", ".join(ctes) + (f", {own[5:]}" if own.upper().startswith("WITH ") else f" {body}")
