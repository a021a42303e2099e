"""Operators that SQL does not say, and corner cases of those that it does, against plain loops."""

import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.operators import ordered as O
from tidemark.operators import reconcile as R
from tidemark.operators import stores as St

T0 = datetime(2024, 1, 1)


def admitted(times, threshold, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if t - h <= window]
        ok = threshold == 0 or len(held) < threshold
        if ok:
            held.append(t)
        out.append(ok)
    return out


@pytest.mark.parametrize("threshold,window", [(0, 10), (1, 5), (3, 10)])
def test_admission(spark, threshold, window):
    rng = random.Random(threshold)
    rows, want = [], {}
    for root in range(4):
        times = sorted(rng.randrange(60) for _ in range(40))
        for i, (t, ok) in enumerate(zip(times, admitted(times, threshold, window))):
            rows.append((root, root * 100 + i, T0 + timedelta(seconds=t)))
            want[root * 100 + i] = ok
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "root long, event_id long, ts timestamp_ntz")
    assert {r["event_id"]: r["admitted"] for r in O.admission(df, threshold, window).collect()} == want


@pytest.mark.parametrize("threshold,window", [(0, 10), (1, 10), (2, 10), (3, 10), (1, 0), (0, 0)])
def test_delete_burst(spark, threshold, window):
    rng = random.Random(threshold)
    rows, want = [], {}
    for root in (0, 1, 2, None):
        held, latched = [], False
        for i, t in enumerate(sorted(rng.randrange(90) for _ in range(200 if root == 1 else 60))):
            reset, n = rng.random() < 0.1, (9 if root is None else root) * 1000 + i
            rows.append((root, n, T0 + timedelta(seconds=t), reset, "x"))
            if reset:
                want[n], held, latched = (latched, False), [], False
                continue
            held = [h for h in held if h > t - window] + [t]
            trip = window > 0 and not latched and len(held) >= threshold
            want[n] = (latched, trip)
            latched = latched or trip
    df = spark.createDataFrame(rows, "root long, event_id long, ts timestamp_ntz, is_reset boolean, range string")
    got = O.delete_burst(df.withColumnRenamed("range", "note"), threshold, f"{window} SECONDS").collect()
    assert len(got) == len(rows) and {r["event_id"]: (r["paused"], r["tripped"]) for r in got} == want


def test_classify_events(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, at(0), 1, "delete", "a/1.md", None), (1, at(1), 2, "delete", "node_modules/x.md", None), (1, at(2), 3, "delete", "a/2.md", None), (1, at(3), 4, "delete", "a/3.md", None),
        (1, at(4), 5, "rename", "a/4.md", "a/5.md"), (1, at(5), 6, "rename", "a/4.md", "node_modules/5.md"), (1, at(6), 7, "rename", "a/4.txt", "../5.md"), (1, at(7), 8, "reset", None, None),
        (1, at(8), 9, "reset", None, None), (1, at(9), 10, "delete", "a/6.md", None), (1, at(10), 11, "modify", "a/6.txt", None), (2, at(3), 12, "delete", "a/3.md", None), (2, at(4), 13, "create", None, None),
    ]
    df = spark.createDataFrame(rows, "root long, ts timestamp_ntz, event_id long, kind string, path string, new_path string")
    got = {r.event_id: (r.decision, r.side) for r in O.classify(df, 2, "30 SECONDS").collect()}
    want = {1: ("allow", None), 2: ("drop_exclude", "old"), 3: ("allow", None), 4: ("drop_delete_burst", None), 5: ("allow", None), 6: ("drop_exclude", "new"), 7: ("drop_extension", "old"), 8: ("resumed", None), 9: ("not_paused", None), 10: ("allow", None), 11: ("drop_extension", "old"), 12: ("allow", None)}
    assert {k: v for k, v in got.items() if k != 13} == want
    n = O.drop_counts(O.classify(df.filter("root = 1"), 2, "30 SECONDS")).first().asDict()
    assert n == {"dropped_substrate": 0, "dropped_extension": 2, "dropped_excludes": 2, "filtered": 5}
    assert O.classify(df.limit(0), 2, "30 SECONDS").count() == 0


def test_ledger_cuts_long_errors(spark):
    df = spark.createDataFrame([("p", 1, T0, False, "é" * 300), ("q", 1, T0, False, "e" * 512)], "path string, line_no long, ts timestamp_ntz, is_clear boolean, error string")
    got = {r["path"]: r["last_error"] for r in O.retry_ledger(df).collect()}
    assert got == {"p": "é" * 256 + "...", "q": "e" * 512}


def test_lineage(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for n in range(600):
        path, seq, prov = f"p{rng.randrange(12)}", rng.randrange(3), rng.choice(["adopted", "observed"])
        rows.append((n, path, seq, prov))
        if prov == "observed" and want.get(path) == (seq, "adopted"):
            continue
        want[path] = (seq, prov)
    df = spark.createDataFrame(rows, "line_no long, path string, seq long, prov string")
    assert {r["path"]: (r["seq"], r["prov"]) for r in St.lineage(df).collect()} == want


def test_running_total_over_ranges(spark):
    """In the order of a sparse column, with ties, over any number of ranges."""
    df = spark.range(1, 501).select((F.floor(F.col("id") / 3) * 1000 + F.lit(0.5)).alias("n"), F.col("id"), (F.col("id") % 7 + 1).alias("v"))
    rows = sorted((r["t"], r["n"]) for r in O.running_total(df, "n", "v", "t").collect())
    assert [n for _, n in rows] == [i // 3 * 1000 + 0.5 for i in range(1, 501)]
    last = {n: t for t, n in rows}
    assert all(last[n] == sum(i % 7 + 1 for i in range(1, 501) if i // 3 * 1000 + 0.5 <= n) for n in last)


FORM_C = [  # input, output or error
    (b"a\r\nb\r\n", "a\nb\n"), (b"a\rb", "a\nb"), (b"a\r\r\nb", "a\n\nb"), (b"\xef\xbb\xbfx", "x"), (b"\xef\xbb\xbf\xef\xbb\xbfx", "x"), (b"a\xef\xbb\xbfb", "a﻿b"),
    (b"", ""), (b"no end", "no end"), (b"\r", "\n"), (b"e\xcc\x81", "é"), (b"\xff\xfe", "non_utf8"), (b"a\x00b", "nul"),
]


def test_canonical_form(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(FORM_C)], "i int, b binary")
    for r in df.select("i", C.canonical_form(F.col("b")).alias("c")).collect():
        assert (r["c"]["error"] or r["c"]["text"]) == FORM_C[r["i"]][1]


def test_contained_in_order(spark):
    def plain(server, local):
        want = iter(server.splitlines())
        w = next(want, None)
        for h in local.splitlines():
            if w == h:
                w = next(want, None)
        return w is None

    cases = [("a\nb", "a\nx\nb\n"), ("b\na", "a\nb"), ("", "x"), ("x", ""), ("a\r\nb\n", "a\nb"), ("a\na", "a"), ("\n", "\n"), ("a", "b\na")]
    df = spark.createDataFrame(cases, "s string, l string")
    for r in df.select("s", "l", C.contained_in_order(F.col("s"), F.col("l")).alias("c")).collect():
        assert r["c"] == plain(r["s"], r["l"]), r


def test_conflict_names(spark):
    cases = {
        "a.conflict-from-d-5.md": ("a", "d", "5"), "a.conflict-from-d-5-2.md": ("a", "d", "5"), "a.conflict-from-x-y-5.md": ("a", "x-y", "5"), "a.conflict-from-5.md": None,
        "a.conflict-from-d-x.md": None, ".conflict-from-d-5.md": None, "a.conflict-from-d-5.txt": None, "a.conflict-from-d-18446744073709551616.md": None, "a.conflict-from--5-2.md": ("a", "-5", "2"), "plain.md": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    for r in df.select("n", P.conflict_parts(F.col("n")).alias("c")).collect():
        assert (tuple(r["c"]) if r["c"] else None) == cases[r["n"]], r["n"]


def test_long_names_and_bytes(spark):
    stem = "é" * 200
    row = spark.createDataFrame([(stem,)], "s string").select(P.stash_path(F.concat(F.lit("d/"), "s", F.lit(".md")), F.lit("dev"), F.lit(3)).alias("p"), P.head_bytes(F.col("s"), 5).alias("h")).first()
    assert row["h"] == "éé" and row["p"].startswith("d/" + "é" * 24 + ".") and row["p"].endswith(".conflict-from-dev-3.md")


def test_syntax_and_yaml(spark):
    rows = [("a.toml", "x = 1"), ("a.toml", "x ="), ("a.py", "def f(): pass"), ("a.py", "def"), ("a.json", "[1]"), ("a.json", "[1"), ("a.md", "z")]
    got = [r["r"] for r in spark.createDataFrame(rows, "p string, t string").select(C.syntax_check(F.col("p"), F.col("t")).alias("r")).collect()]
    assert got == ["ok", "invalid", "ok", "invalid", "ok", "invalid", "skipped"]
    out = spark.createDataFrame([('{"a":"x","b":[1,2],"c":"k: v"}', "body"), ("{}", "body"), (None, "body")], "m string, b string").select(C.with_frontmatter(F.col("m"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in out] == ["---\na: x\nb:\n- 1\n- 2\nc: 'k: v'\n---\n\nbody", "body", "body"]


def test_seed_only_an_empty_store(spark):
    rows = spark.createDataFrame([("a", "h", "match"), ("b", "h", "drift")], "path string, server_hash string, state string")
    some = spark.createDataFrame([("z", "h")], "path string, server_hash string")
    assert R.seed_shadow(rows, some).count() == 0
    assert [r["path"] for r in R.seed_shadow(rows, some.limit(0)).collect()] == ["a"]


@pytest.mark.parametrize("eq,present,shadow_server,local_shadow,want", [(a, b, c, d, "R1_noop" if a else "R5_conflict" if not b else "R2_preserve_local" if c else "R3_pull_clean" if d else "R4_conflict") for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)])
def test_decide_table(spark, eq, present, shadow_server, local_shadow, want):
    lits = [F.lit(bool(x)) for x in (eq, present, shadow_server, local_shadow)]
    assert spark.range(1).select(R.decide(*lits).alias("d")).first()["d"] == want


def test_two_passes_converge(spark):
    """What the first pass pushes or pulls leaves nothing to do for the second."""
    from tidemark.sources import fixtures as X

    sf = "/root/testdata/sf0.001"
    local, server = X.local_manifest(spark, sf), X.server_state(spark, sf)
    rows = R.with_shadow(R.states(local, server), X.shadow(spark, sf))
    rows = rows.withColumn("d", R.direction(F.col("state"), F.col("server_hash"), F.col("shadow_hash")))
    after = F.when(F.col("d") == "pull", F.col("server_hash")).otherwise(F.col("content_hash"))
    both = rows.select("path", after.alias("h"), "size_bytes")
    again = R.states(both.select("path", F.col("h").alias("content_hash"), "size_bytes"), both.select("path", F.col("h").alias("fs_hash"), F.lit(1).alias("change_seq")))
    assert again.filter("state <> 'match'").count() == 0


def test_files(spark, tmp_path):
    from tidemark.sources.files import candidate_files, file_manifest

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes(b"hello")
    (tmp_path / "a" / "x.tmp").write_bytes(b"t")
    (tmp_path / "y.txt").write_bytes(b"z")
    got = {r["path"]: r["decision"] for r in candidate_files(spark, str(tmp_path)).drop("content").collect()}
    assert got == {"a/x.md": "allow", "a/x.tmp": "drop_exclude", "y.txt": "drop_extension"}
    assert [(r["path"], r["size_bytes"]) for r in file_manifest(candidate_files(spark, str(tmp_path))).collect()] == [("a/x.md", 5)]
    assert candidate_files(spark, str(tmp_path / "none")).count() == 0


def test_content_queries_take_whole_texts(spark, sf):
    from tidemark.plans import registry
    from tidemark.sources import fixtures as X
    from tidemark.sources.tables import table

    queries, end = registry.queries(), {"{R}": "\r", "{N}": "\n", "{B}": "\ufeff", "{Z}": "\0"}
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        note = X.NOTES[r["doc_id"] % len(X.NOTES)]
        for mark, value in end.items():
            note = note.replace(mark, value)
        want[r["doc_id"]] = note.replace("{T}", r["text"])
    fold = lambda s: s.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    got = {r["doc_id"]: r["text"] for r in queries["scl3_canonical_form"](spark, sf).collect()}
    assert got == {i: None if "\0" in n else fold(n) for i, n in want.items()}
    assert max(len(x or "") for x in got.values()) > 1000 and any((x or "").count("\n") > 20 for x in got.values())

    def contained(server, local):
        rest = iter(local)
        return all(x in rest for x in server)

    split = lambda s: re.sub("\r\n?", "\n", s).split("\n")
    got = {r["doc_id"]: r["contained"] for r in queries["scl12_contained"](spark, sf).collect()}
    assert set(got) == {i for i in want if i + 15 in want}
    same = [i for i in got if got[i] != contained(split(want[i]), split(want[i + 15]))]
    assert same == []


def test_chains_cover_the_whole_journal(spark, sf):
    from tidemark.plans import registry
    from tidemark.sources import fixtures as X

    lines = sorted((r["line_no"], r["path"], r["action"]) for r in X.journal(spark, sf).select("line_no", "path", "action").collect())
    want = {}
    for i, (_, path, action) in enumerate(lines):
        want.setdefault((i // 32, path), []).append(action)
    got = {(r["batch"], r["path"]): (r["n"], r["chain"]) for r in registry.queries()["agg10_chains"](spark, sf).collect()}
    assert len(lines) > 400 and got == {k: (len(v), ">".join(v)) for k, v in want.items()}


def test_manifest_covers_the_whole_folder(spark, sf):
    import hashlib
    from pathlib import Path

    from tidemark.plans import registry

    want = {(str(p.relative_to(sf)), hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in Path(sf).rglob("*.parquet") if p.is_file()}
    assert len(want) > 10 and {tuple(r) for r in registry.queries()["src2_file_manifest"](spark, sf).collect()} == want


def test_live_guards_in_bounded_batches(spark, tmp_path, monkeypatch):
    import functools

    from tidemark.plans import registry
    from tidemark.streaming import feeds

    rng, start, sizes = random.Random(6), datetime(2024, 1, 1), []
    kinds = ["click", "view", "error"]
    rows = [(i, start + timedelta(seconds=rng.randint(0, 200_000)), 1 if rng.random() < 0.6 else rng.randint(2, 9), rng.choice(kinds), float(rng.randint(0, 3))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(feeds, "in_order", functools.partial(feeds.in_order, rows_a_file=100))
    stream = feeds.in_order(spark.read.parquet(f"{tmp_path}/events.parquet"), ["ts", "event_id"], f"test-{tmp_path.name}-{rng.random()}")
    stream.writeStream.foreachBatch(lambda b, n: sizes.append([tuple(r) for r in b.select("ts", "event_id").collect()])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) >= 9 and max(map(len, sizes)) <= 100
    assert [x for b in sizes for x in sorted(b)] == sorted((r[1], r[0]) for r in rows)
    got = {r["event_id"]: r["admitted"] for r in registry.queries()["win9_live_breaker"](spark, str(tmp_path)).collect()}
    want = {}
    for root in range(8):
        own = sorted((r[1], r[0]) for r in rows if r[2] % 8 == root)
        micros = [int((t - start).total_seconds() * 1_000_000) for t, _ in own]
        want |= dict(zip((i for _, i in own), admitted(micros, 5, 6 * 3600 * 1_000_000)))
    assert got == want


def test_guards_by_content(spark, sf):
    from tidemark.plans import registry
    from tidemark.sources import fixtures as X

    forms = [C.pull_form(F.col(c), X.STRIP).alias(f"{c}_form") for c in ("local", "server")]
    rows = sorted((r.asDict() for r in X.sides(spark, sf).select("*", *forms).collect()), key=lambda r: r["doc_id"])
    cut = lambda s: s[1:] if s.startswith("\ufeff") else s
    block = lambda s: cut(s).startswith(("---\n", "---\r\n")) or cut(s) == "---"
    body = lambda s: re.sub(r"\A---\n(?:.*?\n)??---\n", "", cut(s).replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)
    want, asked = {}, {}
    for r in rows:
        base = {"server": r["server_form"], "local": r["local_form"], "other": object(), None: None}[r["base"]]
        if r["local_form"] == r["server_form"]:
            decision = "R1_noop"
        elif base is None:
            decision = "R5_conflict"
        else:
            decision = "R2_preserve_local" if base == r["server_form"] else "R3_pull_clean" if base == r["local_form"] else "R4_conflict"
        strips = block(r["local"]) and not block(r["server"])
        guard = "none"
        if strips and decision in ("R3_pull_clean", "R4_conflict", "R5_conflict"):
            guard = "preserve_and_push" if body(r["local"]) == body(r["server"]) else "stash_then_align"
        align = "align" if decision == "R1_noop" and r["local"] != r["server"] else "keep"
        rewrite = "skip_concurrent_edit" if r["now"] != r["local"] else "skip_frontmatter_strip" if strips else "written"
        # every known path has a folder, so the store's scope is suspect
        outcome = {"R5_conflict": "skip_scope_suspect"}.get(decision, "not_conflict")
        if decision == "R4_conflict":
            asked.setdefault(r["root"], []).append(r["doc_id"])
        want[r["doc_id"]] = [decision, guard, align, outcome, rewrite]
    for ids in asked.values():
        for i, ok in zip(ids, admitted([600 * i for i in ids], 5, 6 * 3600)):
            want[i][3] = "stash_and_write" if ok else "skip_breaker"
    got = {r["doc_id"]: list(r)[1:] for r in registry.queries()["dec3_dec6_snk5_by_content"](spark, sf).collect()}
    assert got == want
    assert {x[1] for x in want.values()} == {"none", "preserve_and_push", "stash_then_align"} and len({x[3] for x in want.values()}) >= 3


YAML = [
    {"title": "true", "v": "123", "n": "null", "b": "- x", "z": 1, "a": 2.5, "t": True, "none": None}, {"no": "No", "date": "2020-01-01", "time": "12:30", "e": "1e5", "h": "0x1F", "u": "1_000", "d": ".5", "eq": "=", "m": "<<"},
    {"c": "a: b", "h": "a #b", "q": "it's", "w": " lead", "x": "trail ", "k:": ": ", "": "", "nl": "two\nlines\n", "tab": "a\tb", "emoji": "😀 é", "bs": "\\", "dq": '"x"', "z": "\x07\x00\x85"},
    {"tags": ["a", "- b", ["c", {"d": []}], {}, {"k": {"l": "yes"}}], "map": {"b": {"a": [1, 2]}, "a": "~"}},
]


def test_frontmatter_reads_back(spark):
    """Every string stays a string, keys rise, nested values come back; null and {} have no block."""
    import json

    yaml = pytest.importorskip("yaml")
    rows = [(i, json.dumps(v), "body") for i, v in enumerate(YAML)] + [(90, "{}", "x"), (91, None, "x"), (92, "null", "x"), (93, "[]", "x")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, m string, b string").select("i", C.with_frontmatter(F.col("m"), F.col("b")).alias("t")).collect()}
    for i, v in enumerate(YAML):
        block = got[i].removeprefix("---\n").removesuffix("---\n\nbody")
        assert len(block) == len(got[i]) - 13 and yaml.safe_load(block) == v and list(yaml.safe_load(block)) == sorted(v)
    assert got[90] == got[91] == got[92] == "x" and got[93] == "---\n[]\n---\n\nx"


def test_yaml_files_are_checked(spark):
    pytest.importorskip("yaml")
    rows = [("x.yaml", "a: 1\nb:\n  - 2\n  - 3\n"), ("x.yml", "a: 1\n\tb: [unterminated\n"), ("X.YAML", ""), ("x.yml", "a: 1\n---\nb: 2\n"), ("x.yml", "[" * 5000), ("yaml", "{"), ("d.yaml/x", "{")]
    got = [r["r"] for r in spark.createDataFrame(rows, "p string, t string").coalesce(1).select(C.syntax_check(F.col("p"), F.col("t")).alias("r")).collect()]
    assert got == ["ok", "invalid", "ok", "invalid", "invalid", "skipped", "skipped"]


def test_journal_lines_odd(spark):
    """Each shape of line between two good ones: it lives, it is skipped, or nothing behind it is read."""
    from tidemark.plans.store_queries import ENDING, LIVE, SKIPPED

    fill = lambda t, i: t.replace("{i}", i).replace("{p}", "a/b.md").replace("{a}", "modify").replace("{c}", "c").replace("{q}", "2026-08-05T10:00:00.5+02:00")
    shapes = [*LIVE, *SKIPPED, *ENDING, "\xff"]
    rows = [(k, n, fill(t, f"{n}").encode("latin-1" if t == "\xff" else "utf-8")) for k, shape in enumerate(shapes) for n, t in enumerate([LIVE[0], shape, LIVE[0]])]
    lines = spark.createDataFrame(rows, "file int, line_no long, line binary").withColumn("line", F.col("line").cast("string"))
    got = St.journal_lines(lines).collect()
    held = {k: sorted(r.line_no for r in got if r.file == k) for k in range(len(shapes))}
    want = [[0, 1, 2]] * len(LIVE) + [[0, 2]] * len(SKIPPED) + [[0]] * (len(ENDING) + 1)
    assert held == dict(enumerate(want))
    own = {r.file: r.id for r in got if r.line_no == 1}
    assert own[0] == "1" and own[1] == own[2] and own[1].startswith("legacy-")


def test_journal_files(spark, tmp_path):
    from tidemark.sources import journals as J

    good = lambda i: b'{"schema_version":1,"id":"%d","path":"p","action":"delete","content_sha":"c","queued_at":"2026-08-05T10:00:00Z","device_id":"d"}' % i
    files = {
        "one": b"\n".join(good(i) for i in range(3000)), "crlf": b"".join(good(i) + b"\r\n" for i in range(700)), "empty": b"", "blank": b"\n\r\n\n" + good(1) + b"\n",
        "broken": b"".join(good(i) + b"\n" for i in range(900)) + b"\xc3\n" + good(901) + b"\n", "sub/deep": good(5) + b"\r", "cr": good(1) + b"\r" + good(2) + b"\n" + good(3),
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = J.numbered_lines(spark, str(tmp_path)).withColumn("name", F.regexp_extract("file", "([a-z]+)$", 1)).collect()
        entries, sizes = J.open_journal(spark, str(tmp_path))
        live = {(r.file.rsplit("/", 1)[1], r.line_no, r.id) for r in entries.collect()}
        assert {r.file.rsplit("/", 1)[1]: r.total_bytes for r in sizes.collect()} == {n.rsplit("/", 1)[-1]: len(raw) for n, raw in files.items() if raw}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, raw in files.items():
        plain = raw.split(b"\n")
        plain = [x.removesuffix(b"\r") for x in (plain if plain[-1] else plain[:-1])]
        if name != "broken":
            assert sorted((r.line_no, r.line.encode()) for r in lines if r.name == name.rsplit("/", 1)[-1]) == list(enumerate(plain, 1))
    want = {("one", i + 1, str(i)) for i in range(3000)} | {("crlf", i + 1, str(i)) for i in range(700)} | {("broken", i + 1, str(i)) for i in range(900)}
    assert live == want | {("blank", 4, "1"), ("deep", 1, "5")}
    entries, sizes = J.open_journal(spark, str(tmp_path / "none"))
    assert entries.count() == sizes.count() == 0


def test_journal_lines_parse_once(spark):
    plan = St.journal_lines(spark.createDataFrame([], "file int, line_no long, line string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2  # once on each side of the join with the files' ends


def test_empty_files_are_listed(spark, tmp_path):
    from tidemark.sources.files import candidate_files, file_manifest

    (tmp_path / "d e").mkdir()
    for name, data in (("a.md", b"x"), ("empty.md", b""), ("d e/é %41.md", b""), ("d e/b.md", b"yy"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["size_bytes"], r["content_hash"][:8]) for r in file_manifest(candidate_files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": (1, "2d711642"), "empty.md": (0, "e3b0c442"), "d e/é %41.md": (0, "e3b0c442"), "d e/b.md": (2, hashlib.sha256(b"yy").hexdigest()[:8])}
    assert {r["path"]: r["decision"] for r in candidate_files(spark, str(tmp_path)).collect()}["c.txt"] == "drop_extension"


def test_stores_are_rewritten_whole(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/store", "k STRING, v BIGINT"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert St.load(spark, folder, schema).count() == 0
    assert St.save_if_changed(frame([]), folder, schema) and St.save_if_changed(frame([("a", 1), ("a", 1), (None, None)]), folder, schema)
    assert not St.save_if_changed(frame([(None, None), ("a", 1), ("a", 1)]), folder, schema)
    frame([("b", 2)]).write.parquet(f"{folder}/v3")  # a run that failed before it named its version
    assert sorted(map(str, St.load(spark, folder, schema).collect())) == sorted(map(str, frame([("a", 1), ("a", 1), (None, None)]).collect()))
    assert St.save(frame([("c", 3)]), folder) == 3 and [tuple(r) for r in St.load(spark, folder, schema).collect()] == [("c", 3)]


def test_admission_over_islands(spark):
    """Roots are cut at gaps; the result is that of the loop, and a root with gaps lies in several parts."""
    rng = random.Random(12)
    rows, want = [], {}
    for root in (1, 2, None):
        times = sorted(rng.randrange(30) + 1000 * rng.randrange(6) for _ in range(200))
        ids = [(root or 0) * 1000 + i for i in range(200)]
        rows += [(root, i, T0 + timedelta(seconds=t)) for i, t in zip(ids, times)]
        want |= dict(zip(ids, admitted(times, 3, 7)))
    df = spark.createDataFrame(rows, "root long, event_id long, ts timestamp")
    assert {r["event_id"]: r["admitted"] for r in O.admission(df, 3, 7).collect()} == want
    cut = O.islands(df.withColumn("t", F.unix_micros("ts")), "root", "t", 7_000_000)
    assert cut.count() == 600 and cut.select("root", "island").distinct().count() >= 15


def test_replay_touches_only_its_buckets(spark, tmp_path):
    from tidemark.streaming import feeds

    rng, latest = random.Random(3), {}
    for i in range(6):
        rows = [(100 * i + j, f"p{rng.randrange(12) if i else j}", rng.choice(["UPSERT", "DELETE"]), rng.randrange(500)) for j in range(40 if not i else 3)]
        for e, p, op, seq in rows:
            latest[p] = max(latest.get(p, (-1, -1, "")), (seq, e, op))
        spark.createDataFrame(rows, "event_id long, path string, op string, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, path string, op string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"replay-{tmp_path.name}-{rng.random()}"
    got = {r["path"]: (r["seq"], r["event_id"], r["op"]) for r in feeds.replay(stream, spark, name).collect()}
    assert got == latest
    held = feeds._held(spark, f"{feeds.shared_dir(spark)}/{name}", 1 << 62)
    assert len(held) > 8 and max(len(v) for v in held.values()) <= 2 and len({v[0] for v in held.values()}) > 1
    again = feeds.replay(stream, spark, name)  # nothing new: the store as it was
    assert {r["path"]: (r["seq"], r["event_id"], r["op"]) for r in again.collect()} == latest


def test_watched_folder(spark, tmp_path):
    from tidemark.streaming import feeds

    (tmp_path / "in" / "d").mkdir(parents=True)
    files = {"a.md": b"x", "d/b.md": b"yy", "d/c.txt": b"z", "d/n.conflict-from-a-1.md": b"q"}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    q = feeds.watch_folder(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["path"]: (r["content_hash"], r["size_bytes"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {n: (hashlib.sha256(files[n]).hexdigest(), len(files[n])) for n in ("a.md", "d/b.md")}


def test_no_local_folder_on_a_cluster():
    from tidemark.plans.staging import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://head:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Spark())


def test_frontmatter_is_searched_once(spark):
    df = spark.createDataFrame([("x",)], "s string").repartition(1)
    for form in (C.pull_form, C.push_form):
        plan = df.select(form(F.col("s"), ["a"]).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") == 1 and plan.count("regexp_replace") == 1


def plain_strip(block, fields):
    out, skip = [], False
    for raw in block.removesuffix("\n").split("\n") if block else []:
        line = raw.removesuffix("\r")
        if line[:1] not in (" ", "\t"):
            skip = ":" in line and line.split(":", 1)[0].strip(" ") in fields
        out += [] if skip else [line + "\n"]
    return "".join(out)


def test_strip_fields_is_linear(spark):
    rng = random.Random(2)
    parts = ("a: 1", "a : x", "b:", "  - 1", "\tz", "", "c", ": x", "a.b: 1", "axb: 1", "a:\r", "e\r\r", "\x85a: 1", "ab: 2", " a: 1")
    blocks = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(9))) + rng.choice(("", "\n", "\r\n")) for _ in range(400)]
    blocks += ["", "\n", "a: 1\n" + "  - x\n" * 60_000 + "c: 1\n", "".join(f"k{i}: 1\n" for i in range(60_000))]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string").repartition(1)
    got = {r.i: r.s for r in df.select("i", C.strip_fields(F.col("b"), ["a", "a.b"]).alias("s")).collect()}
    assert all(got[i] == plain_strip(b, ("a", "a.b")) for i, b in enumerate(blocks))
