"""Stash writes and free numbers against plain loops."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators import stash as K
from tidemark.operators import stores as St

DEVICE = "dev-a"


def loop(losing, files):
    """One row after the other, with the files as they then are."""
    files, out = dict(files), {}
    for o, path, lsn, content in sorted(losing, key=lambda r: r[0]):
        data = content or b""
        if path is None or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or ":/" in path or ":\\" in path:
            out[o] = (None, "refused")
            continue
        folder, _, name = path.replace("\\", "/").rpartition("/")
        stem = name.rsplit(".", 1)[0] if name.rfind(".") > 0 else name
        tail = f".conflict-from-{DEVICE}-{lsn or 0}.md"
        if len((stem + tail).encode()) > 250:
            stem = stem.encode()[:48].decode(errors="ignore") + "." + hashlib.sha256(path.encode()).hexdigest()[:16]
        lead = folder + "/" if folder else ""
        same = sorted(p for p, c in files.items() if c == data and p.startswith(lead + stem + ".conflict-from-") and p.endswith(".md"))
        if same:
            out[o] = (same[0] if same[0] in dict(BEFORE) else same[-1], "there")
            continue
        place, n = lead + stem + tail, 1
        while place in files:
            n += 1
            place = lead + stem + tail[:-3] + f"-{n}.md"
        files[place] = data
        out[o] = (place, "written")
    return out


BEFORE = [
    ("a/n.conflict-from-dev-a-1.md", b"old"), ("a/n.conflict-from-dev-a-1-3.md", b"x1"), ("a/n.conflict-from-dev-b-9.md", b"x2"), ("a/n.md", b"x3"), ("n.conflict-from-dev-a-0-2.md", b"gap"),
    ("a/n.conflict-from-dev-a-1-02.md", b"no number"), ("a/n.conflict-from-dev-a-1.txt", b"x3"), ("b/" + "ü" * 24 + ".conflict-from-dev-a-1.md", b"y"),
]


def rows_of(rng, n):
    paths = ["a/n.md", "a\\n.md", "n.md", "a/n", "b/" + "ü" * 130 + ".md", "a/m.x.md", "/abs.md", "a/../n.md", None, "C:/n.md", ".hidden"]
    return [(i, rng.choice(paths), rng.choice([0, 1, 1, 1, None, 2]), rng.choice([None, b"", b"old", *[f"x{k}".encode() for k in range(9)], bytes([255, k % 256 if (k := i % 40) else 0])])) for i in range(n)]


def test_against_the_loop(spark):
    losing = rows_of(random.Random(3), 400)
    df = spark.createDataFrame(losing, "ord long, path string, lsn long, content binary").withColumn("stash", F.lit("clash"))
    files = spark.createDataFrame(BEFORE, "path string, content binary")
    got = {r["ord"]: r for r in K.place_stashes(df, files, DEVICE).collect()}
    want = loop(losing, BEFORE)
    assert len(got) == len(want) == 400
    for o, (path, status) in want.items():
        assert got[o]["stash"] == path, (losing[o], got[o], path)
        assert got[o]["status"] in (("reused", "shared") if status == "there" else (status,))
        assert got[o]["status"] != "reused" or path in dict(BEFORE)
    assert {r["status"] for r in got.values()} == {"written", "shared", "reused", "refused"}
    assert {r["hashed"] for r in got.values() if (r["path"] or "").startswith("b/")} == {True} and not any(r["hashed"] for r in got.values() if not (r["path"] or "").startswith("b/"))


def test_a_second_pass_writes_nothing(spark, tmp_path):
    losing = spark.createDataFrame(rows_of(random.Random(4), 150), "ord long, path string, lsn long, content binary")
    files = spark.createDataFrame(BEFORE, "path string, content binary")
    placed = K.place_stashes(losing, files, DEVICE)
    new = K.new_files(placed, losing).collect()
    assert len({r["path"] for r in new}) == len(new) and not {r["path"] for r in new} & {p for p, _ in BEFORE}
    after = spark.createDataFrame(BEFORE + [(r["path"], bytes(r["content"])) for r in new], "path string, content binary")
    again = {r["ord"]: r for r in K.place_stashes(losing, after, DEVICE).collect()}
    assert {r["status"] for r in again.values()} == {"reused", "refused"}
    # bytes that lay there before keep their file, the others find the one that was written for them
    assert all(again[r["ord"]]["stash"] == r["stash"] for r in placed.collect())
    St.record_stash_manifest(K.manifest_rows(placed, DEVICE, 7), str(tmp_path / "manifest"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "manifest")).collect()]
    assert lines and all(x["original"].startswith("b/") and x["stash"].startswith("b/") and x["ts"] == 7 and x["device"] == DEVICE for x in lines)
    assert len({x["stash"] for x in lines}) == len(lines)


def test_empty_tables(spark):
    losing = spark.createDataFrame([], "ord long, path string, lsn long, content binary")
    files = spark.createDataFrame([], "path string, content binary")
    assert K.place_stashes(losing, files, DEVICE).count() == 0
    one = spark.createDataFrame([(1, "n.md", None, None)], "ord long, path string, lsn long, content binary")
    assert [(r["stash"], r["status"]) for r in K.place_stashes(one, files, DEVICE).collect()] == [("n.conflict-from-dev-a-0.md", "written")]
    assert K.place_stashes(losing, spark.createDataFrame(BEFORE, "path string, content binary"), DEVICE).count() == 0


def test_free_numbers_of_a_hot_base(spark):
    rng = random.Random(9)
    taken = {"a": set(rng.sample(range(1, 4000), 1500)), "b": {2, 3}, "c": {1}, "d": set(), "unused": {1, 5}}
    wanted = [("a", i) for i in range(3000)] + [(b, i) for b in "bcd" for i in range(5000, 5004)]
    got = O.free_suffix(spark.createDataFrame(wanted, "base string, ord long").repartition(3), spark.createDataFrame([(b, s) for b, x in taken.items() for s in x], "base string, slot int"))
    got = {(r["base"], r["ord"]): r["slot"] for r in got.collect()}
    want = {}
    for b in "abcd":
        free = (s for s in range(1, 10_000) if s not in taken[b])
        want |= {(b, o): next(free) for x, o in wanted if x == b}
    assert got == want
