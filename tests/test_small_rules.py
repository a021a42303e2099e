"""Rules of single rows and small joins, called on tables of our own."""

import base64
import hashlib

from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.operators import ordered as O
from tidemark.operators import reconcile as R


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_bases_and_lineage(spark):
    pushes = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "h"), (4, "b", None), (5, None, None)], "id INT, path STRING, base_hash STRING")
    shadow = spark.createDataFrame([("a", "s", 1)], "path STRING, server_hash STRING, id INT")
    seq = spark.createDataFrame([("b", 7, "x")], "path STRING, seq BIGINT, base STRING")
    got = {r["id"]: (r["base"], r["base_kind"], r["lineage"]) for r in R.declared_bases(pushes, shadow, seq).collect()}
    assert got == {1: ("s", "unknown", None), 2: ("", "no_row", None), 3: ("h", "known", None), 4: (None, "unknown", 7), 5: (None, "unknown", None)}


def test_push_entries_name_what_the_manifest_lacks(spark):
    changes = spark.createDataFrame([("a", "drift", "s"), ("b", "missing-on-server", None), ("c", "drift", "s")], "path STRING, state STRING, server_hash STRING")
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path STRING, size_bytes BIGINT, content_hash STRING")
    assert {tuple(r) for r in R.push_entries(changes, manifest).collect()} == {("a", 1, "x", "s", None), ("b", 2, "y", "", None), ("c", None, None, None, "delta path not in local manifest")}


def test_single_append_and_materialize_back(spark):
    r = spark.range(1).select(S.single_append(F.lit(5), 95, 100).alias("a"), S.single_append(F.lit(6), 95, 100).alias("b")).first()
    assert tuple(r) == ("ok", "error_over_cap")
    cases = [((True, "modify", "d", "c", "c"), "align_form_c"), ((True, "modify", "d", "c", "x"), "fetch"), ((True, "modify", "d", "c", "d"), "none"), ((True, "delete", "d", "c", "x"), "none"),
             ((True, "modify", "d", "c", None), "none"), ((False, "modify", "d", "c", "c"), "none"), ((None, None, "d", "c", "c"), "none"), ((True, None, None, None, "x"), "fetch")]
    rows = spark.createDataFrame([c for c, _ in cases], "accepted BOOLEAN, action STRING, drained STRING, canonical STRING, server STRING")
    got = rows.coalesce(1).select(S.materialize_back(*map(F.col, rows.columns)).alias("a")).collect()
    assert [r["a"] for r in got] == [w for _, w in cases]


def test_pre_journal_in_order(spark):
    cases = [("s/x.txt", "", "substrate"), ("a.conflict-from-h-1.md", "", "managed"), ("a.txt", "", "extension"), ("a.MD", "", "empty"), ("a.md", "same", "identical"), ("a.md", "other", None), ("a.md", None, None)]
    rows = spark.createDataFrame([(p, b, sha("same")) for p, b, _ in cases], "path STRING, body STRING, last STRING").coalesce(1)
    got = rows.select(C.pre_journal(F.col("path"), F.col("body"), F.col("body"), F.col("last"), rules=[("prefix", "s/", "")]).alias("s")).collect()
    assert [r["s"] for r in got] == [w for _, _, w in cases]
    free = rows.select(C.pre_journal(F.col("path"), F.col("body"), F.col("body"), F.lit(None).cast("string"), managed=False).alias("s")).collect()
    assert [r["s"] for r in free] == ["extension", "empty", "extension", "empty", None, None, None]


def test_bodies_as_base64_or_numbers(spark):
    data = bytes(range(256)) * 3
    cases = {f'"{base64.b64encode(data).decode()}"': data, "[0, 15, 16, 255]": b"\x00\x0f\x10\xff", "[]": b"", '""': b"", "[256]": None, "[-1]": None, "[1, null]": None, '["a"]': None, '"%%%"': None, "5": None, "null": None, "{}": None}
    rows = spark.createDataFrame([(k,) for k in cases], "j STRING").coalesce(1)
    got = rows.select(C.body_bytes(F.call_function("try_parse_json", F.col("j"))).alias("b"), C.to_base64(F.lit(bytearray(data))).alias("t")).collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in got] == list(cases.values())
    assert got[0]["t"] == base64.b64encode(data).decode()


def test_folders_names_chains_and_stashes(spark):
    paths = spark.createDataFrame([("a/.app/x",), ("a/b",), ("b/c",), (".d/e",), ("top.md",), ("/f/g",)], "path STRING")
    assert {tuple(r) for r in R.folders(paths, ".app").collect()} == {("a", True), ("b", False)}
    names = [("x.conflict-from-.md", True), ("d\\x.conflict-from-h-1.md", True), ("x.conflict-from-h-1.txt", False), ("a.conflict-from-b/x.md", False)]
    got = spark.createDataFrame([(n,) for n, _ in names], "path STRING").coalesce(1).select(P.is_unresolved(F.col("path")).alias("u")).collect()
    assert [r["u"] for r in got] == [u for _, u in names]
    lines = spark.createDataFrame([(i * 10, "ab"[i % 2], f"k{i}") for i in range(5)], "line_no BIGINT, path STRING, action STRING")
    assert {tuple(r) for r in O.chains(lines, 3).collect()} == {(0, "a", 2, "k0>k2"), (0, "b", 1, "k1"), (1, "b", 1, "k3"), (1, "a", 1, "k4")}
    want = spark.createDataFrame([(1, "n", "x"), (2, "n", "y"), (3, None, "x")], "id INT, base STRING, sha STRING")
    there, fresh = R.unseen_stashes(want, spark.createDataFrame([("n", "x"), ("n", "x")], "base STRING, sha STRING"), "base", "sha")
    assert [r["id"] for r in there.collect()] == [1] and {r["id"] for r in fresh.collect()} == {2, 3}
