"""The folder walk on executors against os.walk, and its odd entries."""

import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.sources import folders


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "top"
    for name, content in {"a.md": b"one", "x/b.md": b"", "x/y/z/c.MD": b"three" * 50_000, "x/d.txt": b"d", "node_modules/e.md": b"e", "x/._f.md": b"f", "x/g.conflict-from-h-1.md": b"g", "x/rules/h.md": b"h"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "o.md").write_bytes(b"o")
    (top / "x" / "out").symlink_to(tmp_path / "outside")
    (top / "x" / "self").symlink_to(top)
    (top / "gone.md").symlink_to(top / "never")
    os.mkfifo(top / "pipe.md")
    with open(os.fsencode(str(top)) + b"/b\xff.md", "wb") as f:
        f.write(b"odd")
    return top


def test_outcomes_and_counters(spark, tree):
    s = folders.scan(spark, f"file://{tree}", rules=[("prefix", "rules/", "")])
    assert {r["path"]: r["outcome"] for r in s.collect()} == {
        "a.md": "take", "x/b.md": "take", "x/y/z/c.MD": "take", "x/d.txt": "extension", "node_modules/e.md": "exclude", "x/._f.md": "junk", "b�.md": "take",
        "x/g.conflict-from-h-1.md": "conflict_copy", "x/rules/h.md": "substrate", "x/out": "symlink", "x/self": "symlink", "gone.md": "symlink"}
    files, counts = folders.manifest(s)
    want = {("a.md", b"one"), ("x/b.md", b""), ("x/y/z/c.MD", b"three" * 50_000), ("b�.md", b"odd")}
    assert {tuple(r) for r in files.collect()} == {(p, hashlib.sha256(c).hexdigest(), len(c)) for p, c in want}
    assert tuple(counts.first()) == (3, 1, 1, 0)
    open_fence = folders.scan(spark, str(tree), rules=[("prefix", "rules/", "")], fence=False)
    assert open_fence.filter("path = 'x/rules/h.md'").first()["outcome"] == "take"


def test_what_vanishes_or_turns_into_a_link_is_an_error(spark, tree):
    s = folders.scan(spark, str(tree)).cache()
    s.count()
    (tree / "a.md").unlink()
    (tree / "x/b.md").unlink()
    (tree / "x/b.md").symlink_to(tree / "x/d.txt")
    files, counts = folders.manifest(s)
    assert counts.first()["errors"] == 2 and files.filter("path IN ('a.md', 'x/b.md')").count() == 0
    s.unpersist()
    shutil.rmtree(tree / "x/y")
    (tree / "w").symlink_to(tree / "x")
    at = [(bytearray(os.fsencode(f"{tree}/{n}")),) for n in ("x/y", "w", "x/d.txt")]
    got = folders.list_level(spark.createDataFrame(at, "at BINARY"), str(tree)).collect()
    assert {(r["path"], r["kind"], r["error"]) for r in got} == {("x/y", "error", "No such file or directory"), ("w", "escape", None), ("x/d.txt", "error", "Not a directory")}
    assert {r["outcome"] for r in spark.createDataFrame(got, folders.ENTRIES).select(folders.outcome().alias("outcome")).collect()} == {"error", "escape"}


def test_missing_empty_and_foreign_roots(spark, tmp_path):
    assert folders.walk(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty").mkdir()
    files, counts = folders.manifest(folders.scan(spark, str(tmp_path / "empty")))
    assert files.count() == 0 and tuple(counts.first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        folders.walk(spark, "s3://bucket/x")


def test_as_a_plain_walk(spark, tmp_path):
    top = tmp_path / "wide"
    rows = spark.range(3000).select(F.format_string("%d/%d/n%d.md", F.col("id") % 40, F.col("id") % 7, "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"), F.lit(None).cast("string").alias("link"))
    folders.write_tree(rows, str(top))
    folders.write_tree(rows, str(top))
    flat = folders.walk(spark, str(top))
    want = {os.path.relpath(os.path.join(d, n), top) for d, sub, names in os.walk(top) for n in sub + names}
    assert {r["path"] for r in flat.select("path").collect()} == want and flat.filter("kind = 'file'").count() == 3000


def test_a_file_is_hashed_by_tasks_that_read_a_part_each(spark, tmp_path, monkeypatch):
    """Before, one task read and held a file whole, and one beyond Spark's limit for a value failed (the limit is lowered here from 2 GB)."""
    from tidemark.sources.files import candidate_files, file_manifest

    sizes = {"a/none.md": 0, "a/part.md": 999, "one.md": 1000, "two.md": 2000, "b c/large.md": 10_500, "é.md": 1001}
    for i, (name, n) in enumerate(sizes.items()):
        (tmp_path / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / name).write_bytes(bytes((i + j * j) % 251 for j in range(n)))
    (tmp_path / "top/link.md").symlink_to(tmp_path / "top/b c/large.md")
    want = {(n, hashlib.sha256((tmp_path / "top" / n).read_bytes()).hexdigest(), (tmp_path / "top" / n).stat().st_size) for n in [*sizes, "link.md"]}
    rounds, stage = [], folders.stage
    monkeypatch.setattr(folders, "TASK_BYTES", 1000)
    monkeypatch.setattr(folders, "stage", lambda df, name: rounds.append(stage(df, name)) or rounds[-1])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "500")
    try:
        got = file_manifest(candidate_files(spark, str(tmp_path / "top")))
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r.agg(F.max("done")).first()[0] for r in rounds] == [1000 * (i + 1) for i in range(10)]
    monkeypatch.setattr(folders, "resumed", lambda state: None)
    assert {tuple(r) for r in file_manifest(candidate_files(spark, str(tmp_path / "top"))).collect()} == want


def test_files_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(folders, "TASK_BYTES", 1000)
    rows = spark.range(0, 400).select(F.col("id").cast("string").alias("path"), F.col("id").cast("string").cast("binary").alias("at"), F.when(F.col("id") % 8 == 0, 1000).otherwise(F.col("id") % 60 + 1).cast("long").alias("n"))
    total = rows.agg(F.sum("n")).first()[0]
    dealt = folders._dealt(rows.withColumn("b", F.col("n")), total).groupBy(F.spark_partition_id()).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    tasks = dealt.collect()
    assert sum(r["n"] for r in tasks) == 400 and max(r["b"] for r in tasks) < 2500


def test_a_file_that_cannot_be_read_fails_its_manifest(spark, tmp_path):
    from tidemark.sources.files import candidate_files, file_manifest

    (tmp_path / "a.md").write_bytes(b"x")
    (tmp_path / "b.md").write_bytes(b"y")
    files = candidate_files(spark, str(tmp_path)).drop("content").cache()
    assert files.count() == 2
    (tmp_path / "b.md").unlink()
    with pytest.raises(Exception, match="b.md: No such file or directory"):
        file_manifest(files).collect()
    files.unpersist()
