"""Several stores under one manifest: decisions, failures between two stores, and batches that come again."""

import hashlib
import random

import pytest

from tidemark.streaming import materialize as M

SCHEMA = "path string, content string, server_hash string, seq long"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows(spark, *notes):
    return spark.createDataFrame([(p, c, h or sha(c), s) for p, c, h, s in notes], SCHEMA)


def state(stores):
    return {name: sorted(map(tuple, stores.read(name).collect()), key=str) for name in M.STORES}


def test_rules(spark, tmp_path):
    at = str(tmp_path / "s")
    assert M.apply_batch(M.Stores(spark, at), rows(spark, ("a.md", "one", None, 1), ("b.md", "two", None, 2), ("../x.md", "no", None, 3), (None, "no", None, 4), ("c.md", "x", sha("y"), 5)), 0, "dev")
    s = M.Stores(spark, at)
    assert state(s)["notes"] == [("a.md", "one", sha("one")), ("b.md", "two", sha("two"))] and state(s)["ledger"] == [("c.md", 1, "integrity_failed")]
    # a local edit of b, then: a moves on (clean pull), b comes unchanged (local edit stays), c comes whole, d repeats within a batch
    local = spark.createDataFrame([("a.md", "one", sha("one")), ("b.md", "mine", sha("mine"))], M.STORES["notes"])
    s.commit({"notes": local}, set(range(M.BUCKETS)), 0)
    M.apply_batch(M.Stores(spark, at), rows(spark, ("a.md", "one+", None, 10), ("b.md", "two", None, 11), ("c.md", "x", sha("y"), 12), ("d.md", "old", None, 13), ("d.md", "new", None, 14)), 1, "dev")
    got = state(M.Stores(spark, at))
    assert got["notes"] == [("a.md", "one+", sha("one+")), ("b.md", "mine", sha("mine")), ("d.md", "new", sha("new"))]
    assert got["ledger"] == [("c.md", 2, "integrity_failed")] and ("a.md", 10, "adopted") in got["lineage"] and ("b.md", 2, "adopted") in got["lineage"]
    # the server moves on as well: the local bytes are stashed; c clears its failures
    M.apply_batch(M.Stores(spark, at), rows(spark, ("b.md", "two+", None, 20), ("c.md", "x", None, 21), ("d.md", "new", None, 22)), 2, "dev")
    got = state(M.Stores(spark, at))
    assert got["stashes"] == [("b.md", "b.conflict-from-dev-20.md", "mine")] and got["ledger"] == []
    assert ("b.md", "two+", sha("two+")) in got["notes"] and ("d.md", 22, "observed") in got["lineage"]


def test_a_failure_between_stores_changes_nothing(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    M.apply_batch(M.Stores(spark, at), rows(spark, ("a.md", "one", None, 1)), 0, "dev")
    before, plain = state(M.Stores(spark, at)), M._bucket
    calls = []

    def fails():
        calls.append(1)
        if len(calls) == 4:  # after notes and baseline were written
            raise RuntimeError("lost")
        return plain()

    monkeypatch.setattr(M, "_bucket", fails)
    batch = rows(spark, ("a.md", "two", None, 2), ("b.md", "b", None, 3))
    with pytest.raises(RuntimeError, match="lost"):
        M.apply_batch(M.Stores(spark, at), batch, 1, "dev")
    monkeypatch.undo()
    assert list((tmp_path / "s" / "baseline").glob("v2-*")) and state(M.Stores(spark, at)) == before
    assert M.apply_batch(M.Stores(spark, at), batch, 1, "dev")
    after = state(M.Stores(spark, at))
    assert [n[:2] for n in after["notes"]] == [("a.md", "two"), ("b.md", "b")]
    assert not M.apply_batch(M.Stores(spark, at), rows(spark, ("a.md", "three", None, 9)), 1, "dev") and state(M.Stores(spark, at)) == after


def test_two_writers(spark, tmp_path):
    at = str(tmp_path / "s")
    first, second = M.Stores(spark, at), M.Stores(spark, at)
    M.apply_batch(first, rows(spark, ("a.md", "one", None, 1)), 0, "dev")
    with pytest.raises(RuntimeError, match="another writer"):
        M.apply_batch(second, rows(spark, ("b.md", "two", None, 1)), 0, "dev")
    assert state(M.Stores(spark, at))["notes"] == [("a.md", "one", sha("one"))]


def test_empty(spark, tmp_path):
    s = M.Stores(spark, str(tmp_path / "none"))
    assert all(v == [] for v in state(s).values())
    assert M.apply_batch(s, rows(spark, ("a.md", "x", None, 1)).limit(0), 0, "dev") and not M.apply_batch(s, rows(spark, ("a.md", "x", None, 1)), 0, "dev")


def test_texts_are_written_once(spark, tmp_path, monkeypatch):
    """Before, each commit wrote all texts of its buckets anew, and a stash was one more copy. The map of wanted texts is full here."""
    monkeypatch.setattr(M, "BITS", 64)
    at, rng = str(tmp_path / "s"), random.Random(3)
    mine = {f"n{i}.md": rng.randbytes(100_000).hex() for i in range(20)}
    M.Stores(spark, at).commit({"notes": spark.createDataFrame([(p, t, sha(t)) for p, t in mine.items()], M.STORES["notes"])}, set(range(M.BUCKETS)), -1)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))
    first = size()
    for k in range(2):  # all buckets are touched; n0 to n4 conflict in the first batch, n5 to n9 come equal, n10 comes cut
        more = [(f"m{k}-{i}.md", f"new {k} {i}", None, 1000 * k + i) for i in range(200)]
        sent = [(f"n{i}.md", "theirs", None, 5000 + i) for i in range(5)] + [(f"n{i}.md", mine[f"n{i}.md"], None, 6000 + i) for i in range(5, 10)] + [("n10.md", "cut", sha("whole"), 7000)]
        M.apply_batch(M.Stores(spark, at), rows(spark, *more, *(sent if k == 0 else [])).repartition(3), k, "dev")
    assert size() < 2 * first
    got = state(M.Stores(spark, at))
    want = mine | {f"n{i}.md": "theirs" for i in range(5)} | {f"m{k}-{i}.md": f"new {k} {i}" for k in range(2) for i in range(200)}
    assert got["notes"] == sorted((p, t, sha(t)) for p, t in want.items())
    assert got["stashes"] == [(f"n{i}.md", f"n{i}.conflict-from-dev-{5000 + i}.md", mine[f"n{i}.md"]) for i in range(5)] and got["ledger"] == [("n10.md", 1, "integrity_failed")]
    held = spark.read.parquet(f"{at}/texts").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in held} == {p: 1 + (p in {f"n{i}.md" for i in range(5)}) for p in want}


def test_of_equal_rows_the_whole_one_counts(spark, tmp_path):
    at = str(tmp_path / "s")
    M.apply_batch(M.Stores(spark, at), rows(spark, ("a.md", "cut", sha("whole"), 1), ("a.md", "whole", None, 1), ("a.md", "whole", None, 1), ("b.md", "x", None, None), ("b.md", "y", None, 2)).repartition(4), 0, "dev")
    assert state(M.Stores(spark, at))["notes"] == [("a.md", "whole", sha("whole")), ("b.md", "y", sha("y"))] and state(M.Stores(spark, at))["ledger"] == []
