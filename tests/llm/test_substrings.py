"""Repeated passages against a word-window scan of every pair, planted passages, and awkward rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

import numpy as np
import pytest

from tidemark.llm import substrings
from tidemark.llm.substrings import drop_repeats, gear_hashes, repeated_passages


def windows(rows, n=50):
    """doc_ids that share a run of n whole words, white space included, with another."""
    import re

    seen = defaultdict(set)
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for k in range(len(spans) - n + 1):
            seen[t[spans[k][0] : spans[k + n - 1][1]]].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = repeated_passages(df).collect()
    want = windows(rows)
    found = {r["doc_id"] for r in got}
    assert found == want
    text = dict(rows)
    for r in got:
        piece = text[r["doc_id"]][r["start"] : r["end"]]
        assert len(piece.split()) >= r["n_words"] >= 50 and not piece[0].isspace() and not piece[-1].isspace()


def test_planted(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}é" for a in ("al", "be", "cor", "du", "es") for b in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [prose(60) for _ in range(30)]
    rows = []
    for i in range(300):
        body = [prose(rng.randint(5, 80)), prose(rng.randint(5, 80))]
        rows.append((i, shared[i % 30].join([body[0] + " ", "\n" + body[1]]) if i < 150 else " ".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = repeated_passages(df)
    got = {r["doc_id"] for r in spans.collect()}
    assert got == set(range(150))
    left = {r["doc_id"]: r["text"] for r in drop_repeats(df, spans).collect()}
    assert sum(shared[i % 30] in left[i] for i in got) == 30  # one copy of each stays
    assert all(left[i] == rows[i][1] for i in range(150, 300))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 5000), (4, "b" + "a" * 5000), (5, "x " * 9000), (6, "y " + "x " * 9000), (None, "x " * 900), (5, "x " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("owner", F.lit(0)).withColumn("start", F.lit(""))
    got = {r["doc_id"] for r in repeated_passages(df).collect()}
    assert got <= {5, 6}
    assert repeated_passages(df.limit(0)).count() == 0


def held(rows, n=50):
    """{(doc_id, first): code points} that lie in windows of n words which two documents have."""
    import re

    seen, spans = defaultdict(lambda: defaultdict(list)), {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for k in range(len(spans) - n + 1):
            s, e = spans[k][0], spans[k + n - 1][1]
            seen[t[s:e]][i].append((s, e))
    out = defaultdict(set)
    for ids in seen.values():
        for i in ids if len(ids) > 1 else ():
            for s, e in ids[i]:
                out[i, i == min(ids)].update(range(s, e))
    return dict(out)


def covered(got):
    out = defaultdict(set)
    for r in got:
        out[r["doc_id"], r["first"]].update(range(r["start"], r["end"]))
    return dict(out)


def test_edited_smallest_copy(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    rows = []
    for g in range(40):
        passage = prose(55)
        edited = passage[:6] + [word()] + passage[7:]
        other = passage[:50] + [word()] + passage[51:]
        for m, body in enumerate((edited, passage, passage, other)):
            rows.append((10 * g + m, " ".join(prose(20) + body + prose(20))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(got) == held(rows)
    assert {r["doc_id"] % 10 for r in got} == {1, 2, 3} and len({r["doc_id"] for r in got}) == 120
    assert {(r["doc_id"] % 10, r["partner_id"] % 10, r["n_words"]) for r in got} == {(1, 2, 55), (2, 1, 55), (3, 1, 50)}


def test_table_passage_by_passage(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert covered(repeated_passages(df).collect()) == held(rows)


def test_short_words(spark):
    rng = random.Random(7)
    prose = lambda n, top: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, top))) for _ in range(n))
    rows = []
    for g in range(60):
        shared = prose(51, 1 + g % 3)
        rows += [(2 * g + m, f"{prose(30, 8)} {shared} {prose(30, 8)}") for m in (0, 1)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(got) == held(rows) and {r["doc_id"] for r in got} == set(range(120))


@pytest.mark.parametrize("width", [1, 2, 16, 32])
def test_gear_rolls(width, monkeypatch):
    """The hash of each place equals the rolling one, slice by slice."""
    monkeypatch.setattr(substrings, "SLICE_BYTES", 64)
    data = np.random.default_rng(1).integers(0, 256, 1000, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 64 // width) + int(substrings._GEAR[b])) & (1 << 64) - 1
        want.append(h)
    at = np.arange(width - 1, 1000, 3)
    assert gear_hashes(data, at, width).tolist() == [want[i] for i in at]


def test_cuts_resist_insertions():
    """An inserted word changes no chunk but those near it."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    digests = []
    for w in (words, words[:1000] + ["new"] + words[1000:]):
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        digests.append(set(substrings.units(data, np.array([0, len(data)]), 50)[2].tolist()))
    assert len(digests[0]) > 80 and len(digests[0] - digests[1]) <= 6


def test_layered_copies(spark):
    """Documents 2 and 3 of a group share 60 words, of which document 0 holds the first 40 and document 1 the last 40."""
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for g in range(20):
        passage = prose(60)
        for m, body in enumerate((passage[:40], passage[20:], passage, passage)):
            rows.append((10 * g + m, " ".join(prose(20) + body + prose(20))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(got) == held(rows) and len({r["doc_id"] for r in got}) == 40


def test_long_text_with_many_cuts(spark):
    rng = random.Random(13)
    passage = " ".join("".join(rng.choice("abcdéfgh") for _ in range(6)) for _ in range(60))
    filler = lambda: "".join(rng.choice("stuvwxyz") for _ in range(8))
    long = " ".join(f"{filler()} {passage}" for _ in range(2000))
    df = spark.createDataFrame([(1, f"{filler()} {passage} {filler()}"), (2, long), (3, None)], "doc_id long, text string")
    spans = repeated_passages(df)
    left = {r["doc_id"]: r["text"] for r in drop_repeats(df, spans).collect()}
    assert passage in left[1] and passage not in left[2] and len(left[2].split()) == 2000 and left[3] is None
