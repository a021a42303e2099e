"""Packing: ids against the tokenizer on whole texts, a gapless round trip, and padding."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import WINDOW, WordTokenizer, best_fit_decreasing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, FAST = Tokenizer.from_file(PATH), WordTokenizer(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85 ́Σσ'<|>sT")), max_size=60))
def test_word_by_word_is_the_whole_text(t):
    ids, at = FAST.encode(pa.array(["x y", t, None, t], pa.large_string()))
    want = WHOLE.encode(t, add_special_tokens=False).ids
    assert [ids[a:b].tolist() for a, b in zip(at[1:], at[2:])] == [want, [], want]


@pytest.mark.parametrize("t", ["a<|startoftext|>b <|endoftext|> c", "it's don't 'sx", "ΟΔΟΣ ΣΑΣ.", "é ́x", "", "İstanbul"])
def test_special_words(t):
    ids, at = FAST.encode(pa.array(["x y", t, None, t], pa.large_string()))
    want = WHOLE.encode(t, add_special_tokens=False).ids
    assert [ids[a:b].tolist() for a, b in zip(at[1:], at[2:])] == [want, [], want]


def brute(lengths, window):
    room, where = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        k = max(i for i, r in enumerate(room) if r == min(fits)) if fits else len(room)
        if k == len(room):
            room.append(window)
        room[k] -= n
        where.append(k)
    return room


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([32, 37]))
def test_tree_finds_the_tightest_window(lengths, window):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    where, offset = best_fit_decreasing(lengths, window)
    used = defaultdict(int)
    for w, o, n in zip(where, offset, lengths):
        assert used[w] == o
        used[w] += n
    assert sorted(used.values()) == sorted(window - r for r in brute(lengths, window))


def check(df, **kw):
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(np.array(WHOLE.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4"))
    out = pack(df, PATH, **kw).collect()
    assert sum(r["length"] for r in out) == sum(len(x) for v in texts.values() for x in v)
    windows = defaultdict(list)
    for r in out:
        options = [x for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in options)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in windows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= WINDOW
    return len(windows) * WINDOW / max(1, sum(r["length"] for r in out))


def test_table(spark):
    assert check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) < 1.02


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (1, ""), (2, "x " * 50_000), (None, "a b"), (3, "same words"), (3, "same words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS length")
    check(df)
    check(df, shard_tokens=500)
    assert pack(df.limit(0), PATH).count() == 0


def test_a_tokenizer_that_keeps_case_and_space():
    """A file that the rules of word tables do not hold for is applied to whole texts."""
    for name in sorted(os.listdir(os.path.dirname(PATH))):
        if not name.endswith(".json"):
            continue
        try:
            whole = Tokenizer.from_file(os.path.join(os.path.dirname(PATH), name))
        except Exception:
            continue
        fast = WordTokenizer(os.path.join(os.path.dirname(PATH), name))
        for t in ("Two  Words.\n Next (one) it's", "", "ÀÉ x"):
            ids, at = fast.encode(pa.array([t, None], pa.large_string()))
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]
