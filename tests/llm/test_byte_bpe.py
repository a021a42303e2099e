"""Prefix tables against the tiktoken library, exact appends and edits, and the round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe
from tidemark.llm.queries import op12_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
WHOLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = byte_bpe.vocabulary(PATH, PATTERN)
TEXTS = st.text(st.one_of(st.sampled_from("aeinorst lhdEST   '\n\t0159.,-=<|>"), st.characters(exclude_categories=["Cs"])), max_size=80)


def ids(raw: bytes) -> list[int]:
    return list(memoryview(raw).cast("i"))


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_same_ids(t):
    assert ids(BPE.encode(t)) == WHOLE.encode_ordinary(t) == ids(BPE.ids_of(BPE.prefixes(t)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeinrstlhd"), min_size=1, max_size=40), st.integers(0, 40))
def test_every_prefix(t, n):
    raw = t.encode()
    last = BPE.table(raw)
    assert all(BPE.read(last[:i]) == WHOLE.encode_ordinary(t[:i]) for i in range(len(raw) + 1))
    assert BPE.table(raw, last[:n]) == last


@pytest.mark.parametrize("t", ["a" * 3000, " " * 3000, "-=" * 1500, "it's we'll 'lx x'l '", "<|endoftext|>", "é" * 500, "ab́​\U0001f600" * 300, "the" * 1000, "\n \n  \n\n x"])
def test_odd_texts(t):
    assert ids(BPE.encode(t)) == WHOLE.encode_ordinary(t)


@settings(max_examples=600, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 90), st.integers(0, 90))
def test_edits(t, new, a, b):
    a, b = sorted((a, b))
    after, table = BPE.revise(t, BPE.prefixes(t), a, b, new)
    assert after == t[:a] + new + t[max(a, b) :]
    assert table == BPE.prefixes(after)


def test_an_append_computes_only_new_bytes(monkeypatch):
    t, seen = "ab" * 20_000, []
    table, plain = BPE.prefixes(t), BPE.table
    monkeypatch.setattr(BPE, "table", lambda piece, known=None: seen.append(len(piece) - len(known or ())) or plain(piece, known))
    after, new = BPE.revise(t, table, len(t), len(t), "abc de")
    assert sum(seen) < 20
    assert ids(BPE.ids_of(new)) == WHOLE.encode_ordinary(after)


def test_operators(spark):
    rows = [(1, "Hello world, it's", "x"), (2, None, "y"), (2, "", "z"), (None, "no id é\U0001f600", None), (1, "Hello world, it's", "x"), (3, "word " * 300_000 + "q" * 5000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = byte_bpe.encode(docs, PATH, PATTERN)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(coded, PATH, PATTERN).collect()), key=str)
    assert got == sorted(((i, WHOLE.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH, PATTERN).first().decoded == b""
    stored = byte_bpe.encode_prefixes(docs, PATH, PATTERN)
    edits = stored.selectExpr("*", "5 AS start", "CASE WHEN doc_id = 3 THEN null ELSE 7 END AS stop", "' more' AS insert")
    plain = lambda i, t: t if i == 3 else t[:5] + " more" + t[7:]
    revised = byte_bpe.revise(edits, PATH, PATTERN).collect()
    assert sorted(r.text for r in revised) == sorted(plain(i, t or "") for i, t, _ in rows)
    assert all(r.ids == WHOLE.encode_ordinary(r.text) and bytes(r.prefixes) == BPE.prefixes(r.text) for r in revised)
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_query_is_the_library(spark, sf):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        t = WHOLE.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(t), sha(" ".join(map(str, t)).encode()), sha((d.text or "").encode())))
    got = op12_byte_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
