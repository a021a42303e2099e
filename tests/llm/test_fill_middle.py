"""Fill-in-the-middle against plain slicing, and the text rebuilt from every output."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import duck, same
from tidemark.llm import fill_middle as fim
from tidemark.llm.queries import OP13_SQL, op13_fill_middle


def plain(doc_id, text, rate=90, swapped=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((d[0] % (len(t) + 1), d[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= rate:
        return doc_id, len(t), "plain", None, None, t
    pre, mid, suf = t[:lo], t[lo:hi], t[hi:]
    if d[3] % 100 < swapped:
        return doc_id, len(t), "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(t), "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def held(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.restore(fim.fill_in_middle(docs, **how)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain(i, t, **how) for i, t, _ in rows)
    assert Counter(r.restored for r in got) == Counter(t or "" for _, t, _ in rows)


def test_lengths_around_blocks(spark):
    held(spark, [(i, ("aé\U0001f600\ńx<" * 80)[: i % 400], "own") for i in range(3000)])
    held(spark, [(i, "y" * (fim.BLOCK * (i % 3)), None) for i in range(600)], rate=100, swapped=50)


def test_odd_rows(spark):
    odd = [None, "", "a", "has <P> in it", "<S>", "x<M", "a\x00b\x00", "\r\n\x85 ", "<", "S><", "é" * 70, "‍\U0001f468‍\U0001f469" * 40]
    held(spark, [(i, t, "clash") for i in [None, 1, 1, 7, 99, -5, 2**62] for t in odd])
    held(spark, [(1, "z\U0001f600" * 1_500_000, None), (2, "short", None)])
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fim.restore(spark.createDataFrame([(None, None)], "form string, output string")).first().restored == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("a<PSM>é\n"), max_size=150), max_size=20))
def test_marks_part_unambiguously(texts):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("rows", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    out = con.sql(fim._cut_sql(1, 90, 20)).to_arrow_table()
    con.register("rows", out)
    back = {r["doc_id"]: r["restored"] for r in con.sql(fim._part_sql()).to_arrow_table().to_pylist()}
    assert [back[i] for i in range(len(texts))] == texts


def test_query(spark, sf):
    same(op13_fill_middle(spark, sf), duck(sf), OP13_SQL)
