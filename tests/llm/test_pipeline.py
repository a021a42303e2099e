"""The pipeline stage by stage against plain versions of its decisions, and over rows that lack everything."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_near_dups import brute
from tests.llm.test_spans import brute_pii
from tidemark.plans.staging import stage

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = stage(p.quality_classifier(spark, docs, SF))
    assert good.columns == docs.columns and good.exceptAll(docs).count() == 0
    rated = labels.join(good.select("doc_id", F.lit(True).alias("in")), "doc_id", "left").toPandas()
    assert rated[rated.quality == 1]["in"].notna().mean() > 0.99
    assert rated[rated.quality == 0]["in"].notna().mean() < 0.25

    single = stage(p.near_duplicates(spark, good, SF))
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    clean = stage(p.personal_data(spark, single, SF))
    assert clean.columns == docs.columns and clean.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        spans = [s for kind in brute_pii(before[r["doc_id"]]) for s in kind]
        assert not any(brute_pii(r["text"])[:2]) and r["n_chars"] == len(r["text"])
        if not spans and "<" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]

    mixed = stage(p.mixing(spark, clean, SF))
    size = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in clean.collect()}
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 3 and mixed.columns == docs.columns
    total = sum(n for _, n in size.values())
    assert abs(sum(size[i][1] * c for i, c in taken.items()) - total) < 0.05 * total

    packed = p.packing(spark, mixed, SF).collect()
    again = p.run(spark, SF).collect()
    assert Counter(map(tuple, packed)) == Counter(map(tuple, again))
    assert {r["doc_id"] for r in packed} == set(taken)


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, ids with several texts, ties, clashing columns, no rows."""
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0), (4, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    call, long = "call +1 (988) 555-2485 now", "lorem ipsum é " * 40_000 + "x@y.org"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, call, "en", "s", 26), (3, call, "en", "s", 26), (3, "another text of that id", "en", "s", None), (None, "x", "de", None, 1), (None, "x", "de", None, 1), (5, long, "fr", "t", len(long)), (6, long, "fr", "t", len(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("quality_score", "score", "text_before", "near_node", "several_id", "first_key", "mix_source", "mix_passes", "mix_threshold", "mix_copy", "key", "own", "top", "y", "Near_Node_", "hash", "copy", "shard")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for docs in (df, df.limit(0)):
        empty = docs.count() == 0
        for name, step in p.STAGES:
            docs = stage(step(spark, docs, str(tmp_path)))
            if name != "packing":
                assert docs.columns == df.columns
                got = docs.collect()
                assert all(r[c] == i for r in got for i, c in enumerate(names))
                texts = {r["text"] for r in got}
            if name == "near_duplicates" and not empty:
                assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 2, None: 2, 5: 1} and {call, long, "another text of that id", None, ""} <= texts
            if name == "personal_data" and not empty:
                assert "call <PHONE> now" in texts and "lorem ipsum é " * 40_000 + "<EMAIL>" in texts and {r["n_chars"] for r in got if r["doc_id"] == 5} == {len(long)}
        assert (docs.count() == 0) == empty
