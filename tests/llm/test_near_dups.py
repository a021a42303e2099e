"""Near-duplicates against all pairs of full sets."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.near_dups import INDEXED, LOSS, max_errors, near_duplicates, position_groups


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, hundredths):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * min(len(a), len(b)) >= hundredths * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= hundredths * (len(a) + len(b) - shared):
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def check(df, k, similarity):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, k, round(100 * similarity))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, k, similarity).collect()}
    assert got == want


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 3, 0.85)


def test_groups_near_the_threshold(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for size in (6, 30, 300):
        for _ in range(12):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(12):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 12))):
                    t[rng.randrange(size)] = rng.choice(vocab)
                rows.append((n, " ".join(t)))
                n += 1
    chain = [rng.choice(vocab) for _ in range(200)]
    for step in range(40):  # each links with the next, the ends share nothing
        rows.append((n, " ".join(chain)))
        n += 1
        for p in range(step * 5, step * 5 + 4):
            chain[p] = rng.choice(vocab)
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(5, None), (6, ""), (7, " \t"), (8, "A b"), (9, "a B"), (3, "a b c"), (2, "A  B\nC"), (None, "a b c"), (11, long), (12, long + " x"), (8, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("x"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 3, 0.85).collect()), key=str)
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[5] == (5, 0, 5, True) and by[7] == (7, 0, 7, True)
    assert by[9] == (9, 1, 8, False) and by[8] == (8, 1, 8, True)
    assert by[3] == (3, 1, 2, False) and by[None] == (None, 1, None, True)
    assert by[12] == (12, 199_999, 11, False)
    assert near_duplicates(df.limit(0), 3, 0.85).count() == 0


def test_pigeonhole():
    """The index bound is that of the similarity, never less, and the groups admit it."""
    for s in (0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95):
        most, groups = max_errors(s), position_groups(s)
        chance = lambda m: sum(math.comb(INDEXED, x) * (1 - s) ** x * s ** (INDEXED - x) for x in range(m + 1, INDEXED + 1))  # noqa: B023, E731
        assert chance(most) <= LOSS * 1.0001 < chance(most - 1)
        assert most <= 2 * len(groups) - 1 and sorted(x for g in groups for x in g) == list(range(INDEXED)) and min(map(len, groups)) >= 3
    with pytest.raises(ValueError):
        position_groups(0.5)


def test_rows_within_the_distance_share_a_tree(spark):
    import numpy as np

    from tidemark.llm import near_dups as nd
    from tidemark.llm.components import components

    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (12, nd.POSITIONS), dtype=np.uint8)
    rows, sigs = [], []
    for i in range(240):
        s = base[i % 12].copy()
        hit = rng.random(nd.POSITIONS) < rng.uniform(0, 0.12)
        s[hit] = rng.integers(0, 256, hit.sum(), dtype=np.uint8)
        sigs.append(s)
        rows.append((i, bytearray(s.tobytes() + s[: nd.INDEXED].tobytes())))
    reps = spark.createDataFrame(rows, "rep long, signature binary")
    groups = position_groups(0.85)
    keys = nd.index_keys(reps, groups)
    keys = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
    near = {(i, j) for i in range(240) for j in range(i + 1, 240) if (sigs[i] != sigs[j]).sum() <= 60 and (sigs[i] != sigs[j])[: nd.INDEXED].sum() < 2 * len(groups)}
    assert len(near) > 1000
    old = nd.BLOCK
    for block in (old, 7):
        nd.BLOCK = block
        got = nd.near_pairs(keys, spark.createDataFrame([], "node long, label long"), reps, 60)
        tree = {r["node"]: r["label"] for r in components(got.filter("b IS NOT NULL")).collect()}
        assert all(tree[i] == tree[j] for i, j in near)
        met = {r["a"] for r in got.filter("b IS NULL").collect()}
        assert met >= {i for p in near for i in p}
        assert all((sigs[r["a"]] != sigs[r["b"]]).sum() <= 60 for r in got.filter("b IS NOT NULL").collect())
    nd.BLOCK = old


def test_small_text_blocks(spark, monkeypatch):
    from tidemark.llm import near_dups as nd

    monkeypatch.setattr(nd, "TEXT_BLOCK", 5)
    monkeypatch.setattr(nd, "BLOCK", 9)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 500)
    test_groups_near_the_threshold(spark)


def test_repeated_ids_with_other_texts(spark):
    from tidemark.llm.near_dups import drop_near_duplicates

    rng = random.Random(8)
    prose = lambda: " ".join(f"w{rng.randrange(50_000)}" for _ in range(120))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(1, a), (2, b), (2, c), (2, c), (3, c + " more"), (4, a), (5, d), (5, d + " end"), (None, a)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = lambda i: {t for x, t in got if x == i}
    assert texts(0) == {a} and texts(1) == {a} and texts(4) == set() and b in texts(2)
    assert len([t for _, t in got if t in (c, c + " more")]) == 1 and len([t for _, t in got if t in (d, d + " end")]) == 1
    assert len(got) == 5


def test_copies_of_one_row_are_compared_once(spark, monkeypatch):
    """Thousands of copies beside documents that come near them without a link: one text of each set is moved."""
    from tidemark.llm import near_dups as nd

    rng = random.Random(12)
    base = [f"w{rng.randrange(50_000)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(3000)]
    for i in range(3000, 3020):
        t = list(base)
        for p in rng.sample(range(300), 9):
            t[p] = f"v{rng.randrange(50_000)}"
        rows.append((i, " ".join(t)))
    dealt, written = [], {}
    blocked, stage = nd._blocked, nd.stage

    def spy(df, key, pivot=False):
        dealt.append((key, df.select("rep").distinct().count(), df.groupBy(key).count().agg(F.max("count")).first()[0]))
        return blocked(df, key, pivot)

    def keep(df, name):
        out = stage(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(nd, "_blocked", spy)
    monkeypatch.setattr(nd, "stage", keep)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 0.85).collect()}
    want = brute([rows[0], *rows[3000:]], 3, 85)
    assert got == {i: want[i][1] if i in want else want[0][1] for i, _ in rows}
    assert all(most <= 21 for _, _, most in dealt) and any(key == "cluster" for key, _, _ in dealt)
    assert written["dup-texts"] <= 21


def test_pivot_blocks_grow_with_the_rows(spark):
    from tidemark.llm import near_dups as nd

    rows = spark.range(5000).select(F.col("id").alias("rep"), F.lit(1).alias("key"), F.lit(50).alias("blocks"))
    assert nd._blocked(rows, "key").count() == 5000 * 50
    sent = nd._blocked(rows, "key", pivot=True)
    assert sent.count() < 5000 * 3
    assert sent.filter("i = j").count() == 5000 and sent.filter("i > 0 AND i <> j").isEmpty()
