"""Quality rules and mixing against SQL, plain loops and awkward rows."""

from collections import Counter, defaultdict

import pytest

from tests.compare import duck, same
from tidemark.llm import queries as Q
from tidemark.llm.mixing import mix, resample
from tidemark.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracles()))
def test_same_rows_as_sql(spark, name):
    same(Q.queries()[name](spark, SF), duck(SF), Q.oracles()[name])


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    got = quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed")
    assert got.filter("NOT kept").count() == 0 < got.count()


def plain(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows(spark):
    texts = [None, "", " \t\n", "a b", "a b c a b c", "a a a a a", "x\n x\nx\n\nx", "é 𝔘 \x0b#|\x85", "w " * 70_000, "one two three four " * 20, "\n".join(f"line {i} of the text is here" for i in range(30))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS n_words", "3 AS kept")
    got = quality_rules(df).collect()
    assert len(got) == len(rows) and quality_rules(df.limit(0)).count() == 0
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def water(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("counts", [{"a": 400, "b": 300, "c": 350, None: 50}, {"b": 900, "a": 3, "z": 10, "é": 20, "B": 400}, {"only": 30}, {"a": 0, "b": 5}])
def test_targets_and_taken(spark, counts):
    rows = [(i, "word " * (1 + i % 7), s) for s, n in counts.items() for i in range(n)]
    rows = [(j, t, s) for j, (_, t, s) in enumerate(rows)] + [(None, None, s) for s in counts]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS hash", "1 AS weight")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(dict(sizes)) if sum(sizes.values()) else {}
    got = mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 7 for s in counts)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(df).collect()))
    again = Counter(r["doc_id"] for r in resample(df).collect())
    assert again == Counter({r["doc_id"]: 0 for r in got}) + sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())


def test_empty_mix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).count() == 0 and resample(none).count() == 0


def test_copies_of_one_row_are_split(spark):
    rows = [(1, "word " * 100, "a", i) for i in range(100)] + [(i, "word " * 100, "b", i) for i in range(2, 102)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_row int").repartition(7)
    got = mix(df).collect()
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in "ab"}
    assert len(got) == 200 and abs(taken["a"] - 20_000 / 3) <= 50 and abs(taken["b"] - 40_000 / 3) <= 50
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(df).collect()))
    again = resample(df)
    assert again.columns == df.columns
    assert {r["source"]: r["count"] for r in again.groupBy("source").count().collect()} == {s: n // 100 for s, n in taken.items()}
