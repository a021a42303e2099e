"""Near words against all pairs, counts and forms against plain loops, groups beyond the bound included."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.compare import duck, same
from tidemark.llm import spelling
from tidemark.llm.queries import OP11_SQL, op11_spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    near_of = {w: [o for o in n if o != w and near(w, o)] for w in n}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near_of[w]), n.get(form[w])) for w in n}


def made(seed, many, letters, lengths=(5, 6, 7, 8, 9)):
    rng = random.Random(seed)
    out = {}
    while len(out) < many:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        out[w] = rng.choice((3, 4, 6, 9, 20, 50))
        i = rng.randrange(len(w))
        for v in (w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]):
            if len(v) >= 5 and rng.random() < 0.5:
                out[v] = rng.choice((3, 5, 12, 100))
    return out


@pytest.mark.parametrize("letters,many,group", [("ab", 500, 32), ("ab", 500, 1), ("abc", 900, 4), ("aé", 300, 2), ("abcdefghéÿà", 1200, 32), ("a", 12, 32)])
def test_all_pairs(spark, letters, many, group):
    n = made(7, many, letters) if len(letters) > 1 else {"a" * k: 3**k for k in range(5, many)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.spelling_groups(words, group=group).collect()
    assert len(got) == len(n) and set(map(tuple, got)) == plain_groups(n)


def test_a_large_group_is_split(spark):
    n = {f"zq{a}{b}{c}{d}xx": 3 + (ord(a) + ord(b)) % 9 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdef"}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(words).collect()}
    assert len(pairs) == len(n) * (7 + 7 + 7 + 5) // 2


def test_long_words_and_odd_rows(spark):
    long = "abcdefghij" * 20_000
    rows = [(long, 9), (long[:77_777] + "x" + long[77_778:], 3), (long + "y", 4), ("short", 3), ("shorts", 7), ("tiny", 90), (None, 3)]
    got = {(r.a[-3:], r.b[-3:]) for r in spelling.near_pairs(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {tuple(sorted(p)) for p in got} == {("hij", "hij"), ("hij", "ijy"), ("ort", "rts")}
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(Exception, match="below 256"):
        spelling.near_pairs(spark.createDataFrame([("wörterbucł", 3)], "word string, n long")).count()


def test_words_of_a_corpus(spark):
    rng = random.Random(3)
    vocabulary = ["Straße", "ÉTUDE", "color", "colour", "whale", "whaleÿ", "kurz", "word×s", "A" * 30]
    rows = [(i % 40 if i % 7 else None, " ".join(rng.choice(vocabulary) for _ in range(60)) if i % 11 else None) for i in range(300)]
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {(w, c) for w, c in count.items() if len(w) >= 5 and c >= 3}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    assert {tuple(r) for r in spelling.corpus_words(docs).collect()} == want


def test_query(spark, sf):
    same(op11_spelling(spark, sf), duck(sf), OP11_SQL)
