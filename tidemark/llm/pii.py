"""Personal data: four fixed patterns, and weak supervision over further candidates.

Base spans (email, ip, card, phone) always stay. Candidates are the base patterns' matches, failing ones included, and
looser shapes (written-out email addresses, national telephone numbers, identity and account numbers). Five labelers
vote on each: the strict pattern, a gazetteer, context for, context against, and the shape of the digits.
Expectation-maximisation over the counts of vote patterns estimates the labelers' reliabilities; its posteriors train a
logistic span classifier, which is applied as a column expression. Counts are taken over all documents, one for each
combination of kind, votes and shape that occurs (at most kinds x 3**5 x SHAPES, whatever the corpus).

The voters see the match by pattern, gazetteer, hint words and repeated digits; the classifier also sees what they do not: how many digits
a span has, how they are parted, the character ahead of it and whether it opens a line (SHAPES values in all).

Positions are code points of the whole text, end exclusive. Null and empty texts have no spans; repeated rows get
equal ones. Every pattern, and the placing and cutting of spans, takes time in proportion to a text's length, however
many spans it has.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_sql import NO_SPANS, apart, let, match_spans, replaced, span_string
from tidemark.plans.staging import stage

KINDS = ("email", "ip", "card", "phone", "ident")
#: The base patterns in Java's syntax. Possessive, and bound to a run's start: the same matches without retries.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
IP_OK = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CARD_GATE = "[0-9](?:[\\x20-]?[0-9]){12}"
LOOSE_EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\\x20?[\\[(]at[\\])]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:\\.|[\\[(]dot[\\])])\\x20?[A-Za-z0-9-]++){1,4}"
LOOSE_EMAIL_GATE = "[\\[(]at[\\])]"
LOOSE_PHONE = "(?<![0-9A-Za-z+.,-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9A-Za-z-])"
IDENT = "(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"

#: Gazetteers and context words of the labelers.
TLDS = "com org net edu gov int io info biz de fr es it uk us eu ch at nl be pl se no dk fi pt ru cn jp br in au ca"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING_CODES = "^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
IBAN_COUNTRIES = "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
CONTEXT_FOR = {
    0: "e-?mail|mail|contact|write to|correo|adresse|kontakt|courriel",
    1: "\\bip\\b|address|host|server|login|client|adresse|direcci",
    2: "card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    3: "phone|tel\\b|tel\\.|call|mobile|cell|fax|telefon|t.l.phone|tel.fono|ruf",
    4: "\\bssn\\b|social security|iban|account|passport|konto|compte|cuenta|ausweis",
}
CONTEXT_AGAINST = "version|\\bv\\.?$|isbn|issn|order|invoice|serial|part no|model|figure|section|chapter|page|build|release|kapitel|seite"
N_VOTES = 5
#: Characters ahead of a span that count as its context; values of each part of its shape.
CONTEXT = 40
_SHAPE = {"size": 3, "parted": 3, "ahead": 3, "line": 2}
SHAPES = math.prod(_SHAPE.values())


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _between(hit: Column, lo: int, hi: int) -> Column:
    return F.length(_digits(hit)).between(lo, hi)


def candidates(text: Column) -> Column:
    """Spans of every candidate; base ones are those that `is_base` accepts."""
    card = lambda hit: _between(hit, 13, 19)
    spans = lambda pattern, kind, keep=None, gate=None: match_spans(text, pattern, kind, keep, gate, CONTEXT)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), spans(EMAIL, 0)).otherwise(F.array().cast(NO_SPANS)),
        spans(IP, 1),
        spans(CARD, 2, card, CARD_GATE),
        spans(PHONE, 3),
        spans(LOOSE_EMAIL, 0, None, LOOSE_EMAIL_GATE),
        spans(LOOSE_PHONE, 3),
        spans(IDENT, 4),
    )


def is_base(s: Column) -> Column:
    hit = s["hit"]
    return (
        F.when(s["kind"] == 0, F.contains(hit, F.lit("@")))
        .when(s["kind"] == 1, F.rlike(hit, F.lit(IP_OK)))
        .when(s["kind"] == 2, F.call_function("luhn_check", _digits(hit)))
        .when(s["kind"] == 3, F.startswith(hit, F.lit("+")) & _between(hit, 9, 15))
        .otherwise(F.lit(False))
    )


def _votes(s: Column) -> Column:
    """The five votes as a base-3 number: 0 against, 1 abstains, 2 for; the first labeler is the lowest digit."""
    kind, hit = s["kind"], s["hit"]
    digits = _digits(hit)
    yes = lambda c: F.when(c, F.lit(2)).otherwise(F.lit(0))
    loose = ((kind == 0) & ~F.contains(hit, F.lit("@"))) | (kind == 4) | ((kind == 3) & ~F.startswith(hit, F.lit("+")))
    strict = F.when(loose, F.lit(1)).otherwise(yes(is_base(s)))
    tld = F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == 0, yes(tld.isin(TLDS.split())))
        .when(kind == 1, yes(F.rlike(hit, F.lit("^(?:[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\\."))))
        .when(kind == 2, yes(F.rlike(digits, F.lit(ISSUERS))))
        .when(kind == 3, F.when(F.startswith(hit, F.lit("+")), yes(F.rlike(hit, F.lit(CALLING_CODES)))).otherwise(yes(F.rlike(digits, F.lit("^[2-9]")))))
        .otherwise(yes(F.rlike(hit, F.lit(IBAN_COUNTRIES)) | F.rlike(hit, F.lit("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))))
    )
    before = F.lower(s["before"])
    hints = F.lit(None).cast("string")
    for k, words in CONTEXT_FOR.items():
        hints = F.when(kind == k, F.lit(words)).otherwise(hints)
    context_for = F.when(F.rlike(before, hints), F.lit(2)).otherwise(F.lit(1))
    context_against = F.when(F.rlike(before, F.lit(CONTEXT_AGAINST)), F.lit(0)).otherwise(F.lit(1))
    dull = F.rlike(digits, F.lit("^([0-9])\\1{6,}$")) | digits.isin("1234567890", "0123456789")
    shape = F.when(kind == 0, F.lit(1)).otherwise(F.when(dull, F.lit(0)).otherwise(F.lit(2)))
    total = F.lit(0)
    for j, v in enumerate((strict, gazetteer, context_for, context_against, shape)):
        total = total + v * (3**j)
    return total


def _shape(s: Column) -> Column:
    """The parts of _SHAPE as one number, the first the lowest: features of a span that no labeler votes on."""
    hit, before = s["hit"], s["before"]
    digits = F.length(_digits(hit))
    marks = F.regexp_replace(hit, "[A-Za-z0-9]", "")
    ahead = F.right(before, F.lit(1))
    parts = (
        F.when(digits < 9, F.lit(0)).when(digits < 13, F.lit(1)).otherwise(F.lit(2)),
        F.when(marks == "", F.lit(0)).when(F.length(F.replace(marks, F.left(marks, F.lit(1)), F.lit(""))) == 0, F.lit(1)).otherwise(F.lit(2)),
        F.when(F.btrim(ahead) == "", F.lit(0)).when(F.rlike(ahead, F.lit("[A-Za-z0-9]")), F.lit(1)).otherwise(F.lit(2)),
        F.when(F.rlike(before, F.lit("(?:^|\n)[\x20\t]*$")), F.lit(1)).otherwise(F.lit(0)),
    )
    total, unit = F.lit(0), 1
    for v, n in zip(parts, _SHAPE.values(), strict=True):
        total, unit = total + v * unit, unit * n
    return total


def _described(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), is_base(s).alias("base"), _votes(s).alias("votes"), _shape(s).alias("shape"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: array of (kind, start, end, base, votes, shape); one scan of the texts."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return t.select("doc_id", F.transform(candidates(F.col("t")), _described).alias("found"))


def vote_counts(found: DataFrame) -> list[tuple[int, int, int, int]]:
    """(kind, votes, shape, count): at most len(KINDS) * 3**N_VOTES * SHAPES rows reach the driver, whatever the corpus."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["kind"], r["votes"], r["shape"], r["n"]) for r in rows.collect())


def _split(votes: int) -> list[int]:
    return [votes // 3**j % 3 for j in range(N_VOTES)]


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 40) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation; labelers vote independently given the truth."""
    given = [[[0.10, 0.25, 0.65], [0.60, 0.30, 0.10]] for _ in range(N_VOTES)]  # [labeler][truth: yes, no][vote]
    prior = {k: 0.5 for k in range(len(KINDS))}
    posterior: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for k, v, _n in counts:
            a, b = prior[k], 1 - prior[k]
            for j, vote in enumerate(_split(v)):
                a, b = a * given[j][0][vote], b * given[j][1][vote]
            posterior[k, v] = a / (a + b) if a + b else 0.5
        tally = [[[1.0, 2.0, 6.0], [6.0, 3.0, 1.0]] for _ in range(N_VOTES)]  # each labeler is better than chance a priori
        yes, total = {k: 1.0 for k in prior}, {k: 2.0 for k in prior}
        for k, v, n in counts:
            p = posterior[k, v]
            yes[k], total[k] = yes[k] + n * p, total[k] + n
            for j, vote in enumerate(_split(v)):
                tally[j][0][vote] += n * p
                tally[j][1][vote] += n * (1 - p)
        prior = {k: yes[k] / total[k] for k in prior}
        given = [[[x / sum(row) for x in row] for row in one] for one in tally]
    return posterior


#: Places of the classifier's weights: the bias, each kind, each labeler's votes, each kind's values of each part of a shape.
_VOTE_AT = 1 + len(KINDS)
_SHAPE_AT = _VOTE_AT + 3 * N_VOTES
_PER_KIND = sum(_SHAPE.values())


def _features(kind: int, votes: int, shape: int) -> list[int]:
    """Indices of the features that are on."""
    on = [0, 1 + kind] + [_VOTE_AT + 3 * j + v for j, v in enumerate(_split(votes))]
    at = _SHAPE_AT + kind * _PER_KIND
    for n in _SHAPE.values():
        on.append(at + shape % n)
        at, shape = at + n, shape // n
    return on


def train(counts: list[tuple[int, int, int, int]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, a combination weighing log(1 + its count)."""
    patterns: dict[tuple[int, int], int] = {}
    for k, v, _, n in counts:
        patterns[k, v] = patterns.get((k, v), 0) + n
    posterior = reliabilities([(k, v, n) for (k, v), n in sorted(patterns.items())])
    on = np.array([_features(k, v, s) for k, v, s, _ in counts], int).reshape(-1, 2 + N_VOTES + len(_SHAPE))
    p = np.array([posterior[k, v] for k, v, _, _ in counts])
    weight = np.log1p(np.array([n for *_, n in counts], float))
    w = np.zeros(_SHAPE_AT + len(KINDS) * _PER_KIND)
    for _ in range(steps if len(counts) else 0):
        err = weight / weight.sum() * (1 / (1 + np.exp(-np.clip(w[on].sum(1), -30, 30))) - p)
        w -= rate * (np.bincount(on.ravel(), np.repeat(err, on.shape[1]), len(w)) + 1e-3 * w)
    return w.tolist()


def score(s: Column, w: list[float]) -> Column:
    """The classifier's log-odds of a span (kind, votes, shape) as a column."""
    pick = lambda lo, n, i: F.get(F.array(*[F.lit(x) for x in w[lo : lo + n]]), i)
    z = F.lit(w[0]) + pick(1, len(KINDS), s["kind"])
    for j in range(N_VOTES):
        z = z + pick(_VOTE_AT + 3 * j, 3, F.floor(s["votes"] / 3**j).cast("int") % 3)
    at, unit = _SHAPE_AT, 1
    for n in _SHAPE.values():
        values = [w[at + k * _PER_KIND + v] for k in range(len(KINDS)) for v in range(n)]
        z = z + F.get(F.array(*[F.lit(x) for x in values]), s["kind"] * n + F.floor(s["shape"] / unit).cast("int") % n)
        at, unit = at + n, unit * n
    return z


def decide(found: DataFrame, w: list[float]) -> DataFrame:
    """doc_id, base, spans: the base spans, and with them the candidates that the classifier adds apart from these."""
    base = F.filter("found", lambda s: s["base"])
    extra = F.filter("found", lambda s: ~s["base"] & (score(s, w) > 0))
    t = found.select("doc_id", base.alias("base"), extra.alias("extra"))
    every = F.when(F.size("extra") == 0, F.col("base")).otherwise(F.concat("base", apart(F.col("extra"), F.col("base"))))
    return t.select("doc_id", "base", every.alias("spans"))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs`."""
    found = stage(find(docs, id_col, text_col), "pii-found")
    decided = decide(found, train(vote_counts(found)))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return decided.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(span_string(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"),
        span_string(F.col("spans"), KINDS, True).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets; other columns as they were.

    Spans that overlap are replaced as one, under the kind of the first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found_in = F.transform(candidates(text), _described)
    w = train(vote_counts(docs.select(found_in.alias("found"))))
    keep = lambda s: s["base"] | (score(s, w) > 0)
    spans = F.array_sort(F.transform(F.filter(found_in, keep), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    clean = let(spans, lambda x: F.when(F.size(x) > 0, replaced(text, x, lambda s: F.get(names, s["kind"]))).otherwise(F.col(text_col)))
    return docs.withColumn(text_col, clean)
