"""Secret scan: three fixed patterns, and sliding-window entropy over strings that look like keys.

Positions are code points of the whole text, end exclusive. Null and empty texts have no spans. Repeated rows are
scanned alike. Very long texts, very long strings and texts with very many hits cost time in proportion to their length:
no repeated group backtracks (Java does that by recursion), and the window keeps its counts from step to step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_sql import apart, let, match_spans, span_string

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns, in Java's syntax.
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = _KEYWORD + "[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = "^" + _KEYWORD + "([A-Za-z0-9+/_.=-]+)$"
#: A run of fewer characters holds no longer one, so these lengths are part of the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"

WINDOW = 20
#: Symbols whose counts are kept apart, bits a count, counts a number.
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BITS, _PACK = 5, 12
#: Least entropy in bits of some window, by the characters that the candidate is made of.
THRESHOLDS = {"hex": 3.0, "alnum": 3.4, "base64": 3.7}
#: Candidates never reported: UUIDs, placeholders, runs of one character, dashed or underscored words, paths of words.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh",
    "^(.)\\1+$",
    "^[A-Za-z]++(?:[/_=-]++[A-Za-z]++)*+[/_=-]*+$",
    "^[0-9/_=+-]+$",
)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy of `window` characters on end, from counts updated as the window moves.

    The state is the counts, _PACK of _BITS bits in a number, and the sum of c * log2(c) over them; a step changes the count of
    the character that enters and of the one that leaves. Characters outside _SYMBOLS count as one more symbol.
    """
    assert window < 1 << _BITS
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    numbers = -(-(len(_SYMBOLS) + 1) // _PACK)
    place = lambda ch: (F.instr(F.lit(_SYMBOLS), ch) + len(_SYMBOLS)) % (len(_SYMBOLS) + 1)

    def at(ch: Column) -> Column:
        """Number, shift and unit of a character's count."""
        return let(place(ch), lambda p: F.struct(F.floor(p / _PACK).cast("int").alias("n"), (p % _PACK * _BITS).alias("shift"), _shift("shiftleft", F.lit(1).cast("long"), p % _PACK * _BITS).alias("unit")))

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - window)
            held = lambda x: _shift("shiftright", F.get(acc["counts"], x["n"]), x["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
            same = (new["n"] == old["n"]) & (new["unit"] == old["unit"])
            loss = F.when(old.isNull() | same, F.lit(0.0)).otherwise(F.get(terms, held(old) - 1) - F.get(terms, held(old)))
            gain = F.when(same, F.lit(0.0)).otherwise(F.get(terms, held(new) + 1) - F.get(terms, held(new)))
            change = lambda x, j: F.when(x["n"] == j, x["unit"]).otherwise(F.lit(0).cast("long"))
            counts = F.transform(acc["counts"], lambda c, j: c + change(new, j) - F.when(old.isNull(), F.lit(0).cast("long")).otherwise(change(old, j)))
            total = acc["sum"] + loss + gain
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), F.lit(numbers)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["best"])

    return F.when(F.length(s) < window, F.lit(0.0)).otherwise(let(F.transform(F.split(s, ""), at), scan))


def _suspicious(hit: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.rlike(hit, F.lit(pattern))
    limit = (
        F.when(F.rlike(hit, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), F.lit(THRESHOLDS["hex"]))
        .when(F.rlike(hit, F.lit("^[A-Za-z0-9]+$")), F.lit(THRESHOLDS["alnum"]))
        .otherwise(F.lit(THRESHOLDS["base64"]))
    )
    mixed = F.rlike(hit, F.lit("[0-9].*[0-9].*[0-9]")) & F.rlike(hit, F.lit("[A-Za-z].*[A-Za-z].*[A-Za-z]"))
    return F.when(~allowed & mixed, max_window_entropy(hit) >= limit).otherwise(F.lit(False))


def secret_spans(text: Column) -> tuple[Column, Column]:
    """(base spans, entropy candidates that pass) of a text column that is never null."""
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN_VALUE, 1)) >= 6
    base = F.concat(match_spans(text, ASSIGN, 0, value), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))
    return base, match_spans(text, CANDIDATE, 3, _suspicious)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. An entropy span that meets a base span is left out."""
    base, extra = secret_spans(F.col("t"))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = found.select("doc_id", base.alias("base"), extra.alias("extra"))
    every = F.when(F.size("extra") == 0, F.col("base")).otherwise(F.concat("base", apart(F.col("extra"), F.col("base"))))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_string(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
        span_string(every, KINDS, False).alias("spans"),
    )

