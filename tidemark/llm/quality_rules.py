"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Null and blank texts have no words and fail the base rule.
Repeated rows get one verdict each, alike. The input's own columns may bear any name: only the two that are asked
for are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_sql import SPACES, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das der die ein eine im in ist mit nicht sich und von zu den des dem für "
    "au aux dans de des du elle en est et la le les par pas pour qui sur un une que ou "
    "al como con del el es la las lo los no para por se su una y"
)
#: Metric, least and greatest value allowed (None: unbounded). Ratios are to words, to characters of words or to lines.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.50),
    ("repeat_ratio", None, 0.50),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeated(hashes: Column) -> Column:
    """Words covered by three-word windows whose hash occurs twice or more, from the hashes in text order."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1

        def twice(p: Column, i: Column) -> Column:
            return ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == p["h"]))

        marked = F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(marked, zero, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total")), lambda a: a["total"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def _metrics(w: Column, t: Column) -> Column:
    """The counts that the rules need, of the words w of the text t."""
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    stop = sorted(set(STOP_WORDS.split()))
    return let(
        lines,
        lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(hashes, _repeated).alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda y: y.isin(stop))).cast("long").alias("n_stop_words"),
        ),
    )


def _verdict(m: Column, rules) -> Column:
    """The counts with base_failed and kept. A document without words fails the base rule and is not kept."""
    per = lambda a, b: F.try_divide(m[a].cast("double"), m[b].cast("double"))
    ratio = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }
    tests = [ratio[r] >= F.lit(lo) for r, lo, _ in rules if lo is not None] + [ratio[r] <= F.lit(hi) for r, _, hi in rules if hi is not None]
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    passed = F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))
    return F.struct(*[m[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & passed).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept. One expression yields them all, and binds the words once a row, so a
    filter on the verdict that Spark moves below the projection scans a text once more, not once a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    verdict = let(text, lambda t: let(words(t), lambda w: let(_metrics(w, t), lambda m: _verdict(m, rules))))
    return docs.select(F.col(id_col).alias("doc_id"), verdict.alias("q")).select("doc_id", "q.*")
