"""The thin queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=0.85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hnsw import build_index, nearest, usable
    from tidemark.plans.staging import stage

    rows = stage(usable(table(spark, sf_dir, "embeddings")), "ann-rows")
    index, shards = build_index(rows, 5)
    return nearest(rows.filter("vec_id % 50 = 0"), index, shards, 5)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_fm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling import corpus_words, spelling_groups

    return spelling_groups(corpus_words(table(spark, sf_dir, "documents")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.byte_bpe import decode, encode

    file = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode(encode(table(spark, sf_dir, "documents"), *file), *file)
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fill_middle import fill_in_middle, restore

    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op1_sql() -> str:
    from tidemark.llm.quality_rules import RULES, STOP_WORDS

    parts = {
        "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    }
    ratio = lambda m: f"{parts[m][0]}::DOUBLE / nullif({parts[m][1]}, 0)"
    tests = [f"{ratio(m)} >= {lo}" for m, lo, _ in RULES if lo is not None] + [f"{ratio(m)} <= {hi}" for m, _, hi in RULES if hi is not None]
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT r, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM wins) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d
  LEFT JOIN cov ON d.r = cov.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND coalesce({" AND ".join(tests)}, false) AS kept
FROM b"""


#: The targets of mix(): sources held at their cap come first in order of cap / weight.
MIX_SQL = r"""
sized AS (SELECT doc_id, source, len({words})::BIGINT AS size,
    left(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15) AS h FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM src),
lv AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
    FROM wt WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT (SELECT arg_min(level, ratio) FROM lv WHERE level <= ratio) AS final),
tg AS (SELECT source, source_size, least(CASE WHEN final IS NULL OR ratio < final THEN cap ELSE final * weight END, cap) AS target FROM lv, fin),
ps AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS passes FROM tg),
hh AS (SELECT source, h, sum(size)::BIGINT AS tokens, count(*) AS n FROM sized GROUP BY source, h),
cu AS (SELECT hh.*, ps.target - ps.passes * ps.source_size AS rest, sum(tokens) OVER (PARTITION BY hh.source ORDER BY h) AS upto
    FROM hh JOIN ps ON hh.source IS NOT DISTINCT FROM ps.source),
hit AS (SELECT source, h, CASE WHEN upto <= rest THEN n WHEN upto - tokens < rest THEN floor((rest - (upto - tokens)) / (tokens / n) + 0.5) ELSE 0 END AS quota FROM cu),
mixed AS (SELECT s.doc_id, s.source, s.h, s.size, ps.source_size, ps.target,
    least(ps.passes + (row_number() OVER (PARTITION BY s.source, s.h) <= hit.quota)::BIGINT, 3) AS copies
    FROM sized s JOIN ps ON s.source IS NOT DISTINCT FROM ps.source
    JOIN hit ON hit.source IS NOT DISTINCT FROM s.source AND hit.h = s.h)"""


#: All pairs that share a shingle, and everything that each document reaches.
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) AS u(i)
    UNION ALL SELECT doc_id, array_to_string(w, chr(31)) FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


#: Every window of 50 words with the white space between them, and the runs of those that two documents have.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(g[:len(w)]) AS g FROM d),
p AS (SELECT doc_id, i, (sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e, length(w) AS l FROM u),
v AS (SELECT doc_id, i, md5(w[i:i + 49]::VARCHAR || '|' || g[i + 1:i + 49]::VARCHAR) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
o AS (SELECT h, min(doc_id) AS a FROM v GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT v.h, a, min(CASE WHEN v.doc_id <> a THEN v.doc_id END) AS b FROM v JOIN o ON o.h = v.h GROUP BY v.h, a),
x AS (SELECT v.doc_id, v.i, v.doc_id = a AS first, CASE WHEN v.doc_id = a THEN b ELSE a END AS partner, p.e - p.l AS lo, q.e AS hi
  FROM v JOIN s ON s.h = v.h JOIN p ON p.doc_id = v.doc_id AND p.i = v.i JOIN p q ON q.doc_id = v.doc_id AND q.i = v.i + 49),
r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, first ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(partner) OVER k = partner AND lag(i) OVER k + 1 = i AS goes_on FROM x WINDOW k AS (PARTITION BY doc_id, first ORDER BY i)),
m AS (SELECT *, sum((reach IS NULL OR lo > reach)::INT) OVER k AS part, sum((NOT coalesce(goes_on, false))::INT) OVER k AS turn FROM r WINDOW k AS (PARTITION BY doc_id, first ORDER BY i)),
n AS (SELECT doc_id, first, part, min(lo) AS lo, max(hi) AS hi, count(*) + 49 AS n, min(partner) AS partner FROM m GROUP BY doc_id, first, part, turn)
SELECT doc_id, min(lo)::BIGINT AS start, max(hi)::BIGINT AS "end", max(n)::BIGINT AS n_words, min(partner) AS partner_id, first FROM n GROUP BY doc_id, first, part"""


def _op8_sql() -> str:
    """Gaps and matches of each pattern, their running lengths, and the entropy of every window of a candidate."""
    from tidemark.llm.secrets import KINDS, THRESHOLDS, WINDOW

    key = r"""(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?"""
    patterns = (key + "[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]{20,}")
    cut = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for k, p in enumerate(patterns))
    least = f"CASE WHEN regexp_matches(h, '^([0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS['hex']} WHEN regexp_matches(h, '^[A-Za-z0-9]+$') THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['base64']} END"
    # no regular expression of DuckDB goes back to a group: a run of one character has one distinct one
    allowed = " OR ".join(
        ["len(list_distinct(string_split(h, ''))) = 1"] + [f"regexp_matches(h, '{p}')" for p in (
            "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh",
            "^[A-Za-z]+([/_=-]+[A-Za-z]+)*[/_=-]*$", "^[0-9/_=+-]+$")])
    random = f"list_max(list_transform(range(1, length(h) - {WINDOW} + 2), lambda i: list_entropy(string_split(substr(h, i, {WINDOW}), ''))))"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    show = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({cut}),
u AS (SELECT r, kind, unnest(h) AS h, unnest(g[:len(h)]) AS g, unnest(range(len(h))) AS i FROM c),
p AS (SELECT r, kind, h, (sum(length(g) + length(h)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS e FROM u),
q AS (SELECT r, kind, h, e - length(h) AS s, e FROM p WHERE CASE kind WHEN 0 THEN length(regexp_extract(h, '^{key}(.*)$', 1)) >= 6 WHEN 1 THEN length(h) >= 20 WHEN 2 THEN length(h) >= 24 ELSE true END),
b AS (SELECT * FROM q WHERE kind < 3),
x AS (SELECT * FROM q WHERE kind = 3 AND NOT ({allowed}) AND length(regexp_replace(h, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(h, '[^A-Za-z]', '', 'g')) >= 3
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = q.r AND b.s < q.e AND q.s < b.e)),
y AS (SELECT * FROM x WHERE {random} >= {least}),
n AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, {show} AS base FROM b GROUP BY r),
a AS (SELECT r, {show} AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM y) GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN a ON a.r = d.r"""


#: CRC-32 byte by byte, near words by what is left of them without one code point, and the chain of forms.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) for i in range(256)] AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM d WHERE length(run) >= 5 GROUP BY id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295)) AS h FROM g, t),
r AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM w, unnest(range(length(word))) AS u(i)),
p AS (SELECT x.word AS a, y.word AS b FROM v x JOIN v y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
q AS (SELECT a, count(*) AS n_near, arg_min(struct_pack(b := b, n := n), struct_pack(m := -n, b := b)) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * n THEN best END AS top FROM w LEFT JOIN q ON a = word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.top.b FROM c JOIN f ON f.word = c.root WHERE f.top IS NOT NULL),
e AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.top IS NULL)
SELECT f.word, top.b AS form, e.root, n, n_near, top.n AS form_n FROM f JOIN e ON e.word = f.word"""


#: Cuts by substr; the text that is restored is the text itself.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, length(t) AS n, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT for k in range(4)] AS d FROM d),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
    ELSE '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""


def oracles() -> dict[str, str]:
    return {
        "op1_quality_rules": _op1_sql(),
        "op2_mixing": "WITH " + MIX_SQL.format(words=_WORDS, docs="documents") + " SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed",
        "op3_near_dups": OP3_SQL,
        "op4_substring_dedup": OP4_SQL,
        "op8_secrets": _op8_sql(),
        "op11_spelling": OP11_SQL,
        "op13_fill_middle": OP13_SQL,
    }


def queries() -> dict:
    names = [k for k in globals() if k.startswith("op") and k[2].isdigit()]
    return {k: globals()[k] for k in names}
