"""Fill-in-the-middle texts, by DuckDB inside mapInArrow.

Each Arrow batch is registered with a DuckDB connection of the task and rewritten by one SQL statement, so no Python code sees
a row. A text is cut into blocks of BLOCK code points by regexp_extract_all; a cut joins the whole blocks before it and the
units of the block that it falls in (list_slice and array_to_string), so a long text needs one list entry a block, not one
a character. Batches are handed on in parts of about _BATCH_BYTES of text; a longer text stands alone.

All draws come from the SHA-256 of ``<seed>:<doc_id>``, so reruns agree and rows of one id share their draws. A null id draws
as an empty one. A null text is an empty one, and stays plain, as does a text that holds one of the marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Marks ahead of the prefix, the suffix and the middle. No end of one is the beginning of another, so outputs part unambiguously.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 64
_BATCH_BYTES, _MEMORY = 1 << 20, "512MB"


def _cut_sql(seed: int, rate: int, swapped: int) -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT"
    # the units and the whole blocks on either side of a cut, as SQL on the list of blocks `b`
    units = lambda at, lo, hi: f"array_to_string(list_slice(regexp_extract_all(coalesce(b[{at} // {BLOCK} + 1], ''), '(?s).'), {lo}, {hi}), '')"
    blocks = lambda lo, hi: f"array_to_string(list_slice(b, {lo}, {hi}), '')"
    before = lambda at: units(at, 1, f"{at} % {BLOCK}")
    behind = lambda at: units(at, f"{at} % {BLOCK} + 1", BLOCK)
    head = f"{blocks(1, f'lo // {BLOCK}')} || {before('lo')}"
    apart = f"{behind('lo')} || {blocks(f'lo // {BLOCK} + 2', f'hi // {BLOCK}')} || {before('hi')}"
    between = f"CASE WHEN lo // {BLOCK} = hi // {BLOCK} THEN {units('lo', f'lo % {BLOCK} + 1', f'hi % {BLOCK}')} ELSE {apart} END"
    tail = f"{behind('hi')} || {blocks(f'hi // {BLOCK} + 2', 'len(b)')}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM rows),
b AS (SELECT *, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') AS b FROM d),
n AS (SELECT *, CASE WHEN len(b) = 0 THEN 0 ELSE (len(b) - 1) * {BLOCK} + len(regexp_extract_all(b[len(b)], '(?s).')) END AS n FROM b),
c AS (SELECT *, ({draw(0)} % (n + 1)::UBIGINT)::BIGINT AS x, ({draw(1)} % (n + 1)::UBIGINT)::BIGINT AS y,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(2)} % 100 >= {rate} THEN 'plain'
    WHEN {draw(3)} % 100 < {swapped} THEN 'spm' ELSE 'psm' END AS form FROM n),
e AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi FROM c),
p AS (SELECT *, {head} AS pre, {between} AS mid, {tail} AS suf FROM e WHERE form <> 'plain' UNION ALL SELECT *, '', '', '' FROM e WHERE form = 'plain')
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output
FROM p"""


def _part_sql() -> str:
    first = lambda mark: f"strpos(output, '{mark}')"
    between = lambda a, b: f"substr(output, {first(a)} + {len(a)}, {first(b)} - {first(a)} - {len(a)})"
    rest = f"substr(output, {first(MIDDLE)} + {len(MIDDLE)})"
    return f"""
SELECT *, CASE form WHEN 'psm' THEN {between(PREFIX, SUFFIX)} || {rest} || {between(SUFFIX, MIDDLE)}
  WHEN 'spm' THEN {between(PREFIX, MIDDLE)} || {rest} || {between(SUFFIX, PREFIX)} ELSE coalesce(output, '') END AS restored
FROM rows"""


def _in_duckdb(df: DataFrame, sql: str, sized_by: str, schema: T.StructType) -> DataFrame:
    """The rows of `sql` over the batches of `df`, each registered as the table `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": ""})
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(sized_by)), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(size)))
            at = 0
            while at < batch.num_rows:
                end = max(int(np.searchsorted(upto, upto[at] + _BATCH_BYTES, "right")) - 1, at + 1)
                con.register("rows", pa.Table.from_batches([batch.slice(at, end - at)]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("rows")
                at = end
        con.close()

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, swapped: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of `docs` (doc_id, text).

    `rate` percent of the texts are cut in three, `swapped` percent of those with the suffix ahead of the prefix.
    """
    docs = docs.select("doc_id", "text")
    fields = [docs.schema["doc_id"]] + [T.StructField(c, t) for c, t in (
        ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))]
    return _in_duckdb(docs, _cut_sql(seed, rate, swapped), "text", T.StructType(fields))


def restore(rows: DataFrame) -> DataFrame:
    """The columns of `rows` (with form and output) and `restored`, the text that the output was made of. A null output restores to an empty text."""
    assert "restored" not in {c.lower() for c in rows.columns}, "rows already have a column 'restored'"
    return _in_duckdb(rows, _part_sql(), "output", T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))
