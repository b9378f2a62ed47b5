"""Fill-in-the-middle documents by DuckDB SQL on Arrow batches.

A text is cut into lines, two places between lines are drawn from a hash of the
document's id, and the parts are put in another order behind sentinels. Every
batch that Spark hands to a task is registered with an in-memory DuckDB, whose
SQL does all work on it; no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that DuckDB gets at once; a longer text comes alone.
SLICE_BYTES = 8 << 20
#: Before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def _sql(seed: int, fim_percent: int, spm_percent: int) -> str:
    group = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    part = lambda a, b: f"array_to_string(list_slice(units, {a}, {b}), '')"
    # A sentinel begins with a character that it doesn't hold again, so the text's own characters beside it can't make another one.
    cut = f"string_split_regex(output, '{PREFIX}|{SUFFIX}|{MIDDLE}')"
    return f"""
        WITH lines AS (
            SELECT id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
            FROM batch),
        drawn AS (
            SELECT *, len(units) AS n, {group(0)} % (len(units) + 1) AS x, {group(1)} % (len(units) + 1) AS y,
                   CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {group(2)} % 100 >= {fim_percent} THEN 'plain'
                        WHEN {group(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
            FROM lines),
        parts AS (
            SELECT id, text, n, form, {part("1", "least(x, y)")} AS prefix, {part("least(x, y) + 1", "greatest(x, y)")} AS middle, {part("greatest(x, y) + 1", "n")} AS suffix
            FROM drawn),
        written AS (
            SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                   CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                             WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output
            FROM parts),
        cut AS (SELECT *, CASE WHEN form <> 'plain' THEN {cut} END AS piece FROM written)
        SELECT id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, output, sha256(output) AS output_sha256,
               sha256(CASE form WHEN 'psm' THEN piece[2] || piece[4] || piece[3] WHEN 'spm' THEN piece[3] || piece[4] || piece[2] ELSE output END) AS restored_sha256
        FROM cut
    """


@lru_cache(1)
def _engine():  # noqa: ANN202
    """A DuckDB of this worker: one thread, memory bounded, nothing on disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": True})


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose second column has about `most` bytes at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: <id_col>, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    n counts the lines, which keep their line feed. form is plain (output is the
    text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part
    behind its sentinel. restored_sha256 is the digest of the text as rebuilt from
    output and form alone; for each row it equals the digest of the text.

    Whole texts are read, in slices of bounded bytes, without a shuffle. A null
    text counts as empty and is plain, with no line; so is a text that holds a
    sentinel. What is drawn depends on the id alone: rows that repeat an id draw
    alike, and a null id counts as the empty text. An empty table gives no row;
    other columns are ignored, whatever their names.
    """
    sql = _sql(seed, fim_percent, spm_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()
        for b in batches:
            for part in slices(b, slice_bytes):
                engine.register("batch", pa.Table.from_batches([part]))
                out = engine.sql(sql).to_arrow_table()
                engine.unregister("batch")
                yield from out.cast(pa.schema([pa.field("id", b.column(0).type), *list(out.schema)[1:]])).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, {_SCHEMA}")
    return rows.withColumnRenamed("id", id_col)
