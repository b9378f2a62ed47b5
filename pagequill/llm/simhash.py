"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.common import join_by_group, mark_possible, materialize, split_members
from pagequill.operators.components import connected_components

CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: bit set if set in over half of the shingle hashes.

    Words are runs of non-(ASCII) space of the text with A-Z lower-cased; a text
    of fewer words is one shingle, one of none (or null) has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, line = len(words), b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        hashes = digest(line, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
        hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), CHUNK):
        ones += np.unpackbits(rows[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row, whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def linked_fingerprints(groups: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst): all pairs of distinct fingerprints that differ in `distance` bits or fewer (3 at most).

    Two fingerprints within 3 bits agree in one 32-bit half up to one bit. Each
    fingerprint stands once in a table for each half; it looks its halves up
    as they are, and with each set bit cleared (of two halves that differ in one
    bit, one has it set), so the radius-1 ball costs 1 + popcount look-ups rather
    than 33. The complete distance is a condition of the join itself, so that
    only true links leave it.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with radius 1 find distances up to 3 only")
    mask = 0xFFFFFFFF
    halves = F.array(F.col("fp").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 33)))
    table = groups.select("fp", F.explode(halves).alias("key"))
    flips = F.expr("filter(transform(sequence(0, 31), i -> if(getbit(key, i) = 1, key - shiftleft(1L, i), -1L)), x -> x >= 0)")
    looks = table.select("fp", F.col("key"), F.lit(False).alias("flip")).unionByName(table.select("fp", F.explode(flips).alias("key"), F.lit(True).alias("flip")))
    # Most cleared bits lead to no fingerprint at all: only keys that the table may hold are shuffled.
    looks = mark_possible(looks, F.col("key"), table.select(F.col("key").alias("held")), "held", "meets").where("meets").drop("meets")
    a, b = looks.alias("a"), table.select(F.col("fp").alias("other"), "key").alias("b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & near & (F.col("flip") | (F.col("fp") < F.col("other"))))
    return pairs.select(F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """(<id_col>, fingerprint, component_id) for every row.

    Rows whose fingerprints differ in `distance` bits or fewer are linked;
    component_id is the smallest id that links reach, the row's own included
    (null only where all ids of the component are null). Equal fingerprints,
    also those of empty and null texts, are one group, kept as one row in the
    search; a group of any size adds one row to it. Repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    total = fps.count()
    groups = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprint-groups")
    edges = linked_fingerprints(groups, distance)
    members = materialize(connected_components(edges), "fingerprint-components")
    least = members.join(groups, members.node == groups.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    of = members.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    classes = groups.join(of, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    classes = materialize(classes, "fingerprint-classes")
    out = join_by_group(fps, classes, "fp", "n", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row of docs for each component, the one of the smallest id; all columns as they were.

    Of rows that repeat that id one stays. Rows without an id can't be told
    apart: each stays if no row of its own component has an id.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    found = simhash_groups(docs.select(key.alias("id"), text.alias("text")), "id", "text", **settings)
    found = materialize(found, "simhash-groups")
    ids = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("component_id")).alias("stay"))
    ids = materialize(ids.where("n > 1 or stay = 0").select(F.col("id").alias("known"), "n"), "simhash-ids")

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t, settings.get('shingle', 3), settings.get('seed', 42)) & (1 << 64) - 1:016x}" for t in texts], dtype=object)

    # All of a row is one column here, so that no name of its own clashes.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), text.alias("text"))
    out = split_members(rows, "id", ids, "known")[1].select("row")
    # Ids of several rows, and rows without an id, go by their own fingerprints.
    shared = ids.where("n > 1").select("known")
    many = mark_possible(rows.where("id is not null"), F.col("id"), shared, "known", "open").where("open").join(shared, F.col("id") == F.col("known"), "left_semi")
    roots = found.where("id = component_id").select(F.col("id").alias("root"), F.col("fingerprint").alias("of")).join(shared, F.col("root") == F.col("known"), "left_semi").distinct()
    many = many.join(roots, (F.col("id") == F.col("root")) & (hashed("text") == F.col("of")), "left_semi").dropDuplicates(["id"])
    alone = found.where("id is null and component_id is null").select(F.col("fingerprint").alias("of")).distinct()
    nameless = rows.where("id is null").join(alone, hashed("text") == F.col("of"), "left_semi")
    out = out.unionByName(many.select("row")).unionByName(nameless.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
