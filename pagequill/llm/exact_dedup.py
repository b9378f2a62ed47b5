"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text
(A-Z lower-cased, nothing else). New data come in slices of falling ids; each is
grouped by digest with map-side combine, anti-joined to the index by sort-merge,
and its new digests are appended. So it is the index that says which row stays.

A stopped batch can be run again. Each row of the index is right by itself: the
first slice that holds a digest holds its largest id, wherever slices are cut, so
a digest that is there needs nothing more, and one that is missing is added. What
tells rows of one id apart is chosen by each run from its own rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequill.llm.common import ascii_lower, discard, join_by_group, materialize

#: Slices of a batch of numeric ids; other ids come in one.
SLICES = 3
#: Files a bucket at which a batch compacts the index before it starts.
MOST_FILES = 8


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by digest; batch says which batch brought the digest."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"exact_dedup_index_{uuid.uuid4().hex}"

    def _has(self, suffix: str = "") -> bool:
        return self.spark.catalog.tableExists(self.table + suffix)

    def recover(self) -> None:
        """Finish or undo a compaction that was stopped: the table of the name is whole, else the new one, else the old one."""
        if not self._has():
            for left in ("_new", "_old"):
                if self._has(left):
                    self.spark.sql(f"ALTER TABLE `{self.table}{left}` RENAME TO `{self.table}`")
                    break
        for left in ("_new", "_old"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.table}{left}`")

    def read(self, id_type: str = "bigint") -> DataFrame:
        """The index; an empty one is made where there is none."""
        self.recover()
        if not self._has():
            self._write(self.spark.createDataFrame([], f"digest string, keep_id {id_type}, batch string"), self.table, "append")
        return self.spark.table(self.table)

    def append(self, rows: DataFrame, batch: str) -> None:
        self._write(rows.select("digest", "keep_id", F.lit(batch).alias("batch")), self.table, "append")

    def compact(self, most_files: int = 1) -> bool:
        """One sorted file a bucket again, if buckets have more than most_files on average. A stop at any place loses nothing (see recover)."""
        if len(self.read().inputFiles()) <= most_files * self.buckets:
            return False
        # Dealt by the bucket's number: a plain repartition by digest would be planned away, as the table has that partitioning, but read without it.
        self._write(self.read(), f"{self.table}_new", "overwrite", F.pmod(F.hash("digest"), F.lit(self.buckets)))
        self.spark.sql(f"ALTER TABLE `{self.table}` RENAME TO `{self.table}_old`")
        self.recover()
        return True

    def drop(self) -> None:
        for suffix in ("", "_new", "_old"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.table}{suffix}`")

    def _write(self, rows: DataFrame, table: str, mode: str, key: Column | str = "digest") -> None:
        rows.repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).saveAsTable(table)


def _slices(rows: DataFrame, slices: int) -> list[DataFrame]:
    """rows in parts of about equal size and falling ids; null ids come last. Results don't depend on where the cuts are."""
    cuts: list = []
    if slices > 1 and isinstance(rows.schema["id"].dataType, T.NumericType):
        found = rows.agg(F.percentile_approx("id", [k / slices for k in range(1, slices)], 1000).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found or []))
    above, out = F.lit(True), []
    for cut in reversed(cuts):
        out.append(rows.where(above & (F.col("id") >= F.lit(cut))))
        above = F.col("id").isNull() | (F.col("id") < F.lit(cut))
    return [*out, rows.where(above)]


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, slices: int = SLICES) -> DataFrame:
    """Deduplicate a batch against the index and append what is new.

    Returns one row per input row: <id_col>, keep_id, group_size (rows of this
    batch with the text), kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Of equal
    texts in the batch the row with the largest id is kept; null ids are the
    smallest, and of rows that tie on the id one is kept. A text that another
    batch has brought to the index keeps no row of this one: keep_id is then the
    id that the index has. A batch that is run again under the same name (a
    retried job; the same rows, however they are partitioned, wherever it was
    stopped) has the same result, and adds only what is missing. An empty batch
    gives an empty result. Other columns are ignored.
    """
    batch = batch or uuid.uuid4().hex
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    total = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    index.read(kind)
    index.compact(MOST_FILES)
    for part in _slices(rows, slices):
        # A group of any size is combined to one row in each task.
        tops = part.groupBy("digest").agg(F.max("id").alias("keep_id"))
        new = materialize(tops.hint("merge").join(index.read(kind).select("digest"), "digest", "left_anti"), "digests-new")
        index.append(new, batch)
        discard(new)
    # Of the rows that tie on the largest id, the one that this run has numbered highest or lowest is as good as another.
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("top_row"))
    mine = F.when(F.col("batch") == batch, F.col("top_row")).alias("keep_row")
    groups = materialize(sizes.hint("merge").join(index.read(kind), "digest").select("digest", "group_size", "keep_id", mine), "digest-groups")
    out = join_by_group(rows, groups, "digest", "group_size", total)
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
