"""Where iterative operators keep what they have computed so far."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that setting is missing a single process (master local, as in tests)
    gets a temporary folder; a cluster has no folder to fall back to, and a
    RuntimeError is raised.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="pagequill-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagequill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor costs nothing that is already written, and no later stage
    recomputes what led to it; so the shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Left join rows to one-row-per-key groups without a hot shuffle key.

    Fewer than `share` keys can hold more than total/share rows each, so those
    groups are a broadcast of proven size; all other keys are small enough for
    a plain shuffled join. No key column may be null.
    """
    limit = max(total // share, 1)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    a = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), key)
    b = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, key, "left")
    return a.unionByName(b)


#: Words of 64 bits in a mark table: at most so many rows of an int and a long (16 MB of values) are broadcast.
MARK_WORDS = 1 << 20


def mark_possible(rows: DataFrame, key: Column, members: DataFrame, member: str, name: str) -> DataFrame:
    """rows with a boolean <name>: true for every row whose key is in members.<member>, rarely for others, null keys included.

    One bit of a table of fixed size stands for each member's hash, so what is
    broadcast has a bound; with far more members than bits all rows are marked.
    An exact join of the marked rows is to follow.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_WORDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(c), 32).bitwiseAND(F.lit(63)).cast("int"))
    bits = members.select(word(F.col(member)).alias("__word"), bit(F.col(member)).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = rows.withColumn("__at", word(key)).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    return found.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("__at", "__word", "__bits")


def without(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """rows whose key (not null) is in no row of members.<key>: only what a mark table leaves open is joined."""
    marked = mark_possible(rows, F.col(key), members, key, "__maybe")
    left = marked.where("__maybe").drop("__maybe").join(members.select(key), key, "left_anti")
    return marked.where("not __maybe").drop("__maybe").unionByName(left)


def numbered(df: DataFrame, by: list[str], name: str, start: int = 0, to: str = "ord") -> DataFrame:
    """df, written, with a column <to> that numbers its rows in the order of <by>, without gaps from start on.

    Rows are sorted by ranges; the numbers of rows of the ranges before are added.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 14)
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    rows = materialize(rows.withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = sorted((r["__range"], r["count"]) for r in rows.groupBy("__range").count().collect())
    offsets = []
    for k, n in counts:
        offsets.append((k, start))
        start += n
    first = df.sparkSession.createDataFrame(offsets, "__range long, __first long")
    return rows.join(F.broadcast(first), "__range").withColumn(to, F.col("__first") + F.col("__at")).drop("__range", "__at", "__first")
