"""Exact top-k by inner product: Fagin's threshold algorithm on blocks of sorted per-dimension lists.

Vectors become integers; equal ones are one entry with its smallest ids. Entries
are dealt to blocks, and for every block the order of its entries by each
dimension is stored: the sorted lists. A query descends them in rounds, from the
top where its weight is positive, from the bottom where it is negative, and
scores every entry it meets for the first time in full. What it has not met
scores at most the sum of the weighted values where the lists stand; once that
bound is under the k-th result, the block is left. Results are carried from block
to block within a task, so later blocks are left sooner, many at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequill.llm.common import discard, materialize, new_path

#: Components in a block (rows times dimensions), and in a block of queries, which is broadcast (8 bytes each).
BLOCK_VALUES, QUERY_VALUES = 1 << 19, 1 << 19
FIRST_DEPTH = 16
#: Components and scores must stay under these, or an error is raised: sums of integers are then exact.
_LIMIT, _EXACT = float(1 << 62), float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components; an empty vector is usable."""
    return vector.isNotNull() & F.forall(F.coalesce(vector, F.array().cast("array<double>")), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def quantized(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of usable vectors with an id, as little-endian integers of the least width that holds the row."""
    kind = embeddings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False) * float(scale))
            if flat.size and np.abs(flat).max() >= _EXACT:
                raise ValueError("a component is too large to be an exact integer")
            ends = np.concatenate(([0], np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(flat[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "v"])

    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).mapInArrow(run, f"id {kind}, v binary")


_WIDTHS = ("<i2", "<i4", "<i8")


def _packed(x: np.ndarray) -> bytes:
    most = np.abs(x).max() if x.size else 0
    k = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([k]) + x.astype(_WIDTHS[k]).tobytes()


def _unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, _WIDTHS[v[0]], offset=1)


def _matrix(vectors: list[bytes], least: int = 0) -> np.ndarray:
    """Vectors as rows of 64-bit integers; shorter ones are padded with zeros."""
    rows = [_unpacked(v) for v in vectors]
    out = np.zeros((len(rows), max([least, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def sorted_lists(entries: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(n, width, matrix, lists, ids) a block: n entries, and for every dimension their numbers by falling value.

    entries: v, ids. A task cuts what it reads into blocks of bounded size.
    """
    id_type = entries.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: list[bytes] = []
        ids: list[list] = []
        widest = 1

        def block() -> pa.RecordBatch:
            m = _matrix(vectors)
            order = np.argsort(-m, axis=0, kind="stable").astype("<i4")
            cols = [pa.array([len(m)], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary()), pa.array([ids], pa.list_(kind))]
            vectors.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(cols, ["n", "width", "matrix", "lists", "ids"])

        for b in batches:
            kind = b.column(1).type
            for v, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size = max(len(v) // 2, 1)
                if vectors and (len(vectors) + 1) * max(widest, size) > block_values:
                    yield block()
                    widest = 1
                vectors.append(v)
                ids.append(own)
                widest = max(widest, size)
        if vectors:
            yield block()

    return entries.select("v", "ids").mapInArrow(run, f"n int, width int, matrix binary, lists binary, ids array<{id_type}>")


class Search:
    """The best entries of some queries so far, and the threshold algorithm on one more block.

    An entry holds the smallest ids of equal vectors. A query keeps its best k
    entries by score, then by the smallest id that isn't its own; an entry of its
    own id alone is none.
    """

    def __init__(self, ids: list, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best: list[list[tuple]] = [[] for _ in ids]  # (-score, smallest other id, ids), sorted
        self.met = 0  # entries scored

    def floors(self) -> np.ndarray:
        """What an entry must reach to count."""
        return np.array([-b[-1][0] if len(b) >= self.k else -np.inf for b in self.best])

    def block(self, matrix: np.ndarray, lists: np.ndarray, ids: list[list]) -> None:
        n, width = matrix.shape
        queries = self.queries
        if queries.shape[1] != width:  # missing components are zero
            width = max(width, queries.shape[1])
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            lists = np.pad(lists, ((0, 0), (0, width - matrix.shape[1])))
            lists[:, matrix.shape[1] :] = np.arange(n)[:, None]
            matrix = np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
        most = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width
        if most >= _LIMIT:
            raise ValueError("a score is too large to be an exact integer")
        if most < _EXACT:  # doubles hold all sums exactly
            matrix, queries = matrix.astype(np.float64), queries.astype(np.float64)
        depths = [0]
        while depths[-1] < n:
            depths.append(min(max(2 * depths[-1], FIRST_DEPTH), n))
        # The bound after so many steps down all lists; what comes next in a list is at most what was met last.
        values = np.take_along_axis(matrix, lists, 0)
        at = np.array([max(t - 1, 0) for t in depths])
        bounds = np.maximum(queries, 0) @ values[at].T + np.minimum(queries, 0) @ values[n - 1 - at].T
        first, second = (np.array([own[min(j, len(own) - 1)] for own in ids]) for j in (0, 1))
        for q in np.flatnonzero(bounds[:, 0] >= self.floors()).tolist():
            self._descend(q, queries[q], matrix, lists, depths, bounds[q], ids, first, second)

    def _descend(self, q: int, weights: np.ndarray, matrix: np.ndarray, lists: np.ndarray, depths: list[int], bounds: np.ndarray, ids: list[list], first: np.ndarray, second: np.ndarray) -> None:
        n = len(matrix)
        up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        if not len(up) + len(down):
            depths = [0, n]  # no list tells entries apart: all score zero
        seen = np.zeros(n, bool)
        best, own = self.best[q], self.ids[q]
        for a, b, bound in zip(depths, depths[1:], bounds, strict=False):
            if len(best) >= self.k and bound < -best[-1][0]:
                return
            if len(up) + len(down):
                fresh = np.zeros(n, bool)
                fresh[lists[a:b][:, up]] = True
                fresh[lists[n - b : n - a][:, down]] = True
                fresh &= ~seen
                seen |= fresh
                new = np.flatnonzero(fresh)
            else:
                new = np.arange(n)
            self.met += len(new)
            scores = matrix[new] @ weights
            if len(best) >= self.k:
                over = scores >= -best[-1][0]
                new, scores = new[over], scores[over]
            names = np.where(first[new] == own, second[new], first[new])
            other = names != own
            new, scores, names = new[other], scores[other], names[other]
            if len(new) > self.k:
                top = np.lexsort((names, -scores))[: self.k]
                new, scores, names = new[top], scores[top], names[top]
            best += [(-int(s), name, ids[i]) for s, name, i in zip(scores.tolist(), names.tolist(), new.tolist(), strict=True)]
            best.sort(key=lambda x: x[:2])
            del best[self.k :]
            if seen.all():
                return

    def results(self) -> list[tuple]:
        """(query number, id, score) of each query's k best rows among the blocks so far, its own id left out."""
        out = []
        for q, (own, best) in enumerate(zip(self.ids, self.best, strict=True)):
            rows = sorted((s, i) for s, _, ids in best for i in ids if i != own)
            out += [(q, i, -s) for s, i in rows[: self.k]]
        return out


def top_k(embeddings: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES, query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank (from 1), <id_col>, score: for each query its k best other rows by integer inner product.

    queries is a predicate on `id` that says which rows ask; every usable row is a
    candidate. A component x counts as floor(scale * x), in double arithmetic.
    Ties go to the smaller id; a query gets fewer rows if there are fewer.

    Queries are a stated set: they are taken in blocks of about query_values
    components, each broadcast and asked of all blocks of lists. Equal vectors
    are grouped first, and of each group the k + 1 smallest ids can be results,
    so a vector that a third of all rows hold costs no more than another.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part; rows that repeat id and vector are one; an id with
    several vectors may be found by each, and asks with each. Missing components
    of shorter vectors count as zero, so an empty vector scores zero. An empty
    table gives no row; other columns are ignored. Components of 2^53 and more
    after scaling, and scores of 2^62 and more, raise a ValueError.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema[id_col].dataType.simpleString()
    rows = materialize(quantized(embeddings, id_col, vector_col, scale).groupBy("v", "id").agg(F.count("*").alias("copies")).select("v", "id"), "topk-rows")
    # The rank limit is applied in each task before rows are shuffled.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = materialize(sorted_lists(entries, block_values), "topk-lists")
    asking = rows.where(queries)
    size = asking.agg(F.sum(F.greatest(F.octet_length("v") / 2, F.lit(1)))).first()[0] or 0
    blocks = max(-(-int(size) // query_values), 1)
    path = new_path(spark, "topk-results")
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).collect() if size else []
        part.sort(key=lambda r: (r["id"], r["v"]))
        sent = spark.sparkContext.broadcast(([r["id"] for r in part], [bytes(r["v"]) for r in part]))
        found = lists.mapInArrow(_searcher(sent, k, kind), f"q int, query_id {kind}, id {kind}, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
        found.write.mode("append").parquet(path)
        sent.unpersist()
    discard(rows, lists)
    return spark.read.schema(found.schema).parquet(path)


def _searcher(sent: Broadcast, k: int, kind: str):  # noqa: ANN202
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    id_type = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        search = Search(ids, _matrix(vectors), k)
        for b in batches:
            for r in b.to_pylist():
                shape = (r["n"], r["width"])
                search.block(np.frombuffer(r["matrix"], "<i8").reshape(shape), np.frombuffer(r["lists"], "<i4").reshape(shape), r["ids"])
        got = search.results()
        cols = list(zip(*got, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([ids[q] for q in cols[0]], id_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.int64())], ["q", "query_id", "id", "score"])

    return run
