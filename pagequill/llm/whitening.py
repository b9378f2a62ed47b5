"""Whitening of embeddings with a few principal components, by LOBPCG on distributed products.

The covariance is never formed. Each step multiplies it with a block of vectors:
every task centres its rows, multiplies them with the block and adds up what
they give, and Spark sums the tasks' parts by dimension. The driver holds blocks
of (dimensions x BLOCK) numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.common import materialize
from pagequill.llm.topk import usable

#: Vectors iterated beside the wanted ones; they make the wanted ones converge sooner.
GUARD = 8
#: A component is certified if its residual is under so much of the largest eigenvalue.
TOLERANCE = 1e-13
#: A direction of less variance than so much of the largest is no component.
LEAST_VARIANCE = 1e-12
MAX_STEPS = 200
_LIMB = 25
_LIMIT = float(1 << 53)


def integers(embeddings: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x array<long>): floor(scale * c) + offset of each component of the usable vectors."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), c.alias("c")).where(usable(F.col("c")))
    exact = lambda v: F.when(F.abs(v * scale) < _LIMIT, F.floor(v * scale).cast("long") + offset).otherwise(F.raise_error(F.lit("a component is too large to be an exact integer")).cast("long"))
    return rows.select("id", F.transform("c", exact).alias("x"))


def _rows(b: pa.RecordBatch, column: int, width: int, fill: int) -> np.ndarray:
    """An array column as a matrix of integers; rows that are shorter are filled up."""
    flat, sizes = b.column(column).flatten().to_numpy(zero_copy_only=False), b.column(column).value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _sums(x: DataFrame, width: int, fill: int) -> np.ndarray:
    """Exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            total += _rows(b, 0, width, fill).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total, pa.int64())], ["dim", "total"])

    got = x.select("x").mapInArrow(run, "dim int, total long").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    return np.array([r["total"] for r in sorted(got, key=lambda r: r["dim"])], np.int64)


def covariance_product(x: DataFrame, n: int, sums: np.ndarray, fill: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a block B to V B, V being the covariance (divisor n) of all rows: one job, rows centred before they are multiplied."""
    width = len(sums)

    def product(block: np.ndarray) -> np.ndarray:
        m = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, m))
            for b in batches:
                y = (_rows(b, 0, width, fill) * n - sums) / n
                total += y.T @ (y @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["dim", "row"])

        parts = x.select("x").mapInArrow(run, "dim int, row array<double>")
        got = parts.groupBy("dim").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(m)]).collect()
        return np.array([[r[f"c{j}"] for j in range(m)] for r in sorted(got, key=lambda r: r["dim"])]) / n

    return product


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal columns of against; what adds nothing is left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        block = block - against @ (against.T @ block)
        if not block.size:
            return block.reshape(len(against), 0)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s.max(initial=0), 1e-300)] if s.max(initial=0) > 1e-10 else u[:, :0]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the k largest, falling, each certified by a product of its own.

    Rayleigh-Ritz on [X, W, P]: the iterate, the residuals, the previous
    directions. A step takes one product, of the new residuals; the others follow
    from it. When the residuals so reckoned are small, V X is computed afresh, and
    only residuals of that count. If they are still too large, the iteration goes
    on from there; ArithmeticError is raised if MAX_STEPS don't suffice.
    """
    m = min(k + guard, width)
    k = min(k, width)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, m)))[0]
    ax = product(x)
    p, fresh = np.zeros((width, 0)), True
    best = np.inf
    for _ in range(MAX_STEPS):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        turn = turn[:, ::-1]
        values, x, ax = values[::-1], x @ turn, ax @ turn
        residual = ax - x * values
        norms = np.linalg.norm(residual[:, :k], axis=0)
        top = max(values[0], 0.0)
        if fresh and (norms.max(initial=0) <= tolerance * top or m == width or not top):
            return values[:k], x[:, :k], norms
        if norms.max(initial=0) <= tolerance * top / 2:  # as reckoned: certify
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            values = np.einsum("ij,ij->j", x, ax)
            residual = ax - x * values
            now = np.linalg.norm(residual[:, :k], axis=0).max()
            if now <= tolerance * top:
                continue
            if now >= best / 2 and now <= 100 * tolerance * top:  # as far as doubles go: certified, at what is reported
                return values[:k], x[:, :k], np.linalg.norm(residual[:, :k], axis=0)
            best, p = now, p[:, :0]
        w = _orthonormal(residual, x)
        p = _orthonormal(p - w @ (w.T @ p), np.hstack([x, w]))
        added = np.hstack([w, p])
        if not added.shape[1]:  # the block is invariant
            ax, fresh = product(x), True
            continue
        basis, image = np.hstack([x, added]), np.hstack([ax, product(added)])
        gram = basis.T @ image
        _, c = np.linalg.eigh((gram + gram.T) / 2)
        c = c[:, ::-1][:, :m]
        p = basis[:, m:] @ c[m:]
        x, ax, fresh = basis @ c, image @ c, False
    raise ArithmeticError(f"residuals of {norms.max():g} after {MAX_STEPS} steps")


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding", guard: int = GUARD) -> DataFrame:
    """<id_col>, component (from 1), n, deviation decimal(38, 0), whitened, explained, residual, identity_error.

    Each component c of a vector becomes the integer x = floor(scale * c) + offset.
    n counts the vectors, S are their sums, V is the covariance of x (divisor n)
    over all of them. deviation is the sum over dimensions of (n x - S)^2, exact.
    whitened is the row's x - S / n, projected on the unit eigenvector of V of the
    component, over the root of its eigenvalue e; components are numbered by
    falling e. explained is e / trace(V); residual is |V u - e u| / e of the largest
    e, as certified by a last product, which gives identity_error too: the largest
    absolute entry of the whitened rows' covariance minus the identity.

    Vectors that are null or hold null or non-finite components are left out. A
    vector that is shorter than the longest counts as if zeros followed. A row is
    there for each component up to `components` that has some variance: none for
    one vector, for equal vectors, or an empty table. Repeated rows count each
    for itself; null ids stay null; other columns are ignored. |n x - S| must stay
    under 2^50; an error is raised beyond.
    """
    x = materialize(integers(embeddings, id_col, vector_col, scale, offset), "whiten-x")
    kind = embeddings.schema[id_col].dataType.simpleString()
    seen = x.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most")).first()
    n, width, fill = seen["n"], seen["width"] or 0, offset
    if n and width and 2 * n * max(seen["most"], offset) >= 1 << 62:
        raise ValueError("too many rows for exact sums")
    sums = _sums(x, width, fill) if n and width else np.zeros(0, np.int64)
    values, vectors, norms, trace, error = np.zeros(0), np.zeros((width, 0)), np.zeros(0), 1.0, 0.0
    if width and n:
        product = covariance_product(x, n, sums, fill)
        trace = _trace(x, n, sums, fill)
        if trace > 0:
            values, vectors, norms = lobpcg(product, width, min(components, width), guard)
            some = values > LEAST_VARIANCE * values[0]
            values, vectors, norms = values[some], vectors[:, some], norms[some]
            scaled = vectors / np.sqrt(values)
            error = float(np.abs(scaled.T @ product(scaled) - np.eye(len(values))).max())
    scaled, count = vectors / np.sqrt(values), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, count + 1)
        for b in batches:
            if not count or not b.num_rows:
                continue
            a = _rows(b, 1, width, fill) * n - sums
            if np.abs(a).max() >= 1 << 50:
                raise ValueError("a deviation is too large to be exact")
            high, low = a >> _LIMB, a & ((1 << _LIMB) - 1)
            limbs = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
            at = np.repeat(np.arange(b.num_rows), count)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(numbers, b.num_rows), pa.int32()), *[pa.array(v[at], pa.int64()) for v in limbs], pa.array(((a / n) @ scaled).ravel(), pa.float64())],
                ["id", "component", "high", "middle", "low", "whitened"],
            )

    out = x.mapInArrow(run, f"id {kind}, component int, high long, middle long, low long, whitened double")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    deviation = wide("high") * F.lit(1 << 2 * _LIMB).cast("decimal(16,0)") + wide("middle") * F.lit(2 << _LIMB).cast("decimal(9,0)") + wide("low")
    of = lambda a: F.get(F.array(*map(F.lit, a.tolist())), F.col("component") - 1) if count else F.lit(None).cast("double")
    return out.select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), deviation.cast("decimal(38,0)").alias("deviation"), "whitened",
        of(values / trace).alias("explained"), of(norms / values.max(initial=1e-300)).alias("residual"), F.lit(error).alias("identity_error"),
    )


def _trace(x: DataFrame, n: int, sums: np.ndarray, fill: int) -> float:
    """The sum of all dimensions' variances."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum((((_rows(b, 0, width, fill) * n - sums) / n) ** 2).sum() for b in batches))])], ["total"])

    return (x.select("x").mapInArrow(run, "total double").agg(F.sum("total")).first()[0] or 0.0) / n
