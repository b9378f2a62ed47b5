"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed character n-grams (1 to 3
letters, word ends marked). Each language has several centroids, from spherical
k-means; the most similar centroid by cosine decides, and a text farther from it
than the centroid's own training texts are is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.common import crc_mod, materialize

BITS = 13
UNKNOWN = "und"
#: Texts that the centroids are fitted on, all languages together (expected number of a hash sample).
FIT_DOCS = 2000
CLUSTERS = 3
#: Share of a centroid's own training texts that lies beyond its rejection radius.
REJECT_QUANTILE = 0.01


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter 1- to 3-grams of the whole text; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, np.uint32(32))
    gap = c == 32
    c = np.concatenate(([np.uint32(32)], c[~(gap & np.concatenate(([True], gap[:-1])))], [np.uint32(32)]))
    a = c * np.uint32(0x9E3779B1)
    b = a[:-1] * np.uint32(0x85EBCA6B) + a[1:]
    d = b[:-1] * np.uint32(0xC2B2AE35) + a[2:]
    out = np.zeros(1 << BITS, np.int64)
    for k, h in enumerate((a, b, d)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(len(counts), np.float32)
    at = np.flatnonzero(counts)
    x[at] = (1 + np.log(counts[at])) * idf[at]
    return x / max(float(np.sqrt((x[at] ** 2).sum())), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the assignment; starts from farthest points, so it needs no chance."""
    k = min(k, len(x))
    first = x.mean(axis=0)
    centres = [x[int(np.argmax(x @ first))]]
    while len(centres) < k:
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c, of = np.array(centres), np.full(len(x), -1)
    for _ in range(rounds):
        now = (x @ c.T).argmax(axis=1)
        if (now == of).all():
            break
        of = now
        for j in range(k):
            if (of == j).any():
                m = x[of == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c, of


@dataclass(frozen=True)
class CentroidModel:
    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        cos = self.centroids @ _vector(counts, self.idf)
        best = int(np.argmax(cos))
        return self.langs[best], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.radius[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each hashed n-gram the number of texts (column text) that have it, over all rows, and the number of texts with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                got = ngram_counts(t.as_py())
                if got is not None:
                    df += got > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([n], df)))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[rows.bucket.to_numpy(np.int64) + 1] = rows.n.to_numpy(np.int64)
    return df[1:], int(df[0])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS, clusters: int = CLUSTERS) -> CentroidModel:
    """Fit on labelled rows; rows with a null language don't count.

    Document frequencies are over all rows. The centroids are fitted on a hash
    sample of about fit_docs rows, divided evenly among the languages, a
    language's task at a time; only centroids come to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("at"))
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = materialize(sizes, "lang-sizes")
    quota = max(fit_docs // max(sizes.count(), 1), 20)
    sample = rows.join(sizes, "lang").where(F.pmod("at", F.lit(1_000_000)) < F.lit(1_000_000.0 * quota) / F.col("n"))
    # Rows that repeat an id and its text are one of the sample.
    sample = sample.groupBy("lang", "at").agg(F.min("text").alias("text"))

    def centroids(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "text"], kind="stable")
        got = [c for c in map(ngram_counts, part.text) if c is not None]
        if not got:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        x = np.array([_vector(c, idf) for c in got])
        c, of = spherical_kmeans(x, clusters)
        used = [j for j in range(len(c)) if (of == j).any()]
        near = [np.quantile(x[of == j] @ c[j], REJECT_QUANTILE) for j in used]
        return pd.DataFrame({"lang": [key[0]] * len(used), "centroid": [c[j].tolist() for j in used], "radius": near})

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, radius double").toPandas()
    got = got.assign(first=got.centroid.map(lambda c: tuple(c[:4]))).sort_values(["lang", "first"]) if len(got) else got
    return CentroidModel(got.lang.tolist(), np.array(got.centroid.tolist(), np.float32), got.radius.to_numpy(np.float64), idf)


def predict(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, lang_pred, score, rejected) of every row, in one pass without a shuffle.

    score is the cosine to the nearest centroid, cut to 0..1. A null text, or one
    without a letter, is `und` with score 0, rejected; so is every text if the
    model has learned no language. Ties go to the first language by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score, far = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0) -> DataFrame:
    """Fit on rows outside the held-out fold, predict all rows: id, held_out, lang_pred, score, rejected."""
    fold = crc_mod(F.col(id_col), folds)
    model = fit(docs.where(fold != held), text_col, lang_col, id_col)
    return predict(docs, model, id_col, text_col).select(id_col, (crc_mod(F.col(id_col), folds) == held).alias("held_out"), "lang_pred", "score", "rejected")
