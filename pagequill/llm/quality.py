"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its words, hashed to
a fixed number of entries whose weights are learned, and from shares of letters
and repeats. Gated attention weights (learned, like all else, from document
labels only) say how much each passage counts, and the weighted passage
representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequill.llm.common import crc_mod

PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on, both labels together (expected number of a hash sample).
FIT_DOCS = 4000
THRESHOLD = 0.7
HIDDEN, GATE = 24, 16
#: Entries that words are hashed to, and shares of letters and repeats that are put beside them.
WORD_ENTRIES, SHARES = 256, 14
N_FEATURES = SHARES + WORD_ENTRIES
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))

# Byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other symbol, 6 beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:] = 6


def passages(text: str | None) -> np.ndarray:
    """The encoder's input for each passage of PASSAGE_WORDS words: one row at least, of zeros if there is no word."""
    return _joined(*_passages(text))


def _joined(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares beside the counts of the passages' word entries, damped and of length one."""
    passage = np.arange(len(words)) // PASSAGE_WORDS
    counts = np.bincount(passage * WORD_ENTRIES + words, minlength=len(shares) * WORD_ENTRIES).reshape(-1, WORD_ENTRIES)
    damped = np.log1p(counts)
    return np.concatenate((shares, damped / np.maximum(np.sqrt((damped * damped).sum(axis=1, keepdims=True)), 1e-9)), axis=1).astype(np.float32)


def _passages(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each passage, and the entry of each word of the text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[b]
    solid = kind != 0
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros((1, SHARES), np.float32), np.zeros(0, np.uint8)
    heads = np.arange(0, len(starts), PASSAGE_WORDS)
    at = starts[heads]
    words = np.diff(np.append(heads, len(starts))).astype(np.float64)
    size = np.diff(np.append(at, len(b))).astype(np.float64)
    counts = np.array([np.add.reduceat(kind == k, at, dtype=np.int64) for k in range(7)], np.float64)
    inked = np.maximum(size - counts[0], 1)
    lengths = (ends - starts).astype(np.float64)
    # A hash of each word, for repeats within the passage and from earlier passages.
    where = np.flatnonzero(solid)
    place = (where - np.repeat(starts, ends - starts)) & 63
    code = np.add.reduceat((b[where].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.concatenate(([0], np.cumsum(ends - starts)[:-1])))
    _, first = np.unique(code, return_index=True)
    new = np.zeros(len(code), bool)
    new[first] = True
    pair = code[:-1] * np.uint64(31) + code[1:]
    _, first = np.unique(pair, return_index=True)
    new_pair = np.zeros(len(code), bool)
    new_pair[first] = True
    last = kind[ends - 1]
    caps = np.add.reduceat((kind == 2)[where].astype(np.int64), np.concatenate(([0], np.cumsum(ends - starts)[:-1])))
    by = lambda x: np.add.reduceat(np.asarray(x, np.float64), heads) / words
    f = np.stack(
        [
            *(counts[k] / inked for k in (1, 2, 3, 4, 5, 6)),
            np.add.reduceat(b == 10, at, dtype=np.int64) / words,
            np.minimum(by(lengths), 40) / 10,
            by(lengths <= 2),
            by(new),
            by(new_pair),
            by(last == 5),
            by(caps > 1),
            np.log1p(words) / 4,
        ],
        axis=1,
    )
    return f.astype(np.float32), ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


@dataclass
class AttentionModel:
    """Weights of the network; without labels there are none, and every score is `constant`."""

    constant: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        if not self.w:
            return self.constant
        x = (passages(text) - self.mean) / self.scale
        logit, _ = _forward(self.w, np.clip(x, -8, 8), np.array([0]), np.zeros(len(x), np.int64))
        return float(1 / (1 + np.exp(-np.clip(logit[0], -30, 30))))


def _forward(w: dict, x: np.ndarray, heads: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, tuple]:
    h = np.tanh(x @ w["We"] + w["be"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    top = np.maximum.reduceat(e, heads)
    p = np.exp(e - top[bag])
    p /= np.add.reduceat(p, heads)[bag]
    z = np.add.reduceat(h * p[:, None], heads)
    return z @ w["c"] + w["b"][0], (h, t, g, p, z)


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 250, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> AttentionModel:
    """Adam on weighted log loss, full batches, fixed seed."""
    x = np.concatenate(bags).astype(np.float32)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    x = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    sizes = np.array([len(b) for b in bags])
    heads, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
    r = np.random.default_rng(seed)
    w = {k: r.normal(0, s[0] ** -0.5, s).astype(np.float32) for k, s in {"We": (x.shape[1], HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,)}.items()}
    w |= {"be": np.zeros(HIDDEN, np.float32), "b": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(q) for k, q in w.items()} for _ in range(2))
    share = (weights / weights.sum()).astype(np.float32)
    labels = labels.astype(np.float32)
    for step in range(1, rounds + 1):
        logit, (h, t, g, p, z) = _forward(w, x, heads, bag)
        d = (1 / (1 + np.exp(-logit)) - labels) * share
        dz = d[:, None] * w["c"]
        dh = dz[bag] * p[:, None]
        dp = (dz[bag] * h).sum(axis=1)
        de = p * (dp - np.add.reduceat(p * dp, heads)[bag])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh += dt @ w["V"].T + dg @ w["U"].T
        di = dh * (1 - h * h)
        grad = {"c": z.T @ d, "b": np.array([d.sum()]), "a": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "We": x.T @ di, "be": di.sum(axis=0)}
        for k in w:
            q = grad[k] + decay * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean=mean.astype(np.float32), scale=scale.astype(np.float32), w={k: q.astype(np.float32) for k, q in w.items()})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> AttentionModel:
    """Learn from labelled documents.

    A document that has several labels counts by their mean (1 from a half on);
    null labels and labels without a document don't count. About fit_docs / 2
    documents of each label, chosen by a hash of their ids, are used as a whole,
    with weights that restore the labels' true shares. With no labels at all, or
    only one kind, there is nothing to learn: the score is 1 or the mean label.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return AttentionModel(constant=float(next(iter(counts), 1)))
    part = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, fit_docs / 2 / n))])[F.col("y")]
    chosen = y.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_passages(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], ["y", "shares", "words"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # A document that has many rows counts once, by its least text.
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    got = rows.select("y", "text").mapInArrow(run, "y int, shares binary, words binary").toPandas()
    if got.y.nunique() < 2:
        return AttentionModel(constant=float(got.y.iloc[0]) if len(got) else 1.0)
    got = got.sort_values(["y", "shares", "words"])  # an order that partitions don't change
    bags = [_joined(np.frombuffer(f, np.float32).reshape(-1, SHARES), np.frombuffer(w, np.uint8)) for f, w in zip(got.shares, got.words, strict=True)]
    ys = got.y.to_numpy(np.float64)
    used = {k: (ys == k).sum() for k in counts}
    return train(bags, ys, np.array([counts[int(k)] / used[int(k)] for k in ys]))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """<id_col>, score (0 to 1), predicted (1 if score >= threshold) of every row, in one pass without a shuffle.

    Null text counts as empty; an empty text is one passage of zeros and has a
    score too. Repeated rows are scored alike; other columns are ignored.
    """
    out = docs.select(F.col(id_col), _scored(text_col, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    return docs.where(_scored(text_col, model) >= threshold)


def _scored(text_col: str, model: AttentionModel) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2) -> DataFrame:
    """Fit outside the held-out fold and score every row: id, held_out, score, predicted."""
    seen = labels.where(crc_mod(F.col(id_col), folds) != held)
    model = fit(docs, seen, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(F.col(id_col), (crc_mod(F.col(id_col), folds) == held).alias("held_out"), "score", "predicted")
