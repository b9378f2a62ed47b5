"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

Seeds are pairs of words, neighbours or one word apart, as a copy whose every
third word is changed has no longer run that stays. No match is lost by them.
With MATCH 2, MISMATCH -1 and GAP -1, let an alignment have M matched words and
score T or more. Of its M - 1 pairs of consecutive matches let A have no error
between them, C one error, the others two or more:
T <= 2 M - C - 2 (M - 1 - A - C), so 2 A + C >= T - 2. Pairs without an error are
neighbours in item and text, pairs with one have one word between them in the
item, the text or both. The text from the first match to the last has at most
3 m - T words for an item of m words.

So an alignment holds seeds of a weight of T - 2 at least, and of an item's seeds
those can be left aside of which no alignment holds that weight: the most
frequent in all documents. The others are its rare seeds, one of which every
match has. They are what is searched in all texts, and what is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.common import materialize, split_members

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Characters of benchmark text that are held at once; a larger benchmark is taken in blocks.
BLOCK_CHARS = 2_000_000
#: Bytes of text that are searched at once; a longer text comes alone.
SLICE_BYTES = 1 << 21
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; ASCII other than letters and digits divides words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


#: Stands twice between two texts that are searched together; no text holds this byte.
_END = b"\xff"


def numbered_words(texts: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """The words of all texts as numbers: -1 for words that no item has, -2 twice behind each text."""
    words = (b" " + _END + b" " + _END + b" ").join([*texts, b""]).translate(_TABLE).split()
    return np.fromiter(map((number | {_END: -2}).get, words, repeat(-1)), np.int64, len(words))


def _slot(codes: np.ndarray) -> np.ndarray:
    """A place among 2^20 for each code, to tell at once most pairs that are no seeds."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def code(distance: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A pair of word numbers (below 2^30) so many words apart in the text."""
    return (left << 30 | right) * 3 + distance


class Lookup:
    """Some of the seeds, by their distinct sorted codes: the first seed and the number of seeds of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.first, self.size = np.unique(codes, return_index=True, return_counts=True)
        self.distances = [d for d in range(3) if np.any(codes % 3 == d)]
        self.likely = np.zeros(1 << 20, bool)
        self.likely[_slot(self.codes)] = True

    def hits(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in codes, places in b) of all pairs of the numbered words b that are seeds."""
        seeds, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in self.distances:
            at = np.flatnonzero((b[d:] >= 0) & (b[: max(len(b) - d, 0)] >= 0)) + d
            c = code(d, b[at - d], b[at])
            some = np.flatnonzero(self.likely[_slot(c)])
            c, at = c[some], at[some]
            lo = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[lo] == c)
            seeds.append(lo[hit])
            places.append(at[hit])
        return np.concatenate(seeds), np.concatenate(places)


@dataclass
class Seeds:
    """Items of a block, and the places of their seeds as sorted codes (see code)."""

    ids: list
    words: list[list[bytes]]
    number: dict[bytes, int]
    #: By seed, sorted: its code, item and weight.
    codes: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    #: By item: the least sum of weights, and the most words of text that hold it.
    least: np.ndarray
    most: np.ndarray
    lookup: Lookup

    @classmethod
    def of(cls, rows: list[tuple], min_score: float) -> Seeds:
        items = [(k, w) for k, t in rows if (w := words_of(t))]
        number: dict[bytes, int] = {}
        parts, least, most = [np.empty((0, 3), np.int64)], [], []
        for i, (_, w) in enumerate(items):
            a = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
            need = max(math.ceil(min_score * MATCH * len(w) - 1e-9), 1)
            least.append(max(need - MATCH, 1))
            most.append(max(3 * len(w) - need, 1))
            # (distance in the text, left, right, weight); a single word is a seed where one match is enough.
            pairs = [(0, a, a, 1)] if need <= MATCH else [(1, a[:-1], a[1:], 2), (2, a[:-1], a[1:], 1), (1, a[:-2], a[2:], 1), (2, a[:-2], a[2:], 1)]
            own = np.concatenate([np.stack([code(d, x, y), np.full(len(x), i), np.full(len(x), v)], 1) for d, x, y, v in pairs])
            own = own[np.lexsort((-own[:, 2], own[:, 0]))]
            parts.append(own[np.unique(own[:, 0], return_index=True)[1]])
        seeds = np.concatenate(parts)
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        return cls([k for k, _ in items], [w for _, w in items], number, *np.ascontiguousarray(seeds.T), np.array(least, np.int64), np.array(most, np.int64), Lookup(seeds[:, 0]))

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """Of each seed, whether it is a rare one of its item; counts: how often each distinct code stands in all documents.

        The most frequent seeds of an item are left aside, as many as leave no
        alignment of the score without another one.
        """
        often, out = counts[np.unique(self.codes, return_inverse=True)[1]], np.ones(len(self.codes), bool)
        order = np.lexsort((self.codes, -often, self.items))
        ends = np.searchsorted(self.items[order], np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            own = order[ends[i] : ends[i + 1]]
            lo, hi = 0, len(own)
            while lo < hi:  # the largest number that can be left aside
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self._left_out(i, set(self.codes[own[:mid]].tolist())) < self.least[i] else (lo, mid - 1)
            out[own[:lo]] = False
        return out

    def _left_out(self, i: int, aside: set[int]) -> int:
        """The largest weight of an alignment's seeds that are all among those left aside."""
        a = [self.number[w] for w in self.words[i]]
        if any(c % 3 == 0 for c in aside):  # single words: each is a match
            return int(self.least[i])
        pair = lambda d, x, y: (x << 30 | y) * 3 + d in aside
        back2, back1 = 0, 0
        for j in range(1, len(a)):
            one = 2 if pair(1, a[j - 1], a[j]) else 1 if pair(2, a[j - 1], a[j]) else 0
            two = j > 1 and (pair(1, a[j - 2], a[j]) or pair(2, a[j - 2], a[j]))
            back2, back1 = back1, max(back1 + one, back2 + int(two))
        return back1

    def windows(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, from, to): all parts of the text that can hold an alignment of the score, by the sum of their seeds' weights."""
        b = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        seed_of, at = self.lookup.hits(b)
        if not len(at):
            return []
        start, size = self.lookup.first[seed_of], self.lookup.size[seed_of]
        seed = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        item, weight, at = self.items[seed], self.weights[seed], np.repeat(at, size)
        size = len(words) + 1
        order = np.argsort(item * size + at, kind="stable")
        item, at, weight = item[order], at[order], weight[order]
        start = np.maximum(at - self.most[item] + 1, 0)
        total = np.concatenate(([0], np.cumsum(weight)))
        key = item * size + at
        upto = total[np.searchsorted(key, key, "right")]
        enough = np.flatnonzero(upto - total[np.searchsorted(key, item * size + start)] >= self.least[item])
        merged: list[tuple[int, int, int]] = []
        for i, a, z in zip(item[enough].tolist(), start[enough].tolist(), (at[enough] + 1).tolist(), strict=True):
            if merged and merged[-1][0] == i and a <= merged[-1][2]:
                merged[-1] = (i, merged[-1][1], z)
            else:
                merged.append((i, a, z))
        return merged

    def matches(self, text: str | None, min_score: float) -> list[tuple[int, tuple[float, int, int]]]:
        """(item, (score, start, end)) of the best alignment with each item that reaches min_score."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for i, a, z in self.windows(words):
            score, start, end = align(self.words[i], words[a:z])
            if score >= min_score and (i not in best or (score, -a - start) > (best[i][0], -best[i][1])):
                best[i] = (score, a + start, a + end)
        return sorted(best.items())


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best score, end in text): local alignment of two sequences of word numbers, linear gaps."""
    h = np.zeros(len(text) + 1, np.int64)
    climb = np.arange(len(text) + 1) * GAP
    best, end = 0, 0
    for w in item:
        diagonal = h[:-1] + np.where(text == w, MATCH, MISMATCH)
        now = np.maximum(np.maximum(diagonal, h[1:] + GAP), 0)
        h = np.concatenate(([0], now))
        h = np.maximum.accumulate(h - climb) + climb  # gaps in the item
        k = int(np.argmax(h))
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


def align(item: list[bytes], text: list[bytes]) -> tuple[float, int, int]:
    """(score as a share of the item's own, start, end) of the best local alignment."""
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item])
    b = np.array([number.get(w, -1) for w in text])
    best, end = smith_waterman(a, b)
    if not best:
        return 0.0, 0, 0
    back, length = smith_waterman(a[::-1], b[:end][::-1])
    return best / (MATCH * len(item)), end - length, end


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Matches: <id_col>, <item_col>, score, start_word, end_word (of words_of(text), end exclusive).

    One row per document row and item whose best alignment scores min_score or
    more of the item's own score. The benchmark is a stated query set: it is
    taken in blocks of BLOCK_CHARS characters at most, each block against all
    rows: one pass counts the block's seeds in all documents, another finds the
    passages that hold rare ones. Items or texts that are null or without words
    match nothing; repeated items and rows match each for themselves; a document
    that holds an item many times is one row, with the best place, the first of
    equals. Empty tables give no match; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out = [_matches(rows, seeds, min_score, item_type) for seeds in _blocks(benchmark, item_col, item_text_col, min_score)]
    best = reduce(DataFrame.unionByName, out)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "start_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text matches no item.

    Each row is judged by its own text, so null or repeated ids do no harm; a
    null text stays. The texts that match are few: their digests leave the other
    rows where they are.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.select(digest.alias("id"), F.lit(0).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    found = [_matches(rows, seeds, min_score, item_type).select(F.col("id").alias("__bad")) for seeds in _blocks(benchmark, item_col, item_text_col, min_score)]
    bad = materialize(reduce(DataFrame.unionByName, found).distinct(), "contaminated")
    return split_members(docs.withColumn("__digest", digest), "__digest", bad, "__bad")[1].drop("__digest")


def _slices(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about SLICE_BYTES; null texts are empty."""
    at, size, held = 0, 0, []
    for i, t in enumerate(b.column(column)):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        if held and size + len(raw) > SLICE_BYTES:
            yield at, held
            at, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def seed_counts(rows: DataFrame, seeds: Seeds) -> np.ndarray:
    """How often each distinct code of the seeds stands in the texts of all rows."""
    size = len(seeds.lookup.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, texts in _slices(b, 0):
                total += np.bincount(seeds.lookup.hits(numbered_words(texts, seeds.number))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])

    out = np.zeros(size, np.int64)
    got = rows.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row per code of the block at most
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def _passages(rows: DataFrame, seeds: Seeds, rare: np.ndarray, kind: str) -> DataFrame:
    """(id, row, gram, item, start, passage): parts of texts that can hold an alignment with an item, with a rare seed of the item in the text.

    Only texts that hold a rare seed are looked at further: by the weights of all
    seeds, which tell the parts that an alignment of the score needs.
    """
    lookup, items = Lookup(seeds.codes[rare]), seeds.items[rare]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for begin, texts in _slices(b, 2):
                words = numbered_words(texts, seeds.number)
                seed, at = lookup.hits(words)
                text_of = np.searchsorted(np.flatnonzero(words == -2)[1::2], at)
                for t in np.unique(text_of).tolist():
                    gram_of = {int(i): int(lookup.codes[k]) for k in np.unique(seed[text_of == t])[::-1].tolist() for i in items[lookup.first[k] : lookup.first[k] + lookup.size[k]]}
                    own = texts[t].translate(_TABLE).split()
                    found += [(begin + t, gram_of[i], i, a, b" ".join(own[a:z])) for i, a, z in seeds.windows(own) if i in gram_of]
            cols = list(zip(*found, strict=True)) or [()] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], ["id", "row", "gram", "item", "start", "passage"])

    return rows.select("id", "row", "text").mapInArrow(run, f"id {kind}, row long, gram long, item int, start long, passage binary")


def _matches(rows: DataFrame, seeds: Seeds, min_score: float, item_type: str) -> DataFrame:
    """(id, row, item, score, start_word, end_word): the best alignment of each row (id, row, text) with each item of a block."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    rare = seeds.rare(seed_counts(rows, seeds))
    table = pa.table({"gram": pa.array(seeds.codes[rare], pa.int64()), "item": pa.array(seeds.items[rare], pa.int32())})
    texts = pa.table({"item": pa.array(range(len(seeds.ids)), pa.int32()), "words": pa.array([b" ".join(w) for w in seeds.words], pa.binary())})
    names = spark.createDataFrame(list(enumerate(seeds.ids)), f"item int, name {item_type}")
    joined = _passages(rows, seeds, rare, kind).join(spark.createDataFrame(table), ["gram", "item"]).join(spark.createDataFrame(texts), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, *align(words.as_py().split(), passage.as_py().split())) for k, (words, passage) in enumerate(zip(b.column("words"), b.column("passage"), strict=True))]
            got = [x for x in got if x[1] >= min_score]
            k, score, start, end = (pa.array([x[j] for x in got], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64())))
            at = b.column("start").take(k)
            yield pa.RecordBatch.from_arrays([b.column("id").take(k), b.column("row").take(k), b.column("item").take(k), score, pc.add(at, start), pc.add(at, end)], ["id", "row", "item", "score", "start_word", "end_word"])

    found = joined.select("id", "row", "item", "words", "start", "passage").mapInArrow(run, f"id {kind}, row long, item int, score double, start_word long, end_word long")
    best = found.groupBy("id", "row", "item").agg(F.max(F.struct(F.col("score"), (-F.col("start_word")).alias("s"), "end_word")).alias("b"))
    return best.join(names, "item").select("id", "row", F.col("name").alias("item"), F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_score: float) -> Iterator[Seeds]:
    """The benchmark's seeds, a block of bounded size at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield Seeds.of(sorted(((r["item"], r["text"]) for r in part), key=lambda r: (str(r[0]), r[1])), min_score)
