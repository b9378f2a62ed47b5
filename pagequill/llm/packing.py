"""Packing of tokenised documents into fixed-length sequences, best fit decreasing."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of open pieces that a task holds before it packs them (4 bytes each).
WINDOW_TOKENS = 1 << 22
CHUNK_CHARS = 1 << 18
PROBES = ("The quick brown fox's 12 jumps,\n\n  over\tthe lazy dog!  ", "Éléphant naïve — 東京 …  x", "a" * 300 + " \r\n \x1c ~~~ <|end> 1234567")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str, pattern: str):  # noqa: ANN201
    """A function from text to parts of its ids, as the tokenizers library gives for the file at path.

    A byte-level BPE file whose ids are in merge order is loaded into tiktoken,
    which is several times as fast; that is done only if both libraries agree on
    PROBES, otherwise tokenizers itself is used. A text that holds the string of
    an added token goes to tokenizers as a whole: there it is that token.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
    try:
        import tiktoken

        of, special = _byte_of(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if not all(fast(p) == plain(p) for p in PROBES):
            fast = plain
    except (KeyError, ValueError, ImportError):
        fast = plain

    def ids(text: str) -> Iterator[list[int]]:
        """The ids, part by part."""
        if added.search(text):
            yield plain(text)
        else:
            yield from map(fast, _chunks(text))

    return ids


_GAP = re.compile(r"(?<=\w) (?=\w)")


def _chunks(text: str) -> Iterator[str]:
    """Parts of a long text, cut before a single space between word characters.

    Byte-level pre-tokenisers always start a new token there, so the parts' ids
    joined are the text's ids.
    """
    at = 0
    while len(text) - at > CHUNK_CHARS and (cut := _GAP.search(text, at + CHUNK_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_ids(text: str | None, encode, end_id: int) -> np.ndarray:  # noqa: ANN001
    parts = [np.array(p, "<u4") for p in encode(text or "")]
    return np.concatenate([*parts, np.array([end_id], "<u4")])


class CapacityTree:
    """Open windows by remaining capacity; a segment tree finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, leaf: int, value: bool) -> None:
        k = self.base + leaf
        self.some[k] = value
        while k > 1:
            k >>= 1
            now = self.some[2 * k] or self.some[2 * k + 1]
            if self.some[k] == now and value:
                break
            self.some[k] = now

    def add(self, window: int, left: int) -> None:
        if left > 0:
            self.at[left].append(window)
            if len(self.at[left]) == 1:
                self._mark(left, True)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window with the least remaining capacity >= need: (window, capacity)."""
        k = self.base + need
        if not self.some[k]:
            while k > 1 and (k & 1 or not self.some[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        left = k - self.base
        window = self.at[left].pop()
        if not self.at[left]:
            self._mark(left, False)
        return window, left


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """(window, offset) of each piece, and the number of windows. Longest pieces first; ties in order."""
    tree, opened = CapacityTree(capacity), 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.tightest(lengths[i])
        window, left = got or (opened, capacity)
        opened += got is None
        out[i] = (window, capacity - left)
        tree.add(window, left - lengths[i])
    return out, opened


_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: <id_col>, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset, padded_length.

    A document's ids and end_id are cut into full windows of `capacity`, which
    are sequences of their own; the rest is packed best fit decreasing. Each task
    packs what it reads, window_tokens tokens at a time, so that nothing is
    shuffled, memory is bounded, and no key can be hot; a window of that size
    wastes a fraction of a percent. A sequence is padded to `capacity`, unless
    its length is a power of two.

    Null text counts as empty: one piece that is end_id alone. Repeated rows are
    packed each for itself; null ids stay null; an empty table gives no piece;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        base, used = TaskContext.get().partitionId() << 36, 0
        full: list[tuple] = []
        rest: list[tuple] = []
        held = ready = 0
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"])

        def packed() -> list[tuple]:
            nonlocal used
            places, n = best_fit_decreasing([r[2] for r in rest], capacity)
            fill = [0] * n
            for (w, at), r in zip(places, rest, strict=True):
                fill[w] = max(fill[w], at + r[2])
            rows = [(*r, base + used + w, at, fill[w] if fill[w] & (fill[w] - 1) == 0 else capacity) for (w, at), r in zip(places, rest, strict=True)]
            used += n
            rest.clear()
            return rows

        for b in batches:
            kind = b.column(0).type
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids, key = token_ids(text.as_py(), encode, end_id), key.as_py()
                n = len(ids)
                for at in range(0, n - n % capacity, capacity):
                    full.append((key, at, capacity, ids[at : at + capacity].tobytes(), n, base + used, 0, capacity))
                    used += 1
                    ready += capacity
                    if ready >= window_tokens:
                        yield out(full)
                        full, ready = [], 0
                if n % capacity:
                    rest.append((key, n - n % capacity, n % capacity, ids[n - n % capacity :].tobytes(), n))
                    held += n % capacity
                    if held >= window_tokens:
                        yield out(packed())
                        held = 0
        for rows in (full, packed() if rest else []):
            if rows:
                yield out(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {_SCHEMA}")
    return rows.withColumnRenamed("id", id_col)
