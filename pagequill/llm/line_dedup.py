"""Near-duplicate lines by an exact set-similarity join.

Tokens of a line are its words (runs of non-(ASCII) space, A-Z lower-cased), as
a set of 64-bit hashes. Tokens are ordered by rarity in the corpus; two lines with
Jaccard similarity t or more share a token within their prefixes. Candidates pass
the length filter, the positional filter and a 128-bit parity sketch, whose
differing bits are never more than the differing tokens; then Jaccard is verified
exactly.

A line goes as soon as one earlier line is like it, so a set needs one partner,
not all: lists of equal prefix tokens yield the first few candidates of each set,
and only sets that these don't settle are held against more, at last against
everything that is left.

Texts are tokenised once, in the order of their ids, so that lines are numbered
as they are written. Postings and counts are shuffled as packed columns of many
rows, dealt by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequill.llm.common import discard, mark_possible, materialize

THRESHOLD = 0.8
#: Tokens whose place in the order is looked up: the most frequent ones. All
#: others are rarer and ordered by their hash, which any exact join allows.
RANKED_TOKENS = 1 << 20
#: Occurrences of a token from which its list is dealt into parts of about this length.
HOT_LIST = 20_000
#: Candidates that a set takes from a token's list, and tries at once, before it is held against everything.
PER_LIST, TRIES = 4, 3
_RARE, _PART = 1 << 62, 20
#: Characters that are tokenised at a time, and postings or counts that are packed, or compared in one task.
_TEXT, _POSTS = 4 << 20, 400_000
#: Words of 64 bits in the table of asked lists.
_WORDS = 1 << 20
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of byte strings, eight bytes of all of them at a time; very long ones one by one."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    starts, sizes = ends[:-1], np.diff(ends)
    raw = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = _mixed(sizes.astype(np.uint64) * _GOLD ^ (eight[starts] & _MASK[np.minimum(sizes, 8)]))
    more, k = np.nonzero(sizes > 8)[0], 8
    while len(more) and k < 256:
        out[more] = _mixed(out[more] * _GOLD ^ (eight[starts[more] + k] & _MASK[np.minimum(sizes[more] - k, 8)]))
        k += 8
        more = more[sizes[more] > k]
    for i in more:
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(raw[starts[i] : ends[i + 1]]))
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of bounded length; a longer single text stands alone."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + _TEXT, "right")), at + 1)
        yield at, texts.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each line of the texts, and line index and hash of each word."""
    lines = pc.split_pattern(pc.ascii_lower(texts), pattern="\n")
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    words = pc.ascii_split_whitespace(lines.flatten())
    line = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    flat = words.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        flat, line = flat.filter(pa.array(real)), line[real]
    return row, number, line, _hashes(flat)


def _packed(part: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """(part, data): rows of equal part in one value, column after column and by bytes of equal weight, which compress well."""
    # Two bytes are sorted by radix.
    by = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    parts = part[by]
    heads = np.nonzero(np.concatenate(([True], parts[1:] != parts[:-1])))[0] if len(part) else np.zeros(0, np.int64)
    parts = parts[heads]
    cols = [c[by] for c in cols]
    ends = np.append(heads[1:], len(part))
    planes = lambda c: c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()
    data = [b"".join([planes(c[a:z]) for c in cols]) for a, z in zip(heads.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])


def _unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(-1, n).T).view(k).ravel())
        at += size
    return out


def _ends(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))


def _cells(n: np.ndarray, flat: np.ndarray) -> pa.Array:
    """A binary value for each n of the flat numbers."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, _ends(8 * n).buffers()[1], pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _flat(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: how many numbers each value has, and all of them."""
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends) // 8, np.frombuffer(data.tobytes(), kind)


def token_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line that has a token: cid, id, tk, line, c0, c1, lead, words.

    cid numbers lines in the order of (id, hash of the text, line), a null id
    last; rows of equal id and text count once. tk hashes the whole text; c0 and
    c1 hash the token set; words are its hashes as bytes. lead tells that no
    earlier line of the same few megabytes has the same set; other lines are
    repeats, and have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            tk = b.column(2).to_numpy()
            again = np.concatenate(([last is not None], tk[1:] == tk[:-1])) if len(tk) else np.zeros(0, bool)
            for i in np.nonzero(again)[0].tolist():
                again[i] = (b.column(1)[i].as_py(), int(tk[i])) == ((b.column(1)[i - 1].as_py(), int(tk[i - 1])) if i else last)
            if len(tk):
                last = (b.column(1)[len(tk) - 1].as_py(), int(tk[-1]))
            if again.any():
                b = b.filter(pa.array(~again))
            for first, texts in _slices(pc.fill_null(b.column(3).cast(pa.string()), "")):
                rows = b.slice(first, len(texts))
                row, number, line, h = _words(texts)
                short = (h >> np.uint64(24)).astype(np.int64)
                by = np.argsort(line << 40 | short, kind="stable") if len(row) < 1 << 23 else np.lexsort((h, line))
                line, h, short = line[by], h[by], short[by]
                near = (line[1:] == line[:-1]) & (short[1:] == short[:-1])
                if (h[1:][near] != h[:-1][near]).any():
                    by = np.lexsort((h, line))
                    line, h = line[by], h[by]
                if len(h):
                    keep = np.concatenate(([True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])))
                    line, h = line[keep], h[keep]
                heads = np.nonzero(np.concatenate(([True], line[1:] != line[:-1])))[0] if len(line) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(heads, len(line)))
                of = line[heads]
                added = lambda salt: np.add.reduceat(_mixed(h ^ np.uint64(salt)), heads) if len(heads) else np.zeros(0, np.uint64)  # noqa: B023, E731
                c0, c1 = added(0x2545F4914F6CDD1D), added(0x9E6C63D0876A9A47)
                _, where, back = np.unique(c0, return_index=True, return_inverse=True)
                lead = (where[back] == np.arange(len(c0))) | (c1[where[back]] != c1) if len(c0) else np.zeros(0, bool)
                at = pa.array(row[of])
                cid = (int(b.column(0)[0].as_py()) << 40) + count + np.arange(len(of))
                count += len(of)
                cells = _cells(np.where(lead, sizes, 0), h[np.repeat(lead, sizes)])
                cols = [pa.array(cid), rows.column(1).take(at), rows.column(2).take(at), pa.array(number[of].astype(np.int32)), pa.array(c0.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(lead), cells]
                yield pa.RecordBatch.from_arrays(cols, ["cid", "id", "tk", "line", "c0", "c1", "lead", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    place = [F.asc_nulls_last("id"), F.asc("tk")]
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place).select(F.spark_partition_id().alias("pid"), "id", "tk", "text")
    return rows.mapInArrow(run, f"cid long, id {kind}, tk long, line int, c0 long, c1 long, lead boolean, words binary")


def token_counts(lines: DataFrame) -> DataFrame:
    """(token, n): in how many leading lines each token stands; only tokens that stand in two or more."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(_flat(b.column(0), "<u8")[1])
            n += len(held[-1])
            if n > 16 * _POSTS:
                yield packed(np.sort(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield packed(np.sort(np.concatenate(held)))

    def packed(h: np.ndarray) -> pa.RecordBatch:
        heads = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
        return _packed((h[heads] % np.uint64(parts)).astype(np.int32), [h[heads], np.diff(np.append(heads, len(h)))])

    def merged(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate(h), np.concatenate(n)
        by = np.argsort(h)
        h, n = h[by], n[by]
        heads = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
        return h[heads], np.add.reduceat(n, heads)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ns, most = [], [], 8 * _POSTS
        for b in batches:
            for data in b.column(1):
                h, n = _unpacked(data.as_buffer().to_pybytes(), ["<u8", "<i8"])
                hs.append(h)
                ns.append(n)
                if sum(map(len, hs)) > most:
                    h, n = merged(hs, ns)
                    hs, ns, most = [h], [n], max(8 * _POSTS, 2 * len(h))
        if hs:
            h, n = merged(hs, ns)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    dealt = lines.where("lead").select("words").mapInArrow(count, "part int, data binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(merge, "token long, n long")


class Order:
    """The common order of tokens: rarer ones first.

    A token's number is its rank if it is one of the most frequent (rarest
    first), else its hash less 2^62, so that all others come before.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, n = hashes[by], n[by]
        order = np.lexsort((self.hashes, n))
        self.ranks = np.empty(len(n), np.int32)
        self.ranks[order] = np.arange(len(n))
        #: The first rank of tokens that stand in more than HOT_LIST lines.
        self.often = int(np.searchsorted(n[order], HOT_LIST, "right"))
        self.starts: np.ndarray | None = None

    def numbers(self, h: np.ndarray) -> np.ndarray:
        shift = np.uint64(43)
        if self.starts is None:  # made where it is used, as it's half of the table
            starts = np.searchsorted(self.hashes, np.arange(1 << 21, dtype=np.uint64) << shift)
            self.starts = np.append(starts, len(self.hashes)).astype(np.int32)
        out = (h >> np.uint64(3)).astype(np.int64) - _RARE
        bucket = (h >> shift).astype(np.int64)
        at, end, left = self.starts[bucket], self.starts[bucket + 1], np.arange(len(h))
        while True:
            keep = at < end
            at, end, left = at[keep], end[keep], left[keep]
            if not len(left):
                return out
            hit = self.hashes[at] == h[left]
            out[left[hit]] = self.ranks[at[hit]]
            at, end, left = at[~hit] + 1, end[~hit], left[~hit]


class Lists:
    """Into how many parts the lists of tokens are dealt: parts[rank - often] from the rank `often` on, all others are whole."""

    def __init__(self, often: int, parts: np.ndarray):
        self.often, self.parts = often, parts

    def split(self, key: np.ndarray) -> np.ndarray:
        """Number of parts of each key's list."""
        out = np.ones(len(key), np.int64)
        if len(self.parts):
            rank = key & ((1 << _PART) - 1)
            at = np.nonzero((key >= 0) & (rank >= self.often))[0]
            out[at] = self.parts[rank[at] - self.often]
        return out

    def dealt(self, key: np.ndarray, cid: np.ndarray) -> np.ndarray:
        """The part of the list for each posting."""
        n = self.split(key)
        if (n > 1).any():
            return key | (_mixed(cid.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64) << _PART
        return key

    def spread(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parts of the lists, and of which key each is one."""
        n = self.split(key)
        at = np.repeat(np.arange(len(key)), n)
        part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return key[at] | part << _PART if len(at) > len(key) else key, at


def token_order(lines: DataFrame, most: int = RANKED_TOKENS) -> Order:
    """The order by the counts of the `most` (at most) commonest tokens."""
    if most > 1 << _PART:
        raise ValueError("too many ranked tokens")
    counts = materialize(token_counts(lines), "token-counts")
    step = F.floor(8 * F.log2("n")).cast("int")  # 512 steps at most
    steps = sorted((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect())
    least = total = 0
    for s, k in reversed(steps):
        if total + k > most:
            least = s + 1
            break
        total += k
    got = counts.where(step >= least).toArrow()
    discard(counts)
    return Order(got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy())


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(size * t - 1e-9).astype(np.int64) + 1


def prefix_sets(lines: DataFrame, shared: Broadcast[Order], t: float = THRESHOLD) -> DataFrame:
    """A row per leading line: cid, id, tk, line, first, size, sk0, sk1, keys.

    sk0 and sk1 are the parity sketch of its token set; keys are the numbers of
    its prefix tokens, as bytes. first tells that
    no earlier line has the same set; the lines of a set meet in one task, of
    which every few megabytes of text have sent one at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            sizes, h = _flat(b.column(6), "<u8")
            line = np.repeat(np.arange(len(sizes)), sizes)
            num = order.numbers(h)
            # Sorted by line, then number: 39 bits of a number tell nearly all apart.
            short = np.where(num >= 0, num + (1 << 39), (num + _RARE) >> 22)
            by = np.argsort(line << 40 | short, kind="stable")  # lines lie in order, which it makes use of
            num, short = num[by], short[by]
            if ((line[1:] == line[:-1]) & (short[1:] == short[:-1])).any():
                num = num[np.lexsort((num, line))]
            heads = np.cumsum(sizes) - sizes
            bit = (num.astype(np.uint64) * _GOLD) >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), heads).view(np.int64) if len(heads) else np.zeros(0, np.int64) for w in (0, 1)]
            inside = _prefix(sizes, t)
            keys = num[np.arange(len(num)) - np.repeat(heads, sizes) < np.repeat(inside, sizes)]
            cols = [*b.columns[:6], pa.array(sizes.astype(np.int32)), *map(pa.array, sketch), _cells(inside, keys)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:6], "size", "sk0", "sk1", "keys"])

    rows = lines.where("lead").select("cid", "id", "tk", "line", "c0", "c1", "words")
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"cid long, id {kind}, tk long, line int, c0 long, c1 long, size int, sk0 long, sk1 long, keys binary")
    first = F.lag("cid").over(Window.partitionBy("c0", "c1").orderBy("cid")).isNull()
    return rows.select("cid", "id", "tk", "line", first.alias("first"), "size", "sk0", "sk1", "keys")


def dealt_lists(firsts: DataFrame, often: int, most: int) -> Lists:
    """The parts of lists that have more than HOT_LIST postings; only tokens that stand in more lines than that are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(most - often, np.int64)
        for b in batches:
            key = _flat(b.column(0), "<i8")[1]
            n += np.bincount(key[key >= often] - often, minlength=len(n))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    parts = np.ones(most - often, np.int64)
    if len(parts):
        got = firsts.select("keys").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_LIST).toArrow()
        parts[got.column("at").to_numpy()] = -(-got.column("n").to_numpy() // HOT_LIST)
    return Lists(often, parts)


_KINDS = ["<i8", "<i8", "<i4", "<i4", "<u8", "<u8", "?"]  # key, cid, size, pos, sk0, sk1, asks


def _dealt(sets: DataFrame, parts: int, lists: Lists, asks: bool, everywhere: bool = False, wanted: Broadcast[np.ndarray] | None = None) -> DataFrame:
    """(part, data): the postings of sets, packed by token.

    They go to one part of dealt lists, or everywhere; with wanted only to lists that its bits mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            n, key = _flat(b.column(4), "<i8")
            of = np.repeat(np.arange(len(n)), n)
            pos = (np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            if everywhere:
                key, at = lists.spread(key)
                of, pos = of[at], pos[at]
            else:
                key = lists.dealt(key, b.column(0).to_numpy()[of])
            if wanted is not None:
                word, bit = _marks(key)
                keep = (wanted.value[word] >> bit) & np.uint64(1) == 1
                key, of, pos = key[keep], of[keep], pos[keep]
            cid, size, sk0, sk1 = (b.column(k).to_numpy()[of] for k in range(4))
            held.append([key, cid, size, pos, sk0, sk1, np.full(len(key), asks)])
            rows += len(key)
            if rows > 2 * _POSTS:
                yield out(held)
                held, rows = [], 0
        if rows:
            yield out(held)

    def out(held: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        return _packed((_mixed(cols[0].view(np.uint64)) % np.uint64(parts)).astype(np.int32), cols)

    return sets.select("cid", "size", "sk0", "sk1", "keys").mapInArrow(run, "part int, data binary")


def _marks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(key.view(np.uint64))
    return (h % np.uint64(_WORDS)).astype(np.int64), h >> np.uint64(58)


def _asked(sets: DataFrame, lists: Lists) -> np.ndarray:
    """Bits that mark the lists of the sets, in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = _marks(lists.spread(_flat(b.column(0), "<i8")[1])[0])
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "bits"])

    got = sets.select("keys").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_WORDS, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _by_key(key: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """The order by (key, cid): two plain sorts, where a key's number and a cid, whose middle bits are mostly unused, fit 63 bits."""
    low = cid & ((1 << 40) - 1)
    bits, above = (int(x.max()).bit_length() if len(x) else 0 for x in (low, cid >> 40))
    by = np.argsort(key)
    run = np.cumsum(np.concatenate(([0], key[by][1:] != key[by][:-1]))) if len(key) else by
    if (len(cid) and cid.min() < 0) or bits + above + len(key).bit_length() > 63:
        return np.lexsort((cid, key))
    return by[np.argsort(run << (above + bits) | ((cid >> 40) << bits | low)[by])]


def _near(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Which postings i and j of one token pass the length, sketch and positional filters (indices into i), and by how many bits their sketches differ."""
    # Half a sketch and rounding up first: that drops most pairs at once.
    some = np.nonzero(np.bitwise_count(p["sk0"][i] ^ p["sk0"][j]) <= p["slack"][i] + p["slack"][j])[0]
    i, j = i[some], j[some]
    n, m, x, y = p["size"][i], p["size"][j], p["pos"][i], p["pos"][j]
    need = np.ceil((n + m) * (t / (1 + t)) - 1e-9).astype(np.int32)
    apart = np.bitwise_count(p["sk0"][i] ^ p["sk0"][j]).astype(np.int32) + np.bitwise_count(p["sk1"][i] ^ p["sk1"][j])
    ok = (np.maximum(apart, np.abs(n - m)) <= n + m - 2 * need) & (np.minimum(n, m) >= np.maximum(n, m) * t - 1e-9)
    ok = np.nonzero(ok & (np.minimum(x, y) + np.minimum(n - x, m - y) >= need))[0]
    return some[ok], apart[ok]


def _candidates(dealt: DataFrame, parts: int, t: float, most: int | None, lists: Lists, whole: bool) -> DataFrame:
    """(a, b, apart, more): earlier sets b that share a prefix token with a and pass the filters.

    Sets that ask are held against the earlier ones of each list, the next ones
    first, until they have `most` (all, if None). more tells that a list may hold
    further ones; b is null where only that is to say. Unless whole, sets ask in
    their own part of dealt lists only, and all postings ask. A task has about
    _POSTS postings; a list has about HOT_LIST at most, as longer ones are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(d.as_buffer().to_pybytes(), _KINDS) for b in batches for d in b.column(1)]
        if got:
            yield compared(dict(zip(("key", "cid", "size", "pos", "sk0", "sk1", "asks"), (np.concatenate(c) for c in zip(*got, strict=True)), strict=True)))

    def compared(p: dict[str, np.ndarray]) -> pa.RecordBatch:
        by = _by_key(p["key"], p["cid"])
        p = {k: v[by] for k, v in p.items()}
        p["slack"] = np.minimum(np.ceil(p["size"] * ((1 - t) / (1 + t)) + 1e-6), 32).astype(np.uint8)
        key, cid, asks = p["key"], p["cid"], p["asks"]
        n = len(key)
        heads = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        before = (np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))).astype(np.int32)
        found, told = np.zeros(n, np.int32), np.zeros(n, bool)
        more = np.zeros(n, bool) if whole else lists.split(key) > 1
        pairs = []
        live, d = np.nonzero(asks & (before > 0))[0], 1
        while len(live):
            ok, apart = _near(p, live, live - d, t)
            i = live[ok]
            good = cid[i - d] < cid[i]
            if whole:
                good &= ~asks[i - d]
            i, apart = i[good], apart[good]
            if len(i):
                pairs.append((i, i - d, apart))
                found[i] += 1
            live = live[before[live] > d]
            if most is not None and len(i):
                full = found[live] >= most
                more[live[full]] = True
                live = live[~full]
            d += 1
        a, b, apart = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        told[a] = True
        rest = np.nonzero(more & ~told)[0]
        who = np.concatenate((cid[a], cid[rest]))
        whom = pa.array(np.concatenate((cid[b], cid[rest])), mask=np.arange(len(who)) >= len(a))
        cols = [pa.array(who), whom, pa.array(np.concatenate((apart, np.zeros(len(rest)))).astype(np.int32)), pa.array(np.concatenate((more[a], more[rest])))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "apart", "more"])

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(run, "a long, b long, apart int, more boolean")


def _suspects(lines: DataFrame, needed: DataFrame) -> DataFrame:
    """(cid, words) of the lines whose cid is in needed.key, and a few others."""
    few = mark_possible(lines.where("lead").select("cid", "words"), F.col("cid"), needed, "key", "wanted")
    return materialize(few.where("wanted").select("cid", "words"), "line-suspects")


def _verified(few: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(cid): each a of the pairs (a, b) whose sets have Jaccard >= t, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cid, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * (1 + t) >= (len(x) + len(y)) * t - 1e-9:
                    out.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["cid"])

    side = lambda s: few.select(F.col("cid").alias(s), F.col("words").alias(f"{s}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "a_words", "b_words")
    return materialize(both.mapInArrow(run, "cid long").distinct(), "line-late")


def similar_to_earlier(lines: DataFrame, firsts: DataFrame, order: Order, threshold: float = THRESHOLD) -> DataFrame:
    """(cid) of the first lines of a set that have Jaccard >= threshold with an earlier line.

    A set takes a few candidates from each list and tries those of the closest
    sketches, then the others; that settles nearly all members of a group of near
    copies. Sets that are open, and may have further candidates, are then held
    against all earlier ones, in all parts of dealt lists. So no link is missed,
    and a large group doesn't list all its pairs.
    """
    t, spark = threshold, lines.sparkSession
    lists = dealt_lists(firsts, order.often, len(order.ranks))
    size = firsts.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 * _POSTS) + 1)
    near = _candidates(_dealt(firsts, parts, lists, True), parts, t, PER_LIST, lists, False)
    found = F.sort_array(F.collect_set(F.when(F.col("b").isNotNull(), F.struct("apart", "b"))))
    near = near.groupBy("a").agg(F.transform(found, lambda x: x["b"]).alias("found"), F.max("more").alias("more"))
    near = materialize(near, "line-near")
    few = _suspects(lines, near.where(F.size("found") > 0).select(F.explode(F.concat(F.array("a"), "found")).alias("key")))
    settled = _verified(few, near.select("a", F.explode(F.slice("found", 1, TRIES)).alias("b")), t)
    left = near.join(settled, F.col("a") == F.col("cid"), "left_anti")
    others = left.where(F.size("found") > TRIES).select("a", F.explode(F.slice("found", TRIES + 1, 1 << 30)).alias("b"))
    settled = settled.unionByName(_verified(few, others, t))
    rest = materialize(near.where("more").join(settled, F.col("a") == F.col("cid"), "left_anti").select("a", "found"), "line-open")
    asking = mark_possible(firsts, F.col("cid"), rest, "a", "wanted").where("wanted").join(rest, F.col("cid") == F.col("a"), "left_semi")
    asking = materialize(asking.select("cid", "size", "sk0", "sk1", "keys"), "line-asking")
    marks = spark.sparkContext.broadcast(_asked(asking, lists))
    dealt = _dealt(firsts, parts, lists, False, wanted=marks).unionByName(_dealt(asking, parts, lists, True, everywhere=True))
    pairs = _candidates(dealt, parts, t, None, lists, True).select("a", "b").distinct().join(rest, "a")
    pairs = materialize(pairs.where(~F.array_contains("found", F.col("b"))).select("a", "b"), "line-candidates")
    marks.destroy()
    discard(few)
    few = _suspects(lines, pairs.select(F.explode(F.array("a", "b")).alias("key")))
    settled = materialize(settled.unionByName(_verified(few, pairs, t)), "line-settled")
    discard(few, near, rest, asking, pairs)
    return settled


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = RANKED_TOKENS) -> DataFrame:
    """(id, tk, removed): the numbers (from 0) of the lines to remove of each document that has any."""
    lines = materialize(token_lines(docs, id_col, text_col), "lines")
    order = token_order(lines, most)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    sets = materialize(prefix_sets(lines, shared, threshold), "line-sets")
    shared.destroy()
    late = similar_to_earlier(lines, sets.where("first"), order, threshold)
    place = ["id", "tk", "line"]
    repeats = lines.where("not lead").select(place).unionByName(sets.where("not first").select(place))
    near = mark_possible(sets.where("first").select("cid", *place), F.col("cid"), late, "cid", "wanted").where("wanted").join(late, "cid", "left_semi")
    gone = materialize(repeats.unionByName(near.select(place)).groupBy("id", "tk").agg(F.collect_set("line").alias("removed")), "line-removed")
    discard(lines, sets, late)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = RANKED_TOKENS, report: bool = False) -> DataFrame:
    """docs, all columns as they were, with the near-duplicate lines taken out of <text_col>.

    With report, only <id_col>, <text_col>, n_lines and removed_lines (their
    numbers, from 0) of each row. Lines end at \\n and are ordered by id, line
    number; a null id comes last, and rows that share an id are ordered by a hash
    of their texts. A line goes if any earlier line of the corpus has Jaccard >=
    threshold with it, also one that goes itself; so the first line of a group
    stays. Lines without a token stay. Rows of equal id and text count as one and
    have equal results. Null text stays null; a text all of whose lines go
    becomes empty; an empty table stays empty. Only rows that lose a line are
    shuffled with their texts.
    """
    gone = removed_lines(docs, id_col, text_col, threshold, most).select(F.struct("id", "tk", "removed").alias("gone"), F.xxhash64("id", "tk").alias("mark"))
    # All of a row is one column here, so that no name of its own clashes.
    mark = F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("row_mark"))
    rows = mark_possible(rows, F.col("row_mark"), gone, "mark", "hit")
    none = F.lit(None).cast("array<int>")

    text = F.col("row").getField(text_col)
    kept = rows.where(~F.col("hit")).select("row", text.alias("text"), none.alias("removed"))
    # A table of what goes, by hash: texts needn't be sorted.
    found = rows.where("hit").join(gone.hint("shuffle_hash"), F.col("row_mark") == F.col("mark"), "left").select("row", F.col("gone.removed").alias("removed"), F.split(text.cast("string"), "\n").alias("parts"))
    left = F.array_join(F.expr("transform(array_except(sequence(0, size(parts) - 1), removed), i -> parts[i])"), "\n").cast(docs.schema[text_col].dataType)
    found = found.select("row", F.when(F.col("removed").isNull(), text).otherwise(left).alias("text"), "removed")
    rows = kept.unionByName(found)
    if report:
        ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        count = F.coalesce(ends + 1, F.lit(0)).cast("int")
        return rows.select(F.col("row").getField(id_col).alias(id_col), F.col("text").alias(text_col), count.alias("n_lines"), F.array_sort(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed_lines"))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
