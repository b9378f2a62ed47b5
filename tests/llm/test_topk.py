import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def plain(rows, k, every, scale=256):
    """All pairs."""
    ok = {(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, topk.top_k(df, F.col("id") % kw.pop("every", 10) == 0, **kw).collect()))


def test_equals_all_pairs_in_many_blocks(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    for values in (60, 1 << 19):
        assert got(frame(spark, rows).repartition(3), block_values=values, query_values=values) == plain(rows, 5, 10)


def test_ties_copies_and_signs(spark):
    r = random.Random(2)
    shared = [0.5, -0.25, 0.0]
    rows = [(i, r.choice([shared, [-0.5, 0.25, 0.0], [0.0, 0.0, 0.0], [r.choice([0.25, -0.25, 0.5]) for _ in range(3)]])) for i in range(300)]
    assert got(frame(spark, rows), block_values=12) == plain(rows, 5, 10)
    assert got(frame(spark, rows), k=1) == plain(rows, 1, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (None, [9.0, 9.0]), (10, None), (20, [None, 1.0]), (30, [math.nan, 1.0]), (40, [math.inf, 1.0]), (50, []), (1, [1.0]), (2, [0.001, -0.001]), (3, [3.0, 1.0, 2.0])]
    found = got(frame(spark, rows), k=3)
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(found) == plain(ok, 3, 10) and {q for q, *_ in found} == {0, 50}
    # A zero query scores zero with all, so the smallest ids are named.
    assert [x[2:] for x in found if x[0] == 50] == [(0, 0), (0, 0), (1, 0)] or [x[2:] for x in found if x[0] == 50] == [(0, 0), (1, 0), (2, 0)]
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(0, [1.0])])) == []
    assert got(frame(spark, [(5, [1.0])])) == []


def test_large_components(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(i, [float(1 << 30) + i, -float(1 << 29)]) for i in range(30)]
    exact = {(i, tuple(int(256 * x) for x in v)) for i, v in rows}
    want = sorted((i, r, j, s) for i, q in exact if i % 10 == 0 for r, (s, j) in enumerate(sorted(((sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in exact if j != i), key=lambda x: (-x[0], x[1]))[:2], 1))
    if max(abs(x[3]) for x in want) < 2**62:
        assert got(df(rows), k=2) == want
    with pytest.raises(Exception, match="too large"):
        got(df([(0, [1e300]), (1, [1.0])]))


def test_stops_early():
    """On entries that one list tells apart, few are scored."""
    r = np.random.default_rng(3)
    m = r.integers(-20, 20, (4000, 4))
    m[:, 0] = r.permutation(np.arange(4000) ** 2 // 100)
    order = np.argsort(-m, axis=0, kind="stable").astype("<i4")
    search = topk.Search([-1], np.array([[100, 1, -1, 0]]), 5)
    search.block(m, order, [[i] for i in range(4000)])
    want = sorted(((-int(s), i) for i, s in enumerate(m @ np.array([100, 1, -1, 0]))))[:5]
    assert [(-s, i) for _, i, s in search.results()] == want and search.met < 1000
    before = search.met
    search.block(m - 10**6, order, [[i] for i in range(4000)])  # the first bound is under the k-th result
    assert search.met == before
