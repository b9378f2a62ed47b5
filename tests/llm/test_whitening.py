import math

import numpy as np
import pytest

from pagequill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def plain(vectors, scale=1024, offset=100_000):
    """(x, n, sums, eigenvalues, eigenvectors) by a full decomposition."""
    width = max(map(len, vectors))
    x = np.array([[math.floor(scale * float(np.float32(c))) + offset for c in [*v, *[0.0] * (width - len(v))]] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return x, n, s, e[::-1], u[:, ::-1]


def check(got, vectors, ids, k):
    x, n, s, e, u = plain(vectors)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    y = (x * n - s) / n
    for c in range(1, k + 1):
        want = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([by[c][i]["whitened"] for i in ids])
        assert np.abs(have - math.copysign(1, have @ want) * want).max() < 1e-9
        assert [int(by[c][i]["deviation"]) for i in ids] == [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
        assert abs(by[c][ids[0]]["explained"] - e[c - 1] / e.sum()) < 1e-12
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_equals_a_full_decomposition(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((500, 40)) * np.linspace(0.2, 1, 40)).astype("f4").tolist()
    got = whitening.whiten(frame(spark, enumerate(vectors)).repartition(5)).collect()
    check(got, vectors, range(500), 8)


def test_few_dimensions_short_vectors_and_low_rank(spark):
    r = np.random.default_rng(2)
    vectors = [v[: 3 + i % 3] for i, v in enumerate(r.standard_normal((60, 5)).tolist())]
    check(whitening.whiten(frame(spark, enumerate(vectors))).collect(), vectors, range(60), 5)
    line = [[float(t), 2.0 * t, -1.0 * t] for t in range(20)]
    check(whitening.whiten(frame(spark, enumerate(line))).collect(), line, range(20), 1)


def test_odd_rows(spark):
    good = [[1.0, 0.5], [0.0, -0.5], [0.25, 0.125], [0.25, 0.125]]
    rows = [*enumerate(good), (9, None), (10, [None, 1.0]), (11, [math.nan, 0.0]), (12, [0.0, -math.inf])]
    check(whitening.whiten(frame(spark, rows)).collect(), good, range(4), 2)
    assert whitening.whiten(frame(spark, [(None, [1.0, 0.0]), (None, [0.0, 1.0])])).count() == 2
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(frame(spark, none)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [3e38]), (2, [1.0])])).count()


def test_lobpcg_certifies_close_eigenvalues():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((120, 120)))[0]
    e = np.concatenate((np.full(3, 50.0), [49.999], np.linspace(40, 1, 116)))
    a = (q * e) @ q.T
    products = []
    values, vectors, norms = whitening.lobpcg(lambda b: products.append(b.shape) or a @ b, 120, 6)
    assert np.abs(values - np.sort(e)[::-1][:6]).max() < 1e-10 and norms.max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11
    assert max(m for _, m in products) <= 28 and len(products) < 80
