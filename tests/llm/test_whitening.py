"""Whitening against numpy on the distinct vectors, and odd rows."""
import numpy as np
import pytest

from stacklens.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, x string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def _check(got, rows, k=4, weights="one"):
    """Compare with a fit in numpy; rows are the usable (id, vector)."""
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    fit, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(fit), np.int64)
    n, s = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    y = fit - s / n
    v = (y * w[:, None]).T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in got.collect():
        by.setdefault(r.vec_id, []).append(r)
    flat = [r for rs in by.values() for r in rs]
    k = min(k, x.shape[1])
    assert len(flat) == k * len(rows) and {r.n for r in flat} == {n}
    assert len({r.identity_error for r in flat}) == 1 and flat[0].identity_error <= 1e-4
    signs = {}
    for (i, _), xi in zip(rows, x, strict=True):
        for r in by[i]:
            j = r.component - 1
            assert r.deviation == int((n * xi - s) @ (n * xi - s))
            assert r.explained == pytest.approx(e[j] / e.sum(), rel=1e-6)
            want = (xi - s / n) @ u[:, j] / np.sqrt(e[j])
            if abs(want) > 1e-6:
                assert signs.setdefault(j, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-8)


def test_against_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _check(whitening.op13_whitening(df), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("weights", ["one", "count"])
def test_common_vectors(spark, weights):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [5, 4, 3, 2, 1, .5]).tolist()) for i in range(1200)]
    rows += [(2000 + i, [0.1, 0.2, -0.3, 0.4, -0.0, 0.6]) for i in range(700)]  # a third of the rows
    got = whitening.whiten(_frame(spark, rows).repartition(5), weights=weights)
    _check(got, rows, weights=weights)


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (2, [0.5, -0.25]), (3, [1.0, 2.0]), (4, [-3.0, 0.001])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (9, []), (10, [1.0]), (11, [1.0, 2.0, 3.0])]
    _check(whitening.op13_whitening(_frame(spark, good + bad)), good)
    again = whitening.op13_whitening(_frame(spark, [*good, (1, [1.0, 2.0]), (None, [0.5, -0.25])]))
    assert again.where("vec_id = 1").count() == 4 and again.where("vec_id is null").count() == 2
    assert whitening.op13_whitening(_frame(spark, bad[:3])).count() == 0
    assert whitening.op13_whitening(_frame(spark, good).limit(0)).count() == 0


def test_no_variance_and_huge_values(spark):
    same = whitening.op13_whitening(_frame(spark, [(i, [1.0, 2.0, 3.0]) for i in range(3)])).collect()
    assert len(same) == 9 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.op13_whitening(_frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and line[0].identity_error < 1e-9
    huge = whitening.op13_whitening(_frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(huge) == 6 and {r.vec_id for r in huge if r.deviation is None} == {1, 2}
