"""Nearest neighbours against brute force: recall of the approximate search, equality of the exact one."""
import random

import numpy as np

from stacklens.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def _brute(ids, x, step, k):
    out = {}
    s = x @ x.T
    for i, q in enumerate(ids):
        if q % step == 0:
            out[q] = sorted((-s[i, j], v) for j, v in enumerate(ids) if v != q)[:k]
    return out


def test_recall_and_scores(spark, docs):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.tolist(), np.array(rows.embedding.tolist(), float)
    want = _brute(ids, x, 20, 20)
    got = {}
    for r in ann.op4_ann(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) for q in want)
    print("recall", hits / sum(map(len, want.values())))
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - float(x[ids.index(q)] @ x[ids.index(v)])) < 1e-9 for _, v, s in found[:3])


def _odd(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 2.0]) for _ in range(4)], 1, "x") for i in range(0, 300)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], 1, "x") for i in range(300, 700)]  # many equal vectors
    rows += [(700, None, 1, "x"), (750, [0.0] * 4, 1, "x"), (800, [float("nan"), 1.0, 1.0, 1.0], 1, "x"), (850, [None, 1.0, 1.0, 1.0], 1, "x"),
             (900, [float("inf")] * 4, 1, "x"), (None, [1.0] * 4, 1, "x"), (950, [1.0], 1, "x"), (1000, [], 1, "x")]
    return spark.createDataFrame(rows, SCHEMA), [r for r in rows if r[0] is not None and r[0] < 700]


def test_odd_vectors(spark):
    df, ok = _odd(spark)
    ids, x = [r[0] for r in ok], np.array([r[1] for r in ok])
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0, mass=2.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _brute(ids, x, 20, 20)
    assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == {q: [(v, -s) for s, v in f] for q, f in want.items()}
    ids.append(750)
    want = _brute(ids, np.floor(256 * np.vstack([x, np.zeros(4)])), 50, 5)
    got = {}
    for r in topk.op5_topk(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == {q: [(v, int(-s)) for s, v in f] for q, f in want.items()}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op4_ann(df).collect()) == [
        (0, 1, 20, 5.0), (0, 2, 3, 2.5), (20, 1, 0, 5.0), (20, 2, 3, 2.5)]
    assert sorted((r["rank"], r.vec_id) for r in topk.op5_topk(df).collect()) == [(1, 20), (2, 3)]
    big = spark.createDataFrame([(0, [3e6]), (1, [1e6]), (2, [-1e6])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(big, lambda i: i == 0, k=1).collect()] == [(1, 768000000 * 256000000)]
    for op in (ann.op4_ann, topk.op5_topk):
        assert op(df.limit(0)).count() == 0 and op(df.where("vec_id = 3")).count() == 0


def test_ann_with_repeated_query_rows_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12, 3)).round(3)
    rows = [(i, x[i].tolist()) for i in range(12)] + [(0, x[0].tolist())] * 3  # a query row four times
    rows += [(20, x[3].tolist())] * 9 + [(21 + i, x[3].tolist()) for i in range(3)]  # ids of one vector, one of them often
    rows += [(1, x[5].tolist()), (1, x[6].tolist())]
    asked = {0: 3, 20: 3, 3: 3}
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i.isin(*asked), k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in asked:
        v = next(np.array(e) for i, e in rows if i == q)
        want = sorted((-float((np.array(e) * v).sum()), i) for i, e in rows if i != q)[:3]
        assert sorted(got[q]) == [(at + 1, i) for at, (_, i) in enumerate(want)]


def test_topk_with_repeated_query_rows_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(14, 3)).round(3)
    rows = [(i, x[i].tolist()) for i in range(12)] + [(0, x[0].tolist())] * 3 + [(0, x[12].tolist()), (3, x[13].tolist()), (5, x[6].tolist())]
    rows += [(20, x[2].tolist())] * 4
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    asked = {0, 3, 20}
    for order in (rows, rows[::-1]):
        got = {}
        for r in topk.search(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3), lambda i: i.isin(*asked), k=4).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in asked:
            own = {tuple(v) for i, v in ints if i == q}
            best = sorted((-int(np.dot(v, w)), i) for v in own for i, w in ints if i != q)[:4]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
