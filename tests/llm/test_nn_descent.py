"""Near-duplicate vectors against all pairs: links, components, dense groups, odd rows."""
import numpy as np

from stacklens.llm import nn_descent

SCHEMA = "vec_id long, embedding array<double>, e long, label string, c int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def _brute(rows, threshold=0.95):
    """Of rows (id, vector or None) in their order: links, smallest id of the component."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * len(rows)
    for a, b in zip(*np.nonzero(near), strict=True):
        links[ok[a]] += 1
        root[find(ok[a])] = find(ok[b])
    least = {}
    for i, (vid, _) in enumerate(rows):
        if vid is not None:
            least[find(i)] = min(vid, least.get(find(i), vid))
    return [(vid, links[i], least.get(find(i))) for i, (vid, _) in enumerate(rows)]


def _key(x):
    return tuple((v is None, v or 0) for v in x)


def _got(df):
    out = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=_key)


def _planted(n, d, seed):
    """Background, pairs of all similarities from 0.93 on, a chain, and a dense group."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def beside(v, cos):
        w = rng.normal(size=d)
        w -= (w @ v) * v / (v @ v)
        return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)
    more = [beside(x[i], c) for i, c in enumerate(np.linspace(0.93, 0.9999, 120))]
    chain = [x[200]]
    for _ in range(30):
        chain.append(beside(chain[-1] / np.linalg.norm(chain[-1]), 0.97))
    group = [beside(x[201], 0.99) for _ in range(150)]
    rows = [*x, *more, *chain[1:], *group]
    return [(int(i), (rng.uniform(0.1, 9) * v).tolist()) for i, v in zip(rng.permutation(len(rows)) * 3, rows, strict=True)]


def test_links_of_planted_vectors(spark):
    rows = _planted(3000, 32, 4)
    got = {r[0]: r for r in _got(nn_descent.near_vectors(_frame(spark, rows)))}
    want = {r[0]: r for r in _brute(rows)}
    assert set(got) == set(want) and all(got[i][1] <= want[i][1] for i in want)
    found, true = (sum(r[1] for r in x.values()) for x in (got, want))
    print("links", found, true)
    assert found >= 0.995 * true
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 4))
    rows = [(i, (base[i % 20] + rng.normal(size=4) * 0.05).tolist()) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(300 + i, rows[3][1]) for i in range(40)]  # repeated rows and copies
    rows += [(400, None), (None, rows[5][1]), (None, (np.array(rows[6][1]) * -1).tolist())]
    rows += [(500, (np.array(rows[9][1]) * 1e300).tolist()), (501, (np.array(rows[9][1]) * 1e-300).tolist())]
    scaled = [(i, v) for i, v in rows[:-2]] + [(500, rows[9][1]), (501, rows[9][1])]
    assert _got(nn_descent.op12_near_vectors(_frame(spark, rows))) == sorted(_brute(scaled), key=_key)


def test_cells_and_blocks_of_a_dense_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    angles = np.linspace(0, 2.5, 400)  # one long arc: many cells, all in one component
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)] + [(900 + i, [1.0, 0.0]) for i in range(5)]
    assert _got(nn_descent.op12_near_vectors(_frame(spark, rows))) == sorted(_brute(rows), key=_key)


def test_vectors_that_link_with_nothing(spark):
    bad = [None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.op12_near_vectors(_frame(spark, rows)).collect()}
    assert got == {i: (0, i, True) for i in range(8)} | {10: (1, 10, True), 11: (1, 10, False)}
    one = _frame(spark, rows[8:9])
    assert [(r.vec_id, r.n_links, r.kept) for r in nn_descent.op12_near_vectors(one).collect()] == [(10, 0, True)]
    assert nn_descent.op12_near_vectors(one.limit(0)).count() == 0
    assert nn_descent.op12_near_vectors(_frame(spark, rows[:3])).count() == 3


def test_audit_sees_what_is_missing(spark):
    rows = _planted(600, 16, 9)
    entries = _frame(spark, rows).selectExpr("vec_id as e", "1L as c", "embedding as v")
    none = entries.selectExpr("e", "0L as links").limit(0)
    assert nn_descent._audit(entries, none, 0.95) == 0.0
    links = {i: n for i, n, _ in _brute(rows)}
    half = spark.createDataFrame([(i, n) for i, n in links.items() if i % 2], "e long, links long")
    part = sum(n for i, n in links.items() if i % 2) / sum(links.values())
    assert abs(nn_descent._audit(entries, half, 0.95) - part) < 1e-9
