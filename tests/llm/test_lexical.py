"""Lexical search against scoring every document, with odd rows, ties, copies and several item blocks."""
import math
import re
from collections import Counter

from stacklens.llm import lexical

ITEMS = "item_id long, text string, rank int, doc_id string"


def _brute(docs, items, k):
    cut = lambda t: re.findall(lexical.TERM.pattern, (t or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))
    rows = [(i, Counter(w), len(w)) for i, w in ((i, cut(t)) for i, t in docs) if w]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(cut(t))
    out = {}
    for i, words in asked.items():
        scores = []
        for d, tf, size in rows:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words if tf[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        if scores:
            out[i] = [(r + 1, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(scores)[:k])]
    return out


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


def test_against_all_documents(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = lexical.op11_lexical(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    assert _got(got) == want and len(want) >= 40


def test_odd_rows_copies_and_ties(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(i, "Alpha beta ÄÖ9 alpha") for i in range(200, 100, -1)]
    rows += [(300 + i, "alpha " * i + "gamma") for i in range(1, 70)] + [(500, "naïve-NAÏVE\u0001x")]
    df = spark.createDataFrame([(i, t, "en", 1, 7) for i, t in rows], "doc_id long, text string, lang string, item_id int, score long")
    asked = [(1, "alpha Alpha BETA"), (2, None), (3, ""), (4, "no such word zzz"), (5, "gamma word 1"), (None, "idiot same"), (5, "äö9 naïve"),
             (6, "word " * 3000 + "one"), (7, "alpha"), (8, "Ä ÄÖ9")]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in asked], ITEMS)
    want = _brute(rows, asked, 20)
    got = _got(lexical.op11_lexical(df, items))
    assert got == {i: sorted(v, key=lambda x: x[0]) for i, v in want.items()}
    assert _got(lexical.search(df, items, k=3)) == {i: v[:3] for i, v in want.items()}


def test_items_in_several_blocks_and_shuffled_texts(spark, docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("item_id < 12")
    want = _got(lexical.op11_lexical(docs, items))
    monkeypatch.setattr(lexical, "ENTRIES", 60)
    monkeypatch.setattr(lexical, "FEW", 0)
    monkeypatch.setattr(lexical, "BLOCK", 16)
    assert _got(lexical.op11_lexical(docs.repartition(3), items)) == want


def test_nothing_to_search(spark, docs):
    items = spark.createDataFrame([(1, "a", 1, "x")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", docs.lang * 0).selectExpr("doc_id", "cast(null as string) as text"), items)):
        assert lexical.op11_lexical(d, i).collect() == []


def test_bounds_are_never_too_low(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "é"], rng.integers(1, 40), p=[.6, .2, .1, .05, .05])) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % i for i in range(300)]), pa.array(texts)], ["copy", "text"])
    names = ["a", "b", "c", "dd", "é"]
    monkeypatch.setattr(lexical, "CELLS", 200)
    query = {"h": lexical.term_hashes(names), "items": [(np.arange(5), np.array([3.0, 5, 7, 11, 13]))]}
    seen = 0
    for row in lexical._index([batch]):
        for width, n, copies, slices in lexical._blocks_of([row.select(["width", "n", "copies", "slices"])]):
            for _, at, ub in lexical._bounds(width, n, slices, query, (300, 5000)):
                for c, u in zip(copies[at:], ub, strict=False):
                    tf = Counter(texts[int(c)].split())
                    m = lexical.length_norm(sum(tf.values()), 300, 5000)
                    assert u >= sum(w * lexical.score(tf[t], m) for t, w in zip(names, [3, 5, 7, 11, 13], strict=True) if tf[t])
                    seen += 1
    assert seen == len(set(texts)) or seen == 300
