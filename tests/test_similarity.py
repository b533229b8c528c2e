import random
import re

from conftest import rows
from pyspark.sql import functions as F

from stacklens.operators import similarity as SIM
from stacklens.rules import fixed as R


def case_sim(a, b):
    total = 0.0
    for (_, w), x, y in zip(R.CASE_WEIGHTS.items(), a, b):
        total += w * (1.0 if x == 0 and y == 0 else 1 - abs(x - y) / max(abs(x), abs(y), 1))
    return round(total, 9)


def test_similar_cases_equal_brute_force(spark):
    rnd = random.Random(3)
    def profile():
        ml = rnd.choice([0, 0, 1, 2, 3, 9])
        return (ml, rnd.choice([0, 1, 2, 5]), ml + rnd.randint(0, 40), int(ml >= 2), rnd.choice([0.0, 3.8, 3.1, 3.9]), rnd.choice([0.0, 11.8, 12.1]))
    recs = [(i, *profile()) for i in range(300)]
    recs += [(1000 + i, *recs[0][1:]) for i in range(200)]  # a third of the rows are copies
    qs = [(i, *profile()) for i in range(60)] + [(99, 40, 30, 90, 1, 3.9, 12.1)]
    feats = ", ".join(f"{f} double" for f in R.CASE_WEIGHTS)
    f = lambda rs: [(r[0], *map(float, r[1:])) for r in rs]
    q = spark.createDataFrame(f(qs), f"query_id bigint, {feats}")
    r = spark.createDataFrame(f(recs), f"record_id bigint, {feats}")
    for k, bound in ((10, 0.3), (5, 0.2)):
        want = set()
        for qi in qs:
            best = sorted(((-case_sim(qi[1:], x[1:]), x[0]) for x in recs))
            want |= {(qi[0], rid, -s, n) for n, (s, rid) in enumerate([b for b in best if -b[0] > bound][:k], 1)}
        got = set(rows(SIM.similar_cases(q, r, k, bound).select("query_id", "record_id", "similarity", "rank")))
        assert got == want


def test_cases_carry_columns_and_no_large_side_is_broadcast(spark):
    """Few profiles, many copies: written small, they were taken for a small side and sent to the driver whole."""
    feats = [F.lit(1.0).alias(f) if f != "total_dependencies" else (F.col("id") % 5).cast("double").alias(f) for f in R.CASE_WEIGHTS]
    df = spark.range(2000).select(F.col("id").alias("record_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("strategy"), *feats)
    got = SIM.similar_cases(df.withColumnRenamed("record_id", "query_id"), df, 3, 0.3, ["strategy"])
    assert {(q, r, s) for q, r, s in rows(got.select("query_id", "record_id", "strategy"))} \
        == {(q, q % 5 + 5 * n, f"s{(q % 5 + 5 * n) % 7}") for q in range(2000) for n in range(3)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\w+Join \[qid", plan).group() == "SortMergeJoin [qid"  # the first is that of the queries


def test_scale_bounds_similarity():
    import math
    g = lambda v: math.copysign(abs(v) if abs(v) < 1 else 1 + math.log(abs(v)), v)
    rnd = random.Random(1)
    values = [0, 0.2, 0.999, 1, 1.001, 3.8, 3.9, 7, 40, -0.5, -2] + [rnd.uniform(-3, 50) for _ in range(60)]
    for a in values:
        for b in values:
            t = 1 if a == b == 0 else 1 - abs(a - b) / max(abs(a), abs(b), 1)
            assert t <= 0 or abs(g(a) - g(b)) <= -math.log(t) + 1e-12


def test_crowded_cell(spark, monkeypatch):
    """Nine tenths of the rows share (ML, GPU) counts and differ in what else they hold."""
    rnd = random.Random(9)
    recs = [(i, 3, 1, 5 + i // 4, 1, (3.8, 3.9, 3.1, 3.11)[i % 4], 11.8) for i in range(1800)]
    recs += [(i, rnd.randint(0, 9), rnd.randint(0, 4), rnd.randint(1, 60), i % 2, 3.8, 0.0) for i in range(1800, 2000)]
    feats = ", ".join(f"{f} double" for f in R.CASE_WEIGHTS)
    f = lambda rs: [(r[0], *map(float, r[1:])) for r in rs]
    qs = rnd.sample(recs, 40) + [(9999, 30, 20, 900, 1, 2.7, 9.0)]
    want = set()
    for qi in qs:
        best = sorted(((-case_sim(qi[1:], x[1:]), x[0]) for x in recs))
        want |= {(qi[0], rid, -s, n) for n, (s, rid) in enumerate([b for b in best if -b[0] > 0.3][:10], 1)}
    q, r = spark.createDataFrame(f(qs), f"query_id bigint, {feats}"), spark.createDataFrame(f(recs), f"record_id bigint, {feats}")
    assert set(rows(SIM.similar_cases(q, r).select("query_id", "record_id", "similarity", "rank"))) == want
    made, meet = [], SIM.case_pairs

    def counted(*args):
        out = meet(*args)
        made.append(out.count())
        return out
    monkeypatch.setattr(SIM, "case_pairs", counted)
    # pairs of all rounds grow with the rows and not with their square
    total = []
    for n in (400, 1600):
        made.clear()
        df = spark.createDataFrame(f(recs[:n]), f"record_id bigint, {feats}")
        SIM.similar_cases(df.withColumnRenamed("record_id", "query_id"), df).count()
        total.append(sum(made))
    assert total[1] <= 7 * total[0]


def jac(a, b):
    return len(a & b) / max(len(a | b), 1)


def test_similar_repos_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    data = []
    for i in range(120):
        topics = rnd.sample(["ml", "web", "cli", "gpu"], rnd.randint(0, 2)) + (["rare"] if i % 40 == 0 else [])
        data.append((i, topics, rnd.sample(words, rnd.randint(0, 5)) + (["numpy"] if i % 3 else [])))
    data += [(500 + i, data[1][1], data[1][2]) for i in range(60)]  # copies
    df = spark.createDataFrame(data, "repo_id bigint, topics array<string>, deps array<string>")
    want = set()
    for i, t, d in data:
        best = sorted((-round((jac(set(t), set(t2)) + jac(set(d), set(d2))) / 2, 9), j) for j, t2, d2 in data if j != i)
        want |= {(i, j, -s, n) for n, (s, j) in enumerate([b for b in best if -b[0] > 0.1][:5], 1)}
    got = set(rows(SIM.similar_repos(df).select("repo_id", "other_id", "similarity", "rank")))
    assert got == want


def test_similar_repos_meet_by_several_tokens(spark, monkeypatch):
    """Sets over few, evenly common words equal brute force, and no level brings a set more than its best k + 1."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(24)]
    data = [(i, rnd.sample(["ml", "web", "cli"], rnd.randint(1, 2)), rnd.sample(words, rnd.choice([1, 2, 4, 6, 7, 7, 7, 9, 13])))
            for i in range(400)]
    want = set()
    for i, t, d in data:
        best = sorted((-round((jac(set(t), set(t2)) + jac(set(d), set(d2))) / 2, 9), j) for j, t2, d2 in data if j != i)
        want |= {(i, j, -s, n) for n, (s, j) in enumerate([b for b in best if -b[0] > 0.1][:5], 1)}
    made, lowered = [], SIM.lowered

    def counted(rows_, key, levels, k, meet):
        def one(r, level):
            out = meet(r, level)
            made.append(out.groupBy(key).count().agg({"count": "max"}).first()[0] or 0)
            return out
        return lowered(rows_, key, levels, k, one)
    monkeypatch.setattr(SIM, "lowered", counted)
    df = spark.createDataFrame(data, "repo_id bigint, topics array<string>, deps array<string>")
    assert set(rows(SIM.similar_repos(df).select("repo_id", "other_id", "similarity", "rank"))) == want
    assert len(made) > 1 and max(made) <= 6


def test_minhash_finds_copies(spark):
    df = spark.createDataFrame([(1, ["a"], ["x", "y"]), (2, ["a"], ["x", "y"]), (3, ["b"], ["z"])],
                               "repo_id bigint, topics array<string>, deps array<string>")
    assert rows(SIM.similar_repos_approx(df).select("repo_id", "other_id")) == [(1, 2)]
