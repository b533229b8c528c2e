import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from stacklens.operators import outcomes as O

T0 = datetime(2024, 1, 1)


def test_ewma_equals_recurrence(spark):
    xs = [300.0, 180.0, 60.0, 120.0]
    df = spark.createDataFrame([(i, "docker", True, x, T0 + timedelta(hours=i)) for i, x in enumerate(xs)],
                               "outcome_id bigint, strategy string, success boolean, setup_time double, ts timestamp")
    avg = 0.0
    for x in xs:
        avg = (avg + x) / 2
    r = O.success_patterns_ewma(df).first()
    assert (r["count"], r["avg_setup_time"]) == (4, avg) and avg == 116.25


def test_ewma_over_many_slots_and_ties(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice("ab"), rnd.random() < 0.8, rnd.uniform(1, 900), T0 + timedelta(seconds=rnd.choice([0, 1, 2, 3599, 3600, 90000, i])))
            for i in range(3000)]
    df = spark.createDataFrame(data, "outcome_id bigint, strategy string, success boolean, setup_time double, ts timestamp")
    want = {}
    for i, s, ok, x, t in sorted(data, key=lambda r: (r[4], r[0])):
        if ok:
            n, avg = want.get(s, (0, 0.0))
            want[s] = (n + 1, (avg + x) / 2)
    got = {r["strategy"]: (r["count"], r["avg_setup_time"]) for r in O.success_patterns_ewma(df).collect()}
    assert {s: (n, round(v, 9)) for s, (n, v) in got.items()} == {s: (n, round(v, 9)) for s, (n, v) in want.items()}
    run = {r.outcome_id: (r.running_count, r.running_avg) for r in O.running_setup_time(df).collect()}
    for s in "ab":
        total = 0.0
        for n, (i, x) in enumerate(((r[0], r[3]) for r in sorted(data, key=lambda r: (r[4], r[0])) if r[1] == s and r[2]), 1):
            total += x
            assert run[i][0] == n and abs(run[i][1] - total / n) < 1e-6


def ttl_fold(times, ttl):
    stores = []
    for t in sorted(times):
        if not stores or t - stores[-1] >= ttl:
            stores.append(t)
    return stores


def test_cache_both_paths_equal_fold(spark):
    rnd = random.Random(11)
    data = [(k, T0 + timedelta(seconds=rnd.randint(0, 40000))) for k in "abc" for _ in range(150 if k == "a" else 20)]
    data += [("a", T0 + timedelta(seconds=5 * 3600 * 10)), ("b", T0), ("b", T0)]
    df = spark.createDataFrame(data, "cache_key string, ts timestamp")
    want = {(k, int((t - T0).total_seconds())) for k in "abc"
            for t in (T0 + timedelta(seconds=s) for s in ttl_fold([(x - T0).total_seconds() for kk, x in data if kk == k], 3600))}
    base = int(df.select(F.unix_micros(F.lit(T0).cast("timestamp"))).first()[0])
    for limit in (10**6, 0, 25):
        got = {(k, (us - base) // 1_000_000) for k, us in rows(O.cache_stores(df, 3600, fold_limit=limit))}
        assert got == want


def test_cache_ttl_bound_is_exclusive(spark):
    df = spark.createDataFrame([("k", T0), ("k", T0 + timedelta(seconds=3600))], "cache_key string, ts timestamp")
    r = O.cache_stats(df, 3600).first()
    assert (r["requests"], r["misses"], r["hits"], r["evictions"]) == (2, 2, 0, 1)


def test_latest_within_is_one_row_per_key(spark):
    df = spark.createDataFrame([(1, i, T0 + timedelta(days=i)) for i in range(5)], "repo_id bigint, outcome_id bigint, ts timestamp")
    now = F.lit(T0 + timedelta(days=10)).cast("timestamp")
    assert rows(O.latest_within(df, "repo_id", now, F.expr("interval 7 days")).select("outcome_id")) == [(4,)]
    assert O.latest_within(df, "repo_id", now, F.expr("interval 6 days"), inclusive=False).count() == 0


def test_sla_without_target_is_infinite(spark):
    df = spark.createDataFrame([("other", 1.0)], "agent string, duration double")
    assert O.sla_report(df).first()["worst_ratio"] == float("inf")


def test_advice_needs_data_and_all_six_rules_can_fire(spark):
    cols = ("total_analyses bigint, pattern_count bigint, success_rate double, model_accuracy double, learning_velocity double, "
            "storage_size_mb double, seconds_since_update bigint")
    empty = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 0)], cols)
    one = spark.createDataFrame([(5, 20, 0.5, 0.9, 0.1, 10.0, 60)], cols)
    every = spark.createDataFrame([(5, 2, 0.5, 0.5, 0.01, 1000.5, 604801)], cols)
    assert O.learning_advice(empty).count() == 0
    assert [r["rule"] for r in O.learning_advice(one).collect()] == [1]
    assert [r["rule"] for r in O.learning_advice(every).collect()] == [1, 2, 3, 4, 5, 6]


def test_accuracy_as_of_report_times(spark):
    models = spark.createDataFrame([("strategy_predictor", T0 + timedelta(days=d), a, 9) for d, a in ((1, 0.5), (3, 0.7))] +
                                   [("other", T0 + timedelta(days=2), 0.99, 1)], "name string, saved_at timestamp, accuracy double, feature_count bigint")
    times = spark.createDataFrame([(d, T0 + timedelta(days=d)) for d in range(5)], "d bigint, at timestamp")
    got = {r.d: (r.model_accuracy, r.feature_count) for r in O.accuracy_as_of(times, models).collect()}
    assert got == {0: (0.0, None), 1: (0.5, 9), 2: (0.5, 9), 3: (0.7, 9), 4: (0.7, 9)}
    outcomes = spark.createDataFrame([(1, T0 + timedelta(days=2, hours=5), True)], "outcome_id bigint, ts timestamp, success boolean")
    patterns = spark.createDataFrame([("p", 0.8)], "pattern_id string, confidence double")
    m = O.learning_metrics(outcomes, patterns, models).first()
    assert (m.model_accuracy, m.feedback_count, m.seconds_since_update) == (0.5, 1, 86400 + 5 * 3600)
