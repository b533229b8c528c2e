"""Frequent sets and rules against plain counting of all subsets."""
import random
from itertools import combinations

from conftest import rows
from pyspark.sql import functions as F

from stacklens.operators import patterns as P

SETS = "items array<string>, n bigint"


def lattice(baskets, support):
    total = sum(n for _, n in baskets)
    counts = {}
    for items, n in baskets:
        names = sorted(set(items))
        for size in range(1, len(names) + 1):
            for c in combinations(names, size):
                counts[c] = counts.get(c, 0) + n
    least = max(1, int(total * support))
    return {c: n for c, n in counts.items() if n >= least}, total


def test_baskets_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def basket(i):
        seen.add(1)
        return ["abc"[i % 3], "xy"[i % 2]]
    sets = spark.range(60).select(F.udf(basket, "array<string>")("id").alias("items"), F.lit(1).cast("bigint").alias("n"))
    assert P.frequent_sets(sets, 0.1).count() == 11 and seen.value == 60


def test_frequent_sets_of_random_baskets(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    baskets = [(rnd.sample(words, rnd.randint(0, 7)) + (["w1", "w2", "w3"] if i % 3 == 0 else []), rnd.randint(1, 4)) for i in range(150)]
    baskets += [(["hot", "w0"], 5000)]  # one set with most of the baskets
    df = spark.createDataFrame(baskets, SETS)
    for support in (0.0, 0.004, 0.02, 0.5):
        want, total = lattice(baskets, support)
        got = {tuple(i): (size, n, s) for i, size, n, s in rows(P.frequent_sets(df, support))}
        assert got == {c: (len(c), n, n / total) for c, n in want.items()}


def test_rules_with_several_items_on_the_left(spark):
    rnd = random.Random(2)
    baskets = [(rnd.sample("abcdef", rnd.randint(1, 5)), 1) for _ in range(200)]
    want, total = lattice(baskets, 0.05)
    rules = {}
    for c, n in want.items():
        for x in c if len(c) > 1 else ():
            left = tuple(y for y in c if y != x)
            if n / want[left] >= 0.4:
                rules[left, x] = (round(n / total, 9), round(n / want[left], 9), round(n / want[left] / (want[x,] / total), 9))
    got = P.rules_of_sets(P.frequent_sets(spark.createDataFrame(baskets, SETS), 0.05), 0.4)
    assert {(tuple(a), x): tuple(round(v, 9) for v in rest) for a, x, *rest in rows(got)} == rules
    assert max(len(a) for a, _ in rules) >= 2


def test_no_baskets(spark):
    empty = spark.createDataFrame([], SETS)
    assert P.frequent_sets(empty).count() == 0 and P.rules_of_sets(P.frequent_sets(empty)).count() == 0
    assert P.frequent_sets(spark.createDataFrame([([], 3)], SETS)).count() == 0
