"""Nearest cases and similar repositories: exact top-k for every query row.

Both searches follow one plan. Equal rows collapse to one profile that carries its count and its
first k members, so copies never meet each other. Then thresholds fall: at each level a profile meets
all others that are at least that similar, through equality joins that only let those pairs through,
and only profiles that are still short of k go on to the next level. Nothing is capped: a profile
with few neighbours simply searches wider.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.rules import fixed as R
from stacklens.session import materialize

EPS = 1e-9
CASE_FEATURES = list(R.CASE_WEIGHTS)


def numeric_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.lit(1.0) - F.abs(a - b) / top)


def case_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    parts = [numeric_similarity(a[f].cast("double"), b[f].cast("double")) * w
             for f, w in R.CASE_WEIGHTS.items()]
    return F.round(reduce(lambda x, y: x + y, parts), 9)


def _members(df: DataFrame, key: list[str], id_col: str, k: int) -> DataFrame:
    """Per distinct ``key``: row count and the ``k`` smallest ids (map-side limited)."""
    w = Window.partitionBy(*key).orderBy(id_col)
    first = df.select(*key, id_col).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k) \
        .groupBy(*key).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    counts = df.groupBy(*key).agg(F.count("*").alias("members"))
    return first.join(counts, key)


def _digest(cols: list[str]) -> Column:
    """128 bits that stand for the values of some columns."""
    return F.md5(F.to_json(F.struct(*cols)))


def lowered(open_rows: DataFrame, key: str, levels: list[float], k: int, meet) -> DataFrame:
    """Pairs that hold each open row's ``k`` best: ``meet(rows, level)`` gives all pairs (key, other, similarity,
    members) of at least a level. A row whose partners count k members at a level is done, and only the others
    go on to the next, lower one; at the last level all are done.
    """
    found = None
    for level in levels:
        pairs = materialize(meet(open_rows, level))
        if level != levels[-1]:
            done = pairs.groupBy(key).agg(F.sum("members").alias("n")).where(F.col("n") >= k).select(key)
            open_rows = materialize(open_rows.join(done, key, "left_anti"))
            pairs = pairs.join(open_rows.select(key), key, "left_anti")
        found = pairs if found is None else found.unionByName(pairs)
        if level != levels[-1] and open_rows.isEmpty():
            break
    return found


#: Similarities at which open rows meet, from high to low; ``min_similarity`` is the last.
CASE_LEVELS = [1.0, 0.997, 0.98, 0.93, 0.8, 0.55]
#: Features that make a grid cell at a level, where the level bounds them at all.
GRID = ["ml_dependencies", "gpu_dependencies", "total_dependencies"]
FLAG = "is_ml_repo"
#: A feature whose similarity may fall below this is no part of the grid; rows of one block of a grid without cells.
LEAST_BOUND, GRIDLESS_BLOCK = 0.1, 4096
#: No cell is narrower: counts below fifty have cells of their own then.
LEAST_CELL = 0.02


def _scale(v: Column) -> Column:
    """A scale on which values of numeric similarity t or more differ by -ln(t) at most."""
    size = F.abs(v)
    return F.signum(v) * F.when(size < 1, size).otherwise(F.lit(1.0) + F.log(size))


def case_pairs(left: DataFrame, right: DataFrame, level: float) -> DataFrame:
    """(qid, rid, similarity, members) of all profile pairs of at least ``level``.

    A level leaves each feature a least similarity of its own, 1 - (1 - level) / weight. Cells of a grid are as
    wide as that allows, so partners are in the few cells that it reaches, mostly one at a high level, and both
    sides meet by an equality join on the cell. Higher levels have finer cells: a crowded cell of one level is many of another.
    """
    cell_l, cell_r = [], []
    for f in GRID:
        least = 1 - (1 - level) / R.CASE_WEIGHTS[f]
        if least >= LEAST_BOUND:
            reach = max(-math.log(least), 1e-9) * (1 + 1e-9)
            width = max(reach, LEAST_CELL)
            at = lambda side, by=0.0: F.floor((_scale(F.col(f"{side}_{f}")) + by) / width)  # noqa: E731, B023
            cell_l.append((f, F.explode(F.sequence(at("q", -reach), at("q", reach)))))
            cell_r.append((f, at("r")))
    if level > 1 - R.CASE_WEIGHTS[FLAG] + EPS:
        cell_l.append((FLAG, F.col(f"q_{FLAG}")))
        cell_r.append((FLAG, F.col(f"r_{FLAG}")))
    names = [f"at_{f}" for f, _ in cell_l]
    if not names:  # nothing bounds a partner: every block of records meets every open row
        blocks = max(1, math.ceil(right.count() / GRIDLESS_BLOCK))
        cell_l = [("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))]
        cell_r = [("block", F.pmod(F.hash("rid"), F.lit(blocks)))]
        names = ["at_block"]
    for (f, here), (_, there) in zip(cell_l, cell_r, strict=True):
        left, right = left.withColumn(f"at_{f}", here), right.withColumn(f"at_{f}", there)
    sim = case_similarity({f: F.col(f"q_{f}") for f in CASE_FEATURES}, {f: F.col(f"r_{f}") for f in CASE_FEATURES})
    return (left.join(right, names).withColumn("similarity", sim).where(F.col("similarity") >= level - EPS)
            .select("qid", "rid", "similarity", "members"))


def similar_cases(queries: DataFrame, records: DataFrame, k: int = 10,
                  min_similarity: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """The ``k`` most similar records above ``min_similarity`` for each query.

    ``queries`` has query_id and the six case features; ``records`` has record_id and the same
    features. Ties go to the smaller record_id. Returns query_id, record_id, similarity, rank and the columns
    ``carry`` of the records, which join each profile's few cases, before its queries multiply them.
    """
    feats = CASE_FEATURES
    norm = lambda df, i: df.select(i, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])
    q = norm(queries, "query_id").withColumn("qid", _digest(feats))
    # profile tables are the distinct feature combinations: written once, read in every round
    pr = materialize(_members(norm(records, "record_id"), feats, "record_id", k).withColumn("rid", _digest(feats)))
    left = materialize(q.select("qid", *[F.col(f).alias(f"q_{f}") for f in feats]).distinct())
    right = pr.select("rid", "members", *[F.col(f).alias(f"r_{f}") for f in feats])
    levels = [x for x in CASE_LEVELS if x > min_similarity] + [min_similarity]
    found = lowered(left, "qid", levels, k, lambda rows, level: case_pairs(rows, right, level)) \
        .where(F.col("similarity") > min_similarity)
    rank = Window.partitionBy("qid").orderBy(F.desc("similarity"), "record_id")
    top = found.join(pr.select("rid", "ids"), "rid").select("qid", "similarity", F.explode("ids").alias("record_id")) \
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    carry = carry or []
    if carry:
        top = top.join(records.select("record_id", *carry).hint("merge"), "record_id")
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct("rank", "record_id", "similarity", *carry))).alias("cases"))
    # queries and records grow with the input, however small their files are: neither is broadcast
    return (q.select("query_id", "qid").hint("merge").join(lists, "qid").select("query_id", F.explode("cases").alias("c"))
            .select("query_id", "c.record_id", "c.similarity", F.col("c.rank").cast("bigint").alias("rank"), *(f"c.{x}" for x in carry)))


# -- similar repositories ----------------------------------------------------------------------------
def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def _prefix(tokens: Column, sigma: Column) -> Column:
    """Rarest-first tokens of which one must occur in any set with Jaccard >= sigma (sigma > 0)."""
    need = F.greatest(F.ceil(sigma * F.size(tokens) - EPS), F.lit(1)).cast("int")
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - need + 1, F.lit(0)))


def _rarest_first(sigs: DataFrame, col: str) -> DataFrame:
    """Rewrites a set column so that rare tokens come first."""
    freq = sigs.select(F.explode(col).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ordered = (sigs.select("sid", F.explode(col).alias("token")).join(freq, "token")
               .groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))),
                                               lambda s: s["token"]).alias("_o")))
    return sigs.join(ordered, "sid", "left").withColumn(
        col, F.coalesce("_o", F.expr("cast(array() as array<string>)"))).drop("_o")


#: Mean Jaccards at which open repositories meet, from high to low; ``min_similarity`` is the last. Close together, as a
#: level brings a row all partners down to it.
REPO_LEVELS = [0.85, 0.8, 0.775, 0.75, 0.72, 0.7, 0.62, 0.55, 0.5, 0.3]
#: Sets of at most so many tokens meet by 3 or 2 common tokens at once, larger ones by one.
TUPLE_SIZES = {3: 7, 2: 11}


def _tuple_size(size: Column, least: float) -> Column:
    """How many common tokens make a key of sets that meet a set of ``size``; sets of Jaccard ``least`` share as many."""
    by_size = F.lit(1)
    for n in sorted(TUPLE_SIZES):
        by_size = F.when(size <= TUPLE_SIZES[n], n).otherwise(by_size)
    return F.greatest(F.least(by_size, F.ceil(F.lit(least) * size - EPS)), F.lit(1)).cast("int")


def _tuples(tokens: Column, n: Column) -> Column:
    """All tuples of ``n`` (1 to 3) tokens in the order of ``tokens``."""
    later = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    two = lambda x, rest: F.transform(rest, lambda y: F.array(x, y))
    pairs = F.flatten(F.transform(tokens, lambda x, i: two(x, later(i))))
    triples = F.flatten(F.transform(tokens, lambda x, i: F.flatten(F.transform(
        later(i), lambda y, j: F.transform(F.slice(tokens, i + j + 3, F.size(tokens)), lambda z: F.array(x, y, z))))))
    return F.when(n == 1, F.transform(tokens, lambda x: F.array(x))).when(n == 2, pairs).otherwise(triples)


def _both_pairs(left: DataFrame, right: DataFrame, topic_sets: DataFrame, level: float) -> DataFrame:
    """(sid, oid, similarity, first_id, members) of all different sets of at least ``level`` > 0.5, where both Jaccards are positive.

    The few topic sets that can still reach the level are found first; they leave the dependencies a least Jaccard and
    that, by both sizes, a least number of common tokens. Tokens stand in one order, so the first of the common ones are
    in a prefix of each side, and a tuple of them, with the topic set and the size, is the key by which sets meet. Only
    the first common tuple counts, so a pair is found once, and only pairs of the level leave the join.
    """
    least = 2 * level - 1  # what equal topics leave to the dependencies
    sigma = F.lit(least - EPS)
    want = left.select("tk", "t1").dropDuplicates(["tk"])
    other = topic_sets.select(F.col("tk").alias("tk2"), F.col("topics").alias("t2"), F.explode("topics").alias("tt"))
    near = want.withColumn("tt", F.explode(_prefix(F.col("t1"), sigma))).join(other, "tt") \
        .select("tk", "tk2", jaccard(F.col("t1"), F.col("t2")).alias("jt")).distinct().where(F.col("jt") >= sigma)
    near = materialize(near)  # its size is known then, and the open sets are not taken for the smaller side
    key = lambda topics, size, words: F.xxhash64(topics, size, words)  # noqa: E731  # equal for equal keys; others fail the test of the tuple
    n, m, need = F.size("d1"), F.col("m"), F.col("need")
    tuple_l = _tuple_size(m, least)
    common = F.ceil(need / (need + 1) * (n + m) - EPS).cast("int")
    mine = (left.select("sid", "tk", "d1").join(near, "tk").withColumn("need", F.lit(2 * level) - F.col("jt") - EPS).where(need <= 1)
            .withColumn("m", F.explode(F.sequence(F.greatest(F.ceil(need * n - EPS), F.lit(1)).cast("int"), F.floor(n / need + EPS).cast("int"))))
            .withColumn("common", F.greatest(common, tuple_l)).where((F.col("common") <= n) & (F.col("common") <= m))
            .withColumn("prefix", F.slice("d1", 1, n - F.col("common") + tuple_l)).withColumn("words", F.explode(_tuples(F.col("prefix"), tuple_l)))
            .select("sid", "d1", "jt", "words", key(F.col("tk2"), m, F.col("words")).alias("key")))
    size = F.size("d2")
    tuple_r = _tuple_size(size, least)
    least_r = F.greatest(F.ceil(F.lit(least) * size - EPS).cast("int"), tuple_r)
    theirs = (right.where(size > 0).withColumn("prefix", F.slice("d2", 1, size - least_r + tuple_r))
              .withColumn("w2", F.explode(_tuples(F.col("prefix"), tuple_r)))
              .select("oid", "d2", "first_id", "members", key(F.col("tk"), size, F.col("w2")).alias("key")))
    shared = F.array_intersect("d1", "d2")
    return (mine.join(theirs, "key").where((F.col("sid") != F.col("oid")) & (F.slice(shared, 1, F.size("words")) == F.col("words")))
            .select("sid", "oid", _mean(F.col("jt"), jaccard(F.col("d1"), F.col("d2"))).alias("similarity"), "first_id", "members")
            .where(F.col("similarity") >= level - EPS))


def _mean(a: Column, b: Column) -> Column:
    return F.round((a + b) / 2, 9)


def _either_pairs(left: DataFrame, right: DataFrame, level: float) -> DataFrame:
    """As ``_both_pairs``, at levels that one Jaccard alone may carry."""
    side = lambda a, b: left.withColumn("x", F.explode(_prefix(F.col(a), F.lit(level - EPS)))).select("sid", "x") \
        .join(right.select("oid", F.explode(b).alias("x")), "x")
    met = side("t1", "t2").unionByName(side("d1", "d2")).select("sid", "oid").where(F.col("sid") != F.col("oid")).distinct()
    return met.join(left.select("sid", "t1", "d1"), "sid").join(right.drop("tk"), "oid").select(
        "sid", "oid", _mean(jaccard(F.col("t1"), F.col("t2")), jaccard(F.col("d1"), F.col("d2"))).alias("similarity"), "first_id", "members") \
        .where(F.col("similarity") >= level - EPS)


def similar_repos(repos: DataFrame, k: int = 5, min_similarity: float = 0.1) -> DataFrame:
    """For each repository the ``k`` most similar others: mean of topic and dependency Jaccard.

    ``repos`` has repo_id, topics and deps (arrays of distinct names). Ties go to the smaller id.
    """
    base = repos.select("repo_id", F.array_sort(F.array_distinct("topics")).alias("topics"),
                        F.array_sort(F.array_distinct("deps")).alias("deps")) \
        .withColumn("sid", _digest(["topics", "deps"]))
    base = materialize(base)  # what its deps cost is paid once
    sets = base.groupBy("sid").agg(F.first("topics").alias("topics"), F.first("deps").alias("deps"))
    sigs = _members(base, ["sid"], "repo_id", k + 1).join(sets, "sid")
    sigs = materialize(_rarest_first(_rarest_first(sigs, "topics"), "deps").withColumn("tk", F.md5(F.to_json(F.array_sort("topics")))))
    topic_sets = materialize(sigs.select("tk", "topics").dropDuplicates(["tk"]))
    left = sigs.select("sid", "tk", F.col("topics").alias("t1"), F.col("deps").alias("d1"))
    right = sigs.select(F.col("sid").alias("oid"), "tk", F.col("topics").alias("t2"), F.col("deps").alias("d2"),
                        F.get("ids", F.lit(0)).alias("first_id"), "members")
    # copies: a set is as similar to itself as its sides are filled
    filled = (F.when(F.size("t1") > 0, 1.0).otherwise(0.0) + F.when(F.size("d1") > 0, 1.0).otherwise(0.0)) / 2
    counts = sigs.select("sid", F.get("ids", F.lit(0)).alias("first_id"), "members")
    # the k + 1 best members are members of the k + 1 best sets by similarity and first member
    best = Window.partitionBy("sid").orderBy(F.desc("similarity"), "first_id")

    def meet(rows: DataFrame, level: float) -> DataFrame:
        own = rows.join(counts, "sid").select("sid", F.col("sid").alias("oid"), filled.alias("similarity"), "first_id", "members") \
            .where(F.col("similarity") >= level - EPS)
        pairs = _both_pairs(rows, right, topic_sets, level) if level > 0.5 else _either_pairs(rows, right, level)
        return pairs.unionByName(own).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn", "first_id")

    levels = [x for x in REPO_LEVELS if x > min_similarity] + [min_similarity]
    # one more than k, as a repository is its own best
    found = lowered(left, "sid", levels, k + 1, meet).where(F.col("similarity") > min_similarity)
    rank = Window.partitionBy("sid").orderBy(F.desc("similarity"), "other_id")
    top = found.join(sigs.select(F.col("sid").alias("oid"), "ids"), "oid").select("sid", "similarity", F.explode("ids").alias("other_id")) \
        .withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k + 1)
    lists = top.groupBy("sid").agg(F.array_sort(F.collect_list(
        F.struct("rn", "other_id", "similarity"))).alias("top"))
    out = base.select("repo_id", "sid").join(lists, "sid") \
        .withColumn("top", F.slice(F.filter("top", lambda x: x["other_id"] != F.col("repo_id")), 1, k))
    return out.select("repo_id", F.posexplode("top").alias("pos", "c")).select(
        "repo_id", F.col("c.other_id").alias("other_id"), F.col("c.similarity").alias("similarity"),
        (F.col("pos") + 1).cast("bigint").alias("rank"))


def similar_repos_approx(repos: DataFrame, threshold: float = 0.5, tables: int = 4) -> DataFrame:
    """Approximate pairs by MinHash over topics and dependencies together (combined Jaccard)."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    tokens = repos.select("repo_id", F.concat(
        F.transform("topics", lambda t: F.concat(F.lit("t:"), t)),
        F.transform("deps", lambda t: F.concat(F.lit("d:"), t))).alias("tokens")).where(F.size("tokens") > 0)
    vec = HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 18, binary=True).transform(tokens)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=42).fit(vec)
    pairs = model.approxSimilarityJoin(vec, vec, 1.0 - threshold, "distance")
    return pairs.where("datasetA.repo_id < datasetB.repo_id").select(
        F.col("datasetA.repo_id").alias("repo_id"), F.col("datasetB.repo_id").alias("other_id"),
        (1.0 - F.col("distance")).alias("jaccard"))
