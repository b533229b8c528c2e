import random

from conftest import rows
from pyspark.sql import functions as F

from stacklens.functions import versions as V
from stacklens.operators import conflicts as C
from stacklens.operators import dependencies as D

DEP = "repo_id bigint, ord bigint, name string, version string, gpu_required boolean, dep_type string, source string"


def deps(spark, *pkgs, gpu=()):
    return spark.createDataFrame([(1, i, n, v, n in gpu, "python", "requirements.txt:L1") for i, (n, v) in enumerate(pkgs)], DEP)


def fold(items):
    kept = None
    for it in items:
        if kept is None or (it[1] and not kept[1]) or (it[2] and not kept[2]):
            kept = it
    return kept


def test_dedup_equals_ordered_fold(spark):
    rnd = random.Random(7)
    data, want = [], {}
    for repo in range(400):
        items = [(o, rnd.choice([None, "1.0", "2.0"]), rnd.random() < 0.4) for o in range(rnd.randint(1, 9))]
        want[repo] = fold(items)[0]
        data += [(repo, o, rnd.choice(["Pkg", "pkg"]), v, g, "python", "s") for o, v, g in items]
    df = spark.createDataFrame(data, DEP)
    got = D.dedup_dependencies(df)
    assert {r["repo_id"]: r["ord"] for r in got.collect()} == want
    again = D.dedup_dependencies(got.drop("first_ord"))
    assert {r["repo_id"]: r["ord"] for r in again.collect()} == want


def test_dedup_golden(spark):
    df = deps(spark, ("numpy", "1.20.0"), ("numpy", None), ("torch", None), ("torch", None), ("pandas", "1.3.0"))
    df = df.withColumn("gpu_required", F.col("ord") == 3)
    got = {r["name"]: (r["version"], r["gpu_required"]) for r in D.dedup_dependencies(df).collect()}
    assert got == {"numpy": ("1.20.0", False), "torch": (None, True), "pandas": ("1.3.0", False)}


def severities(spark, *pkgs):
    return [(r["package1"], r["package2"], r["severity"]) for r in C.pairwise_conflicts(deps(spark, *pkgs)).collect()]


def test_pairwise_golden(spark):
    assert severities(spark, ("torch", "2.0.0"), ("torchvision", "0.14.0")) == [("torch", "torchvision", "critical")]
    assert severities(spark, ("torch", "2.0.0"), ("torchvision", "0.15.0"), ("numpy", "1.24.3")) == []
    assert ("transformers", "torch", "critical") in severities(spark, ("transformers", ">=4.25.0"), ("torch", "==1.8.0"))


def test_cuda_support_and_order(spark):
    sys_ = spark.createDataFrame([(1, "10.2")], "repo_id bigint, cuda_version string")
    df = deps(spark, ("torch", "2.0.0"), ("tensorflow", "2.13.0"), ("scikit-learn", "1.3.0"))
    got = rows(C.prioritized_conflicts(df, sys_).select("priority", "package1", "conflict_type", "severity").orderBy("priority"))
    assert got == [(1, "tensorflow", "cuda", "critical"), (2, "torch", "cuda", "critical"),
                   (3, "tensorflow", "version", "warning"), (4, "scikit-learn", "version", "info")]


def test_cuda_range_golden(spark):
    df = deps(spark, ("torch", "2.0.0"))
    check = lambda cuda: C.cuda_range_check(df, spark.createDataFrame([(1, cuda)], "repo_id bigint, cuda_version string")).first()
    assert (check("11.8")["compatible"], check("11.8")["message"]) == (True, None)
    assert not check("10.2")["compatible"] and "requires CUDA >=" in check("10.2")["message"]


def test_recommended_and_multi(spark):
    both = deps(spark, ("torch", "2.0.0"), ("tensorflow", "2.17.0"))
    assert C.recommended_cuda(both).count() == 0
    assert C.multi_cuda_conflicts(both).count() == 1
    one = C.recommended_cuda(deps(spark, ("torch", "2.3.0"))).first()
    assert one["recommended"] == ["11.8", "12.1"] and one["cuda_version_required"] == "11.8"


def nearest(spark, version, metric):
    df = deps(spark, ("torch", version))
    return C.closest_version(df, C.SUPPORT if metric == "digits" else C.RANGES, metric).select("nearest.version").first()[0]


def test_closest_version_metrics(spark):
    assert nearest(spark, "2.0.9", "weighted") == "2.0.1"
    assert nearest(spark, "1.0", "weighted") == "1.12.1" or nearest(spark, "1.0", "weighted") == "1.12.0"
    assert nearest(spark, "^2.0", "weighted") is None and nearest(spark, "2.1.0rc1", "weighted") is None
    assert nearest(spark, "2.1.0rc1", "digits") is None      # parses, but has no digit form
    assert nearest(spark, "latest", "digits") == "2.0.0"     # does not parse: first table entry


def test_version_functions(spark):
    df = spark.createDataFrame([(">=1.9,<2", "2.10", "2.9"), ("~=1.2.3", "1.2", "1.2.0"), ("1.0", "x", "1")], "a string, b string, c string")
    got = rows(df.select(V.clean_version(F.col("a")), V.compare_versions(F.col("b"), F.col("c")), V.version_number(F.col("b")),
                         V.normalize_version(F.concat(F.lit("v"), "c"))))
    assert got == [("1.9", 1, 2.1, "2.9"), ("1.2.3", 0, 1.2, "1.2.0"), ("1.0", 0, 0.0, "1")]


def test_issues_scenario(spark):
    df = deps(spark, ("torch", "2.0.0"), ("torchvision", "0.14.0"), gpu=("torch",))
    raw = df.unionByName(deps(spark, ("torch", "1.8.0")))
    sys_ = spark.createDataFrame([(1, None)], "repo_id bigint, cuda_version string")
    docs = spark.createDataFrame([(1, False)], "repo_id bigint, cuda_mentioned boolean")
    got = sorted(r["type"] for r in C.detect_issues(df, raw, sys_, docs).collect())
    assert got == ["cuda_recommendation", "duplicate_dependency", "gpu_requirement", "version"]


def test_plan_has_no_nested_loop(spark, ctx):
    plan = ctx.issues._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
