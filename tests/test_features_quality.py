from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.operators import features as FE
from stacklens.operators import quality as Q
from stacklens.operators import strategies as ST


def test_repository_features_golden(spark):
    deps = spark.createDataFrame([(1, "torch", ">=1.9.0", True), (1, "numpy", "1.21", False)],
                                 "repo_id bigint, name string, version string, gpu_required boolean")
    repos = spark.createDataFrame([(1, "demo", None, "Python", 100, ["a", "b"])],
                                  "repo_id bigint, name string, description string, language string, stars bigint, topics array<string>")
    r = FE.repository_features(repos, deps).first()
    assert (r["total_dependencies"], r["gpu_dependencies"], r["ml_dependencies"]) == (2, 1, 1)
    assert (r["is_ml_repo"], r["is_research_repo"], r["star_count"], r["topics_count"]) == (False, False, 100, 2)
    assert (r["version_constraints"], r["pinned_versions"], r["dependency_diversity"]) == (2, 1, 1.0)
    assert len(r) == 27


def test_scores(spark):
    one = spark.range(1)
    gpus = F.array(F.struct(F.lit("NVIDIA A").alias("name"), F.lit(10.0).alias("memory_gb")))
    assert one.select(S.compute_score(F.lit(8), F.lit(16.0), gpus)).first()[0] == 52
    assert one.select(S.confidence_score(F.lit(1), F.lit(True), F.lit(False), F.lit(True), F.lit("3.8"))).first()[0] == 0.4 + 0.2 + 0.0 + 0.1 + 0.1
    for msg, eight, six in [("CUDA oom", "gpu_error", "gpu_error"), ("compile stopped", "build_error", "unknown_error"),
                            (None, "no_error", "unknown_error"), ("Access denied", "permission_error", "permission_error")]:
        m = F.lit(msg).cast("string")
        assert rows(one.select(S.categorize_error(m), S.categorize_error(m, "six"))) == [(eight, six)]


def test_strategy_selection(spark):
    dep = "repo_id bigint, name string, version string, gpu_required boolean, dep_type string"
    deps = spark.createDataFrame([(1, "torch", None, True, "python"), (2, "flask", None, False, "python")], dep)
    facts = ST.strategy_facts(deps)
    cap = {(r["repo_id"], r["strategy"]) for r in ST.capable_strategies(facts).collect()}
    assert cap == {(1, "docker"), (1, "conda"), (1, "micromamba"), (2, "docker"), (2, "venv")}
    pick = lambda p: {r["repo_id"]: r["strategy"] for r in ST.select_strategy(facts, p).collect()}
    assert pick(None) == {1: "docker", 2: "docker"} and pick(F.lit("venv")) == {1: "docker", 2: "venv"}
    issues = spark.createDataFrame([(2, "system_dependency", "critical")], "repo_id bigint, type string, severity string")
    assert ("venv",) not in rows(ST.capable_strategies(ST.strategy_facts(deps, issues)).where("repo_id = 2").select("strategy"))


def test_clean_vector_passes_checks(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, None, float("nan"), None), (2, 5, inf, " a\tb "), (3, 7, 8.0, "ok")],
                               "id bigint, cpu_cores bigint, memory_gb double, label string")
    bad = {(r["id"], r["issue_type"]) for r in Q.validate_feature_vectors(df, "id").collect()}
    assert {(1, "missing_value"), (1, "invalid_numeric_value"), (2, "invalid_numeric_value")} <= bad
    clean = Q.clean_feature_vectors(df, "id")
    assert Q.validate_feature_vectors(clean, "id").count() == 0
    assert rows(clean.where("id < 3").orderBy("id")) == [(1, 1, 4.0, "0"), (2, 5, 4.0, "ab")]


def test_record_checks_and_cleaning(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), (-1, 2), ("v1_2", 1.5), (False,)), (2, None, (1, 0), None, (True,))],
                               "record_id bigint, ts timestamp, repository_features struct<star_count:bigint,gpu_dependencies:bigint>,"
                               "system_features struct<cuda_version:string,memory_gb:double>, resolution_features struct<has_gpu_support:boolean>")
    got = {(r["record_id"], r["issue_type"], r["field"]) for r in Q.validate_records(df).collect()}
    assert got == {(1, "invalid_value_range", "repository_features.star_count"),
                   (1, "inconsistent_data", "resolution_features.has_gpu_support"),
                   (2, "missing_required_field", "ts"), (2, "missing_required_field", "system_features")}
    clean = Q.clean_records(df, F.lit(datetime(2024, 2, 2)))
    assert clean.where("record_id = 1").select("system_features.cuda_version").first()[0] == "1.2"
    assert clean.where("ts IS NULL").count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([("s", 0, 4.0, "x86_64", "3.10", 5.0)],
                               "system_id string, cpu_cores bigint, memory_gb double, architecture string, python_version string, compute_score double")
    assert [r["rule"] for r in Q.check_contracts(df, "profile", "system_id").collect()] == ["cpu_cores"]


def test_presets(spark):
    df = ST.apply_preset(spark.createDataFrame([("production",), ("nope",)], "preset string"))
    a, b = df.collect()
    assert (a["strategy"], a["gpu_mode"], a["validation"], a["error"]) == ("docker", "strict", True, None)
    assert b["strategy"] is None and "nope" in b["error"]


def test_resolution_contract_names_every_broken_rule(spark):
    schema = ("id bigint, strategy string, files array<struct<path:string,content:string,description:string>>, setup_commands array<string>, "
              "instructions string, estimated_size_mb bigint")
    df = spark.createDataFrame([(1, "docker", [("a", "b", "c")], ["ls"], "go", 0), (2, "docker", [], [], "go", 5),
                                (3, "micromamba", [("a", "b", "c"), ("", None, " ")], ["ls", " "], " ", -1)], schema)
    got = [(r.id, r.rule) for r in Q.check_contracts(df, "resolution", "id").collect()]
    assert got == [(3, x) for x in ("strategy", "file_path", "file_content", "file_description", "setup_commands", "instructions", "size")]
