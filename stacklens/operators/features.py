"""Feature vectors of repositories, systems, resolutions and outcomes, and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.functions import versions as V
from stacklens.rules import fixed as R


def _opt(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def dependency_counts(deps: DataFrame) -> DataFrame:
    """Dependency counts per repository in one pass with map-side combine."""
    v, n, g = F.col("version"), F.col("name"), F.col("gpu_required")
    category = S.dependency_category(n, g)
    kinds = [F.max((category == k).cast("int")) for k in ("ml", "gpu", "test", "dev", "other")]
    distinct = kinds[0] + kinds[1] + kinds[2] + kinds[3] + kinds[4]
    return deps.groupBy("repo_id").agg(
        F.count("*").alias("total_dependencies"),
        F.count_if(g).alias("gpu_dependencies"),
        F.count_if(S.is_ml(n)).alias("ml_dependencies"),
        (distinct / F.count("*")).alias("dependency_diversity"),
        F.count_if(S.is_constrained(v)).alias("version_constraints"),
        F.count_if(S.is_pinned(v)).alias("pinned_versions"),
        F.max(F.when(g & n.isin(R.GPU_MEMORY_PACKAGES), 4.0).otherwise(0.0)).alias("min_gpu_memory_gb"))


def repository_features(repos: DataFrame, deps: DataFrame, issues: DataFrame | None = None,
                        cuda: DataFrame | None = None) -> DataFrame:
    """The 26 features of every repository. ``issues`` and ``cuda`` (recommended runtime per
    repository) are optional, so that callers that do not use them do not pay for them."""
    from stacklens.operators.conflicts import issue_counts

    out = repos.join(dependency_counts(deps), "repo_id", "left")
    if issues is not None:
        out = out.join(issue_counts(issues), "repo_id", "left")
    if cuda is not None:
        out = out.join(cuda.select("repo_id", "cuda_version_required"), "repo_id", "left")
    n = lambda c: _opt(out, c, 0).cast("bigint").alias(c)
    flag = lambda c: _opt(out, c, False).alias(c)
    num = lambda c: (V.version_number(F.col(c)) if c in out.columns else F.lit(0.0)).alias(c)
    topics = F.size("topics") if "topics" in out.columns else F.lit(0)
    return out.select(
        "repo_id", n("repo_size"), "language", flag("has_dockerfile"), flag("has_conda_env"),
        F.col("stars").cast("bigint").alias("star_count"), n("fork_count"),
        topics.cast("bigint").alias("topics_count"),
        n("total_dependencies"), n("gpu_dependencies"), n("ml_dependencies"),
        _opt(out, "dependency_diversity", 0.0).alias("dependency_diversity"),
        n("version_constraints"), n("pinned_versions"),
        n("critical_issues"), n("warning_issues"), n("gpu_issues"),
        n("cuda_version_conflicts"), n("python_version_conflicts"),
        num("python_version_required"), num("cuda_version_required"),
        _opt(out, "min_memory_gb", 0.0).alias("min_memory_gb"),
        _opt(out, "min_gpu_memory_gb", 0.0).alias("min_gpu_memory_gb"),
        (_opt(out, "ml_dependencies", 0) >= 2).alias("is_ml_repo"),
        S.is_research(F.col("name"), F.col("description")).alias("is_research_repo"),
        flag("has_tests"), flag("has_ci"))


def system_features(systems: DataFrame) -> DataFrame:
    """Eleven features per system from its hardware and software columns."""
    mem = F.transform("gpus", lambda g: g["memory_gb"])
    return systems.select(
        "system_id", F.col("cpu_cores").cast("bigint").alias("cpu_cores"), "memory_gb",
        F.size("gpus").cast("bigint").alias("gpu_count"),
        F.aggregate(mem, F.lit(0.0), lambda a, x: a + x).alias("gpu_memory_total"),
        F.coalesce(F.array_max(mem), F.lit(0.0)).alias("gpu_memory_max"),
        V.version_number(F.col("cuda_version")).alias("cuda_version"),
        V.version_number(F.col("python_version")).alias("python_version"),
        "container_runtime",
        S.compute_score(F.col("cpu_cores"), F.col("memory_gb"), F.col("gpus")).alias("compute_score"),
        S.has_nvidia(F.col("gpus")).alias("has_nvidia_gpu"),
        S.has_amd(F.col("gpus")).alias("has_amd_gpu"))


def resolution_features(resolutions: DataFrame) -> DataFrame:
    """Nine features of a resolution with ``strategy`` and its generated ``files``."""
    seconds = S.string_map({s[0]: s[2] for s in R.STRATEGIES})
    size = S.string_map({s[0]: s[3] for s in R.STRATEGIES})
    gpu = S.string_map({s[0]: s[4] for s in R.STRATEGIES})
    s = F.col("strategy")
    return resolutions.select(
        *[c for c in resolutions.columns if c not in ("strategy", "files")],
        s.alias("strategy_type"), F.size("files").cast("bigint").alias("files_generated"),
        F.lit(2).cast("bigint").alias("setup_commands"),
        size[s].cast("bigint").alias("estimated_size_mb"),
        seconds[s].cast("bigint").alias("estimated_setup_time"),
        F.coalesce(F.col("requires_gpu") if "requires_gpu" in resolutions.columns else gpu[s],
                   F.lit(False)).alias("gpu_capable"),
        S.base_image_type(F.col("files")).alias("docker_base_image"),
        S.compose_has_gpu(F.col("files")).alias("has_gpu_support"))


def learning_features(outcomes: DataFrame, features: DataFrame) -> DataFrame:
    """Learning features of each outcome joined to its repository's counts."""
    issues = F.col("critical_issues") + F.col("warning_issues")
    gpu = (F.col("gpu_dependencies") > 0) | (F.col("min_gpu_memory_gb") > 0)
    return (outcomes.join(features, "repo_id").select(
        "outcome_id", "repo_id", (F.lower("status") == "success").alias("success"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        S.categorize_error(F.col("error_message")).alias("error_type"),
        S.similarity_to_known(F.col("ml_dependencies"), F.col("gpu_dependencies"))
        .alias("similarity_to_known"),
        S.complexity_score(F.col("total_dependencies"), issues, gpu, F.col("version_constraints"))
        .alias("complexity_score")))


def training_records(outcomes: DataFrame, features: DataFrame, systems: DataFrame) -> DataFrame:
    """One nested record per outcome: repository, system and resolution features and the result.

    ``systems`` are system features with a ``repo_id``. Both sides grow with the repositories, so neither is broadcast.
    """
    repo_cols = [c for c in features.columns if c != "repo_id"]
    sys_cols = [c for c in systems.columns if c not in ("repo_id", "system_id")]
    rf = features.select("repo_id", F.struct(*repo_cols).alias("repository_features"))
    sf = systems.select("repo_id", F.struct(*sys_cols).alias("system_features"))
    err = S.categorize_error(F.col("error_message"))
    gpu_support = F.col("strategy").isin("docker") & (F.col("repository_features.gpu_dependencies") > 0)
    return (outcomes.join(rf.hint("merge"), "repo_id").join(sf.hint("merge"), "repo_id").select(
        F.col("outcome_id").alias("record_id"), "repo_id", "ts", "repository_features",
        "system_features",
        F.struct(F.col("strategy").alias("strategy_type"), F.col("setup_time"),
                 gpu_support.alias("has_gpu_support")).alias("resolution_features"),
        F.struct("success", "duration", err.alias("error_type")).alias("outcome")))


# -- dependency-model features -------------------------------------------------------------------
def dependency_model_features(deps: DataFrame) -> DataFrame:
    v, n = F.col("version"), F.lower("name")
    return deps.groupBy("repo_id").agg(
        F.count("*").alias("dependency_count"),
        F.count_if(n.isin(R.MODEL_ML_PACKAGES)).alias("ml_dependencies"),
        F.count_if("gpu_required").alias("gpu_dependencies"),
        F.count_if(S.is_constrained(v)).alias("version_constraints"),
        F.count_if(S.is_pinned(v)).alias("pinned_versions"),
        (F.count_if(S.is_constrained(v)) / F.count("*")).alias("constraint_ratio"))


def conflict_types(deps: DataFrame) -> DataFrame:
    """Conflict types a dependency list suggests, with the advised actions."""
    n = F.lower("name")
    frameworks = [F.max((n == f).cast("int")) for f in R.ML_FRAMEWORKS]
    total = frameworks[0] + frameworks[1] + frameworks[2] + frameworks[3]
    cuda_version = F.when(n.contains("cuda") & S.has_version(F.col("version")), F.col("version"))
    agg = deps.groupBy("repo_id").agg(
        total.alias("frameworks"), F.min(cuda_version).alias("lo"), F.max(cuda_version).alias("hi"))
    kinds = F.array_compact(F.array(
        F.when(F.col("frameworks") > 1, "ml_framework_conflict"),
        F.when(F.col("lo") < F.col("hi"), "cuda_version_conflict")))
    action = S.string_map(R.CONFLICT_ACTIONS)
    return (agg.withColumn("conflict_types", kinds).where(F.size("conflict_types") > 0)
            .select("repo_id", "conflict_types", F.transform(
                "conflict_types", lambda k: F.coalesce(action[k], F.lit(R.CONFLICT_ACTION_DEFAULT)))
                .alias("actions")))


# -- context projections ---------------------------------------------------------------------------
def resolution_context(summary: DataFrame, repos: DataFrame) -> DataFrame:
    """Analysis rows as the nested view that strategy selection reads."""
    r = repos.select("repo_id", "name", "owner", "language")
    return summary.join(r, "repo_id").select(
        "repo_id",
        F.struct("name", "owner", "language", "has_dockerfile", "has_conda_env").alias("repository"),
        F.struct(F.col("python_version_required").alias("python_version"), "min_gpu_memory_gb",
                 "gpu_required").alias("requirements"), "confidence_score")


def knowledge_context(outcomes: DataFrame, repos: DataFrame, summary: DataFrame,
                      issues: DataFrame) -> DataFrame:
    """Outcome rows as the flat view that the learning store reads."""
    from stacklens.operators.conflicts import issue_counts

    r = repos.select("repo_id", F.concat_ws("/", "owner", "name").alias("repository_key"))
    c = summary.select("repo_id", F.col("confidence_score").alias("analysis_confidence"))
    i = issue_counts(issues).select("repo_id", "issues_count", "critical_issues")
    return (outcomes.join(r, "repo_id").join(c, "repo_id", "left").join(i, "repo_id", "left")
            .select("outcome_id", "repository_key", F.col("strategy").alias("strategy_used"),
                    "success", "analysis_confidence",
                    F.coalesce("issues_count", F.lit(0)).alias("compatibility_issues_count"),
                    F.coalesce("critical_issues", F.lit(0)).alias("critical_issues_count")))


def analysis_context(systems: DataFrame) -> DataFrame:
    """System rows as the nested view that analysis reads."""
    caps = S.system_capabilities(F.col("gpus"), F.col("cuda_version"), F.col("container_runtime"))
    return systems.select("system_id", caps.alias("system_capabilities"),
                          F.struct("cpu_cores", "memory_gb", "architecture").alias("hardware"),
                          F.struct("python_version", "container_runtime").alias("software"))
