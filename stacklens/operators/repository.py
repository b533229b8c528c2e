"""Repository files: which file counts, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.functions import text as X
from stacklens.rules import fixed as R


def pick_files(files: DataFrame, candidates: list[str], mode: str = "first") -> DataFrame:
    """First existing candidate per repository, or all of them. Empty files do not count."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("path"))
    found = files.where(F.col("path").isin(candidates) & (F.length("content") > 0)) \
        .withColumn("rank", rank)
    if mode == "all":
        return found
    if mode != "first":
        raise ValueError("mode is 'first' or 'all'")
    cols = [c for c in found.columns if c != "repo_id"]
    return (found.groupBy("repo_id").agg(F.min_by(F.struct(*cols), "rank").alias("f"))
            .select("repo_id", "f.*"))


def pick_source_files(files: DataFrame, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Python files of each repository with their rank by path; all of them unless limits are given.

    With limits, the size filter runs before any content is shuffled, and the rank becomes a group limit.
    """
    small = files.where(F.col("path").endswith(".py"))
    if max_bytes is not None:
        small = small.where(F.col("size") < max_bytes)
    w = Window.partitionBy("repo_id").orderBy("path")
    ranked = small.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def parse_repo_url(urls: DataFrame, url: str = "url", host: str = "github.com") -> DataFrame:
    """Owner and name from http(s), ssh and short forms; null when the form is unknown."""
    h = host.replace(".", r"\.")
    u = F.regexp_replace(F.trim(F.col(url)), r"[?#].*$", "")  # the query and fragment are no part of a name
    forms = [rf"^https?://{h}/([^/]+)/([^/]+?)(?:\.git)?/?$",
             rf"^(?:[a-z+]+://)?(?:[^@/\s]+@)?(?:www\.)?{h}[/:]([^/]+)/([^/\s]+?)(?:\.git)?(?:/.*)?$",
             r"^([^/:\s]+)/([^/:\s]+?)(?:\.git)?$"]
    part = lambda g: F.coalesce(*[F.when(u.rlike(p), F.regexp_extract(u, p, g)) for p in forms])
    return urls.withColumn("owner", part(1)).withColumn("name", part(2)).withColumn(
        "repo_key", F.when(F.col("owner").isNotNull(), F.concat_ws("/", "owner", "name")))


def scan_dockerfiles(files: DataFrame) -> DataFrame:
    """Docker and compose flags per repository, with the base images of its Dockerfile."""
    docker = F.col("path") == "Dockerfile"
    agg = files.where(docker | F.col("path").isin(R.COMPOSE_FILES)).groupBy("repo_id").agg(
        F.bool_or(docker & (F.length("content") > 0)).alias("has_dockerfile"),
        F.bool_or(F.col("path").isin(R.COMPOSE_FILES) & (F.length("content") > 0)).alias("has_compose"),
        F.max(F.when(docker, X.base_images(F.col("content")))).alias("images"))
    return agg.select("repo_id", "has_dockerfile", "has_compose",
                      F.coalesce("images", F.expr("cast(array() as array<string>)")).alias("base_images"))


def scan_readme(files: DataFrame) -> DataFrame:
    """Findings of each repository's first readme."""
    picked = pick_files(files, R.README_FILES)
    return picked.select("repo_id", X.readme_findings(F.col("content")).alias("r")).select("repo_id", "r.*")


def scan_ci(files: DataFrame, compat: bool = False) -> DataFrame:
    """CI flags, Python versions and test commands per repository, sorted and distinct."""
    content, path = F.col("content"), F.col("path")
    workflow = pick_files(files, R.WORKFLOW_FILES)
    other = files.where(path.isin(".travis.yml", ".circleci/config.yml") & (F.length("content") > 0))
    cols = ["repo_id", "path", "content"]
    empty = F.expr("cast(array() as array<string>)")
    found = workflow.select(*cols).unionByName(other.select(*cols)).select(
        "repo_id", "path",
        F.when(path.isin(R.WORKFLOW_FILES), X.workflow_python_versions(content, compat))
        .when(path == ".travis.yml", X.travis_python_versions(content)).otherwise(empty).alias("v"),
        F.when(path.isin(R.WORKFLOW_FILES), X.workflow_test_commands(content)).otherwise(empty).alias("c"))
    # at most three files per repository remain here
    return found.groupBy("repo_id").agg(
        F.bool_or(path.isin(R.WORKFLOW_FILES)).alias("has_github_actions"),
        F.bool_or(path == ".travis.yml").alias("has_travis"),
        F.bool_or(path == ".circleci/config.yml").alias("has_circleci"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("python_versions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("test_commands"))


def merge_response_findings(readme: DataFrame, responses: DataFrame) -> DataFrame:
    """Text findings win; model responses fill gaps and add system requirements.

    A repository may have any number of responses, in the order of ``turn`` where that column is there: the first that
    names a Python version gives it, any of them may ask for a GPU, and their requirements follow each other.
    """
    turn = F.col("turn") if "turn" in responses.columns else F.lit(0)
    doc = responses.select("repo_id", turn.alias("turn"), F.from_json(
        "json_answer", "python_versions array<string>, gpu_requirements string, "
                       "system_requirements array<string>").alias("j"))
    said = F.lower("j.gpu_requirements")
    version = F.get("j.python_versions", 0)
    lists = F.when(F.size("j.system_requirements") > 0, F.struct("turn", F.col("j.system_requirements").alias("s")))
    found = doc.groupBy("repo_id").agg(
        F.min_by(version, F.when(version.isNotNull(), F.col("turn"))).alias("said_version"),
        F.bool_or(said.contains("required") | said.contains("cuda")).alias("said_gpu"),
        F.flatten(F.transform(F.array_sort(F.collect_list(lists)), lambda x: x["s"])).alias("said_requirements"))  # as long as the result's list
    empty = F.expr("cast(array() as array<string>)")
    return readme.join(found, "repo_id", "left").select(
        "repo_id", F.coalesce("python_version", "said_version").alias("python_version"), "cuda_mentioned",
        (F.col("gpu_required") | F.coalesce("said_gpu", F.lit(False))).alias("gpu_required"),
        "installation_commands", F.concat("system_requirements", F.coalesce("said_requirements", empty)).alias("system_requirements"))


def _replaced(df: DataFrame, failed: Column, defaults: dict[str, Column]) -> DataFrame:
    """Rows that failed take the defaults of the columns that have one."""
    return df.select(*(F.when(failed, defaults[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                       if c in defaults else F.col(c) for c in df.columns))


def with_fallbacks(analyses: DataFrame, error: str = "error", issues: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Failed analyses become the minimal valid row; returns (analyses, issue rows).

    Owner and name of a failed row come from its ``url`` where there is one. ``issues`` of repositories whose analysis
    failed are dropped; their one issue is the failure itself.
    """
    failed = F.col(error).isNotNull()
    link = r"^https://github\.com/([^/]+)/([^/]+)"
    from_url = lambda g: F.coalesce(F.nullif(F.regexp_extract("url", link, g), F.lit("")), F.lit("unknown")) \
        if "url" in analyses.columns else F.lit("unknown")
    none = F.lit(None)
    defaults = {"owner": from_url(1), "name": from_url(2), "description": none, "language": none, "stars": F.lit(0),
                "topics": F.array().cast("array<string>"), "dependencies_count": F.lit(0), "confidence_score": F.lit(0.0),
                "min_memory_gb": F.lit(0.0), "min_gpu_memory_gb": F.lit(0.0), "analysis_time": F.lit(0.0),
                "python_version_required": none, "cuda_version_required": none}
    out = _replaced(analyses, failed, defaults)
    rows = analyses.where(failed).select(
        "repo_id", F.lit("analysis_error").alias("type"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Analysis failed: "), F.col(error)).alias("message"),
        F.lit("analyzer").alias("component"), F.lit(None).cast("string").alias("suggested_fix"))
    if issues is not None:
        rows = issues.select(*rows.columns).join(analyses.where(failed).select("repo_id"), "repo_id", "left_anti").unionByName(rows)
    return out, rows


def system_fallbacks(systems: DataFrame, error: str = "error") -> DataFrame:
    """Systems that could not be probed become the minimal valid profile, without GPUs."""
    none = F.lit(None)
    defaults: dict[str, Column] = {
        "cpu_cores": F.lit(1), "memory_gb": F.lit(4.0), "architecture": F.lit("unknown"),
        "python_version": F.lit("unknown"), "platform": F.lit("unknown"), "gpu_count": F.lit(0), "gpu_name": none,
        "gpu_memory": none, "cuda_version": none, "pip_version": none, "conda_version": none, "docker_version": none,
        "git_version": none, "container_runtime": none, "compute_score": F.lit(0.0)}
    if "gpus" in systems.columns:
        defaults["gpus"] = F.array().cast(systems.schema["gpus"].dataType)
    return _replaced(systems, F.col(error).isNotNull(), defaults)


def needs_analysis(repos: DataFrame, analyses: DataFrame, now: Column, max_age_days: int = 7) -> DataFrame:
    """Repositories without an analysis that is at most ``max_age_days`` old (age test inclusive)."""
    fresh = analyses.where(F.col("ts") >= now - F.expr(f"interval {int(max_age_days)} days"))
    return repos.join(fresh.select("repo_id").distinct(), "repo_id", "left_anti")
