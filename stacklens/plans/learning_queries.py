"""Queries over outcomes, training records, patterns, quality rules, caches and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.operators import features as FE
from stacklens.operators import outcomes as O
from stacklens.operators import patterns as P
from stacklens.operators import quality as Q
from stacklens.operators import repository as RP
from stacklens.operators import similarity as SIM
from stacklens.operators import strategies as ST
from stacklens.plans.oracle_views import ERR6, ERR8, contains_any, q
from stacklens.plans.registry import query
from stacklens.rules import fixed as R
from stacklens.session import materialize
from stacklens.sources import tables as TB

NOW = "timestamp_ntz'2024-01-31 00:00:00'"
r6 = lambda *names: {n: F.round(n, 6) for n in names}

# -- features ---------------------------------------------------------------------------------------------
_RESEARCH = contains_any("lower(f.name || ' ' || coalesce(f.description, ''))", R.RESEARCH_KEYWORDS)
query("q_repo_features", f"""
WITH i AS (SELECT repo_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w,
  count(*) FILTER ({contains_any('lower(message)', ['gpu', 'cuda', 'nvidia', 'amd', 'rocm', 'opencl'])}) AS g,
  count(*) FILTER ({contains_any('lower(message)', ['cuda', 'nvidia'])} AND contains(lower(message), 'version')) AS k,
  count(*) FILTER ({contains_any('lower(message)', ['python', 'py'])} AND contains(lower(message), 'version')) AS p FROM v_issues GROUP BY 1)
SELECT f.repo_id, 0::BIGINT AS repo_size, f.language, f.has_dockerfile, false AS has_conda_env, f.stars AS star_count, 0::BIGINT AS fork_count, f.topics_count::BIGINT AS topics_count,
  f.total_dependencies, f.gpu_dependencies, f.ml_dependencies, round(f.dependency_diversity, 6) AS dependency_diversity, f.version_constraints, f.pinned_versions,
  coalesce(i.c, 0) AS critical_issues, coalesce(i.w, 0) AS warning_issues, coalesce(i.g, 0) AS gpu_issues, coalesce(i.k, 0) AS cuda_version_conflicts,
  coalesce(i.p, 0) AS python_version_conflicts, f.python_version_required, f.cuda_version_required, 0.0::DOUBLE AS min_memory_gb, f.min_gpu_memory_gb,
  f.is_ml_repo, {_RESEARCH} AS is_research_repo, false AS has_tests, false AS has_ci
FROM v_features f LEFT JOIN i ON f.repo_id = i.repo_id""")(
    lambda c: FE.repository_features(c.repos, c.stored_deps, c.issues, _recommended(c)).withColumns(r6("dependency_diversity")))


def _recommended(c):
    from stacklens.operators.conflicts import recommended_cuda
    return recommended_cuda(c.deps)


_FILES = """SELECT outcome_id, repo_id, strategy, 'Dockerfile' AS path, CASE outcome_id % 12 WHEN 0 THEN 'FROM nvidia/cuda:11.8' WHEN 4 THEN 'FROM python:3.10' WHEN 8 THEN 'FROM ubuntu:22.04' ELSE 'FROM alpine' END AS content FROM v_outcomes"""


def _resolutions(c):
    f = c.sql(_FILES)
    compose = F.when(F.col("outcome_id") % 5 == 0, F.array(F.struct(
        F.lit("out/docker-compose.yml").alias("path"), F.lit("deploy: nvidia").alias("content")))).otherwise(F.array())
    return f.select("outcome_id", "strategy", F.concat(F.array(F.struct("path", "content")), compose).alias("files"))


query("q_resolution_features", f"""
SELECT f.outcome_id, f.strategy AS strategy_type, (1 + CASE WHEN outcome_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS files_generated, 2::BIGINT AS setup_commands,
  s.size_mb::BIGINT AS estimated_size_mb, s.setup_seconds::BIGINT AS estimated_setup_time, f.strategy <> 'venv' AS gpu_capable,
  CASE WHEN contains(content, 'nvidia/cuda') THEN 'nvidia_cuda' WHEN contains(content, 'python') THEN 'python' WHEN contains(content, 'ubuntu') THEN 'ubuntu_debian' ELSE 'unknown' END AS docker_base_image,
  outcome_id % 5 = 0 AS has_gpu_support FROM ({_FILES}) f JOIN v_strategies s ON f.strategy = s.strategy""")(
    lambda c: FE.resolution_features(_resolutions(c)))
query("q_learning_features", f"""
WITH i AS (SELECT repo_id, count(*) FILTER (severity IN ('critical', 'warning')) AS n FROM v_issues GROUP BY 1)
SELECT o.outcome_id, o.repo_id, o.success, o.duration, {ERR8.format(m='o.error_message')} AS error_type,
  CASE WHEN f.ml_dependencies >= 3 AND f.gpu_dependencies >= 1 THEN 0.8 WHEN f.ml_dependencies >= 2 THEN 0.6 WHEN f.ml_dependencies >= 1 THEN 0.4 ELSE 0.2 END::DOUBLE AS similarity_to_known,
  round(least(least(f.total_dependencies / 50.0, 1.0) * 0.3 + least(coalesce(i.n, 0) / 20.0, 1.0) * 0.3 + CASE WHEN f.gpu_dependencies > 0 THEN 0.2 ELSE 0.0 END + least(f.version_constraints / 20.0, 1.0) * 0.2, 1.0)::DOUBLE, 6) AS complexity_score
FROM v_outcomes o JOIN v_features f ON o.repo_id = f.repo_id LEFT JOIN i ON o.repo_id = i.repo_id""")(
    lambda c: FE.learning_features(c.v_outcomes, FE.repository_features(c.repos, c.stored_deps, c.issues)).withColumns(r6("complexity_score")))
query("q_dependency_model_features", f"""
SELECT repo_id, count(*) AS dependency_count, count(*) FILTER (lower(name) IN ('torch', 'tensorflow', 'jax', 'keras')) AS ml_dependencies,
  count(*) FILTER (gpu_required) AS gpu_dependencies, count(*) FILTER (version IS NOT NULL) AS version_constraints, count(*) FILTER (version IS NOT NULL) AS pinned_versions,
  round(count(*) FILTER (version IS NOT NULL) / count(*), 6) AS constraint_ratio FROM v_dedup GROUP BY 1""")(
    lambda c: FE.dependency_model_features(c.deps).withColumns(r6("constraint_ratio")))
query("q_conflict_types", f"""
SELECT repo_id, 'ml_framework_conflict' AS conflict_types, {q(R.CONFLICT_ACTIONS['ml_framework_conflict'])} AS actions FROM v_dedup
WHERE lower(name) IN ('torch', 'tensorflow', 'jax', 'mxnet') GROUP BY 1 HAVING count(DISTINCT lower(name)) > 1""")(
    lambda c: FE.conflict_types(c.deps).select("repo_id", F.array_join("conflict_types", "|").alias("conflict_types"),
                                               F.array_join("actions", "|").alias("actions")))
query("q_training_records", """
SELECT record_id, repo_id, strategy, ml_dependencies, gpu_dependencies, total_dependencies, is_ml_repo, gpu_count, memory_gb, has_nvidia_gpu, has_gpu_support, success, error_type FROM v_records""")(
    lambda c: c.records.select(
        "record_id", "repo_id", F.col("resolution_features.strategy_type").alias("strategy"),
        *[F.col(f"repository_features.{n}") for n in ("ml_dependencies", "gpu_dependencies", "total_dependencies", "is_ml_repo")],
        *[F.col(f"system_features.{n}") for n in ("gpu_count", "memory_gb", "has_nvidia_gpu")],
        "resolution_features.has_gpu_support", "outcome.success", "outcome.error_type"))
query("q_knowledge_context", """
WITH i AS (SELECT repo_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM v_issues GROUP BY 1)
SELECT o.outcome_id, r.owner || '/' || r.name AS repository_key, o.strategy AS strategy_used, o.success, coalesce(i.n, 0) AS compatibility_issues_count, coalesce(i.c, 0) AS critical_issues_count
FROM v_outcomes o JOIN v_repos r ON o.repo_id = r.repo_id LEFT JOIN i ON o.repo_id = i.repo_id""")(
    lambda c: FE.knowledge_context(c.v_outcomes, c.v_repos, c.v_repos.select("repo_id", F.lit(0.5).alias("confidence_score")), c.issues)
    .drop("analysis_confidence"))
query("q_latest_vectors", """
SELECT r.repo_id, r.ml_dependencies, r.gpu_dependencies, r.total_dependencies, r.is_ml_repo, r.python_version_required, r.cuda_version_required, f.stars AS star_count, f.language,
  f.has_dockerfile, f.version_constraints, f.pinned_versions, f.min_gpu_memory_gb, round(f.dependency_diversity, 6) AS dependency_diversity, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS at, 26::BIGINT AS feature_count
FROM (SELECT * FROM v_records QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, record_id DESC) = 1) r JOIN v_features f ON r.repo_id = f.repo_id""")(
    lambda c: TB.latest_feature_vectors(c.records).select("repo_id", *(f"features.{n}" for n in (
        "ml_dependencies", "gpu_dependencies", "total_dependencies", "is_ml_repo", "python_version_required", "cuda_version_required", "star_count", "language",
        "has_dockerfile", "version_constraints", "pinned_versions", "min_gpu_memory_gb")), F.round("features.dependency_diversity", 6).alias("dependency_diversity"),
                                                          F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "feature_count"))
query("q_newest_records", "SELECT record_id, repo_id FROM v_records ORDER BY ts DESC, record_id DESC LIMIT 100")(
    lambda c: TB.newest(c.records, 100).select("record_id", "repo_id"))

# -- quality ------------------------------------------------------------------------------------------------
query("q_quality_issues", """
SELECT record_id, 'inconsistent_data' AS issue_type, 'medium' AS severity, 'Repository requires GPU but resolution doesn''t support it' AS description,
  'resolution_features.has_gpu_support' AS field, 'Verify GPU support configuration' AS suggested_fix FROM v_records WHERE gpu_dependencies > 0 AND NOT has_gpu_support""")(
    lambda c: Q.validate_records(c.records))
query("q_quality_summary", """
SELECT 'inconsistent_data' AS issue_type, 'medium' AS severity, count(*) AS count FROM v_records WHERE gpu_dependencies > 0 AND NOT has_gpu_support HAVING count(*) > 0""")(
    lambda c: Q.issue_summary(Q.validate_records(c.records)))
query("q_quality_advice", """
SELECT 'Consider implementing data validation pipeline' AS recommendation FROM v_records HAVING count(*) FILTER (gpu_dependencies > 0 AND NOT has_gpu_support) > count(*) * 0.1""")(
    lambda c: Q.quality_advice(Q.validate_records(c.records), c.records))
_VEC = """SELECT event_id, CAST(event_id % 1500 - 100 AS BIGINT) AS total_dependencies, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 140 END AS cpu_cores,
  CASE event_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(event_id % 1100 AS DOUBLE) END AS memory_gb,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE '  ' || event_type || ' ' END AS label FROM events"""
_f = lambda n: f"'Feature ''{n}'' has missing value'"
_issue = "issue_type, severity, description, field, suggested_fix"
query("q_vector_issues", f"""
WITH v AS ({_VEC})
SELECT event_id, {_issue} FROM (
 SELECT event_id, 'missing_value' AS issue_type, 'medium' AS severity, 'Feature ''' || n || ''' has missing value' AS description, n AS field, 'Provide default value for ''' || n || '''' AS suggested_fix
 FROM (SELECT event_id, 'cpu_cores' AS n FROM v WHERE cpu_cores IS NULL UNION ALL SELECT event_id, 'memory_gb' FROM v WHERE memory_gb IS NULL UNION ALL SELECT event_id, 'label' FROM v WHERE label IS NULL)
 UNION ALL SELECT event_id, 'outlier_value', 'low', 'Feature ''' || n || ''' value ' || x || ' is outside expected range [' || lo || ', ' || hi || ']', n, 'Verify if value ' || x || ' is correct for ''' || n || ''''
 FROM (SELECT event_id, 'total_dependencies' AS n, CAST(total_dependencies AS VARCHAR) AS x, 0 AS lo, 1000 AS hi FROM v WHERE total_dependencies < 0 OR total_dependencies > 1000
   UNION ALL SELECT event_id, 'cpu_cores', CAST(cpu_cores AS VARCHAR), 1, 128 FROM v WHERE cpu_cores < 1 OR cpu_cores > 128
   UNION ALL SELECT event_id, 'memory_gb', CASE WHEN isinf(memory_gb) THEN 'Infinity' ELSE CAST(memory_gb AS VARCHAR) END, 1, 1000 FROM v WHERE NOT isnan(memory_gb) AND (memory_gb < 1 OR memory_gb > 1000))
 UNION ALL SELECT event_id, 'invalid_numeric_value', 'high', 'Feature ''memory_gb'' has invalid numeric value: ' || CASE WHEN isnan(memory_gb) THEN 'NaN' ELSE 'Infinity' END, 'memory_gb', 'Replace invalid value with default for ''memory_gb''' FROM v WHERE isnan(memory_gb) OR isinf(memory_gb))""")(
    lambda c: Q.validate_feature_vectors(c.sql(_VEC), "event_id"))
query("q_clean_vectors", f"""
SELECT event_id, total_dependencies, coalesce(cpu_cores, 1) AS cpu_cores, CASE WHEN memory_gb IS NULL OR isnan(memory_gb) OR isinf(memory_gb) THEN 4.0 ELSE memory_gb END AS memory_gb,
  coalesce(trim(label), '0') AS label FROM ({_VEC})""")(
    lambda c: Q.clean_feature_vectors(c.sql(_VEC), "event_id"))
query("q_clean_records", """
SELECT doc_id, trim(regexp_replace(text, '[\\p{C}\\p{Zl}\\p{Zp}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS note,
  '3.' || CAST(doc_id % 9 AS VARCHAR) || '.1' AS python_version FROM documents""")(
    lambda c: Q.clean_records(c.table("documents").select(
        "doc_id", F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.struct(
            F.col("text").alias("note"), F.concat(F.lit("v3_"), (F.col("doc_id") % 9).cast("string"), F.lit("-1"))
            .alias("python_version")).alias("system_features")))
    .select("doc_id", F.trim("system_features.note").alias("note"), "system_features.python_version"))
_stat = lambda f, e: f"SELECT '{f}' AS field, count({e}) AS count, count(*) - count({e}) AS missing, count(DISTINCT {e}) AS \"unique\", CAST(min({e}) AS DOUBLE) AS min, CAST(max({e}) AS DOUBLE) AS max, round(avg({e}), 6) AS mean, round(stddev_pop({e}), 6) AS std FROM v_records"
query("q_quality_report", " UNION ALL ".join([
    _stat("repository_features_ml_dependencies", "ml_dependencies"), _stat("repository_features_total_dependencies", "total_dependencies"),
    _stat("repository_features_cuda_version_required", "cuda_version_required"), _stat("system_features_memory_gb", "memory_gb"),
    _stat("system_features_cpu_cores", "cpu_cores"), _stat("resolution_features_setup_time", "setup_time"), _stat("outcome_duration", "duration"),
    "SELECT 'outcome_error_type', count(error_type), count(*) - count(error_type), count(DISTINCT error_type), NULL, NULL, NULL, NULL FROM v_records"]))(
    lambda c: Q.field_statistics(c.records.select(
        F.struct("repository_features.ml_dependencies", "repository_features.total_dependencies", "repository_features.cuda_version_required").alias("repository_features"),
        F.struct("system_features.memory_gb", "system_features.cpu_cores").alias("system_features"),
        F.struct("resolution_features.setup_time").alias("resolution_features"),
        F.struct("outcome.duration", "outcome.error_type").alias("outcome"))).withColumns(r6("mean", "std")))
query("q_contracts", """
SELECT system_id, 'profile' AS contract, 'architecture' AS rule, 'Invalid architecture: sparc' AS message FROM v_systems WHERE architecture = 'sparc'
UNION ALL SELECT system_id, 'profile', 'python_version', 'Python version must be detected' FROM v_systems WHERE python_version = 'unknown'""")(
    lambda c: Q.check_contracts(c.systems.withColumn("compute_score", S.compute_score(
        F.col("cpu_cores"), F.col("memory_gb"), F.col("gpus"))), "profile", "system_id"))
query("q_dependency_contracts", "SELECT repo_id, 'dependency' AS contract, 'type' AS rule, 'Invalid dependency type: rpm' AS message FROM v_deps WHERE ord % 11 = 0")(
    lambda c: Q.check_contracts(c.v_deps.withColumn("dep_type", F.when(F.col("ord") % 11 == 0, "rpm").otherwise(F.col("dep_type"))), "dependency", "repo_id"))


_ANALYSES = """SELECT repo_id, CASE WHEN repo_id % 7 = 0 THEN '  ' ELSE name END AS name, owner, CASE WHEN repo_id % 11 = 0 THEN NULL ELSE url END AS url,
  CAST(CASE WHEN repo_id % 13 = 0 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS confidence_score, CAST(CASE WHEN repo_id % 17 = 0 THEN -1.0 ELSE 2.0 END AS DOUBLE) AS analysis_time FROM v_repos"""
_broken = lambda kind, id_col, rules: " UNION ALL ".join(
    f"SELECT {id_col}, '{kind}' AS contract, '{rule}' AS rule, {msg} AS message FROM x WHERE {when}" for rule, msg, when in rules)
query("q_analysis_contracts", f"WITH x AS ({_ANALYSES}) " + _broken("analysis", "repo_id", [
    ("name", "'Repository name is required'", "trim(name) = ''"), ("url", "'Repository URL is required'", "url IS NULL"),
    ("confidence", "'Invalid confidence score: 1.5'", "confidence_score > 1"), ("analysis_time", "'Invalid analysis time: -1.0'", "analysis_time < 0")]))(
    lambda c: Q.check_contracts(c.sql(_ANALYSES), "analysis", "repo_id"))
query("q_issue_contracts", """WITH x AS (SELECT repo_id, CASE WHEN repo_id % 5 = 0 AND severity = 'info' THEN 'fatal' ELSE severity END AS severity, message, CASE WHEN repo_id % 3 = 0 AND type = 'duplicate_dependency' THEN '' ELSE component END AS component FROM v_issues) """
      + _broken("issue", "repo_id", [("severity", "'Invalid severity: fatal'", "severity = 'fatal'"),
                                     ("component", "'Compatibility issue component is required'", "component = ''")]))(
    lambda c: Q.check_contracts(c.issues.withColumns({
        "severity": F.when((F.col("repo_id") % 5 == 0) & (F.col("severity") == "info"), "fatal").otherwise(F.col("severity")),
        "component": F.when((F.col("repo_id") % 3 == 0) & (F.col("type") == "duplicate_dependency"), "").otherwise(F.col("component"))}), "issue", "repo_id"))
_PLANS = """SELECT outcome_id, strategy, CASE WHEN outcome_id % 7 = 0 THEN '' ELSE 'Dockerfile' END AS path, CASE WHEN outcome_id % 11 = 0 THEN NULL ELSE 'FROM x' END AS content,
  CASE WHEN outcome_id % 13 = 0 THEN ' ' ELSE 'image' END AS description, CASE WHEN outcome_id % 17 = 0 THEN '  ' ELSE 'make' END AS command,
  CASE WHEN outcome_id % 19 = 0 THEN NULL ELSE 'run it' END AS instructions, CAST(outcome_id % 23 - 1 AS BIGINT) AS estimated_size_mb FROM v_outcomes"""
query("q_resolution_contracts", f"WITH x AS ({_PLANS}) " + _broken("resolution", "outcome_id", [
    ("strategy", "'Invalid strategy type: micromamba'", "strategy = 'micromamba'"), ("file_path", "'Generated file path is required'", "path = ''"),
    ("file_content", "'Generated file content is required'", "content IS NULL"), ("file_description", "'Generated file description is required'", "trim(description) = ''"),
    ("setup_commands", "'Setup command cannot be empty'", "trim(command) = ''"), ("instructions", "'Instructions are required'", "instructions IS NULL"),
    ("size", "'Invalid estimated size: -1'", "estimated_size_mb < 0")]))(
    lambda c: Q.check_contracts(c.sql(_PLANS).withColumns({
        "files": F.array(F.struct(F.lit("a.sh").alias("path"), F.lit("x").alias("content"), F.lit("script").alias("description")),
                         F.struct("path", "content", "description")),
        "setup_commands": F.array(F.lit("ls"), F.col("command"))}), "resolution", "outcome_id"))


def _fallback_inputs(c):
    return c.sql("""SELECT repo_id, url, owner, name, language, stars, stars AS dependencies_count, CAST(0.7 AS DOUBLE) AS confidence_score, python_version_required,
        CASE WHEN repo_id % 5 = 0 THEN 'fetch failed' END AS error FROM v_repos""")


_link = lambda g: f"coalesce(nullif(regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)', {g}), ''), 'unknown')"
query("q_fallbacks", f"""
SELECT repo_id, url, CASE WHEN repo_id % 5 = 0 THEN {_link(1)} ELSE owner END AS owner, CASE WHEN repo_id % 5 = 0 THEN {_link(2)} ELSE name END AS name,
  CASE WHEN repo_id % 5 <> 0 THEN language END AS language, CASE WHEN repo_id % 5 = 0 THEN 0 ELSE stars END AS stars,
  CASE WHEN repo_id % 5 = 0 THEN 0 ELSE stars END AS dependencies_count, CASE WHEN repo_id % 5 = 0 THEN 0.0 ELSE 0.7 END::DOUBLE AS confidence_score,
  CASE WHEN repo_id % 5 <> 0 THEN python_version_required END AS python_version_required FROM v_repos""")(
    lambda c: RP.with_fallbacks(_fallback_inputs(c))[0].drop("error"))
query("q_fallback_issues", """
SELECT repo_id, type, severity, message, component, suggested_fix FROM v_issues WHERE repo_id % 5 <> 0
UNION ALL SELECT repo_id, 'analysis_error', 'warning', 'Analysis failed: fetch failed', 'analyzer', NULL FROM v_repos WHERE repo_id % 5 = 0""")(
    lambda c: RP.with_fallbacks(_fallback_inputs(c), issues=c.issues)[1])
query("q_system_fallbacks", """
SELECT system_id, CASE WHEN system_id % 3 = 0 THEN 1 ELSE cpu_cores END AS cpu_cores, CASE WHEN system_id % 3 = 0 THEN 4.0 ELSE memory_gb END AS memory_gb,
  CASE WHEN system_id % 3 = 0 THEN 'unknown' ELSE architecture END AS architecture, CASE WHEN system_id % 3 = 0 THEN 'unknown' ELSE python_version END AS python_version,
  CASE WHEN system_id % 3 <> 0 THEN cuda_version END AS cuda_version, CASE WHEN system_id % 3 <> 0 THEN container_runtime END AS container_runtime,
  CASE WHEN system_id % 3 = 0 THEN 0 ELSE gpu_count END AS gpu_count, CASE WHEN system_id % 3 = 0 THEN 0 ELSE gpu_count END AS listed_gpus FROM v_systems""")(
    lambda c: RP.system_fallbacks(c.systems.withColumn("error", F.when(F.col("system_id") % 3 == 0, "no probe"))).select(
        "system_id", "cpu_cores", "memory_gb", "architecture", "python_version", "cuda_version", "container_runtime", "gpu_count",
        F.size("gpus").cast("bigint").alias("listed_gpus")))

# -- outcome statistics ------------------------------------------------------------------------------------------
query("q_ewma", """
SELECT strategy, max(n) AS count, round(sum(setup_time * pow(0.5, rn)), 6) AS avg_setup_time FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, outcome_id DESC) AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM v_outcomes WHERE success) GROUP BY 1""")(
    lambda c: O.success_patterns_ewma(c.v_outcomes).withColumns(r6("avg_setup_time")))
_GPU = "(SELECT repo_id, bool_or(gpu_required) AS gpu FROM v_dedup GROUP BY 1)"
query("q_success", f"""
SELECT o.strategy, count(*) AS count, round(avg(setup_time), 6) AS avg_setup_time, count(*) FILTER (g.gpu) AS gpu_successes, round(count(*) FILTER (g.gpu) / count(*), 6) AS gpu_success_rate
FROM v_outcomes o LEFT JOIN {_GPU} g ON o.repo_id = g.repo_id WHERE success GROUP BY 1""")(
    lambda c: O.success_patterns(c.v_outcomes, c.facts).withColumns(r6("avg_setup_time", "gpu_success_rate")))
query("q_success_dependencies", "SELECT o.strategy, lower(d.name) AS name, count(*) AS count FROM v_outcomes o JOIN v_dedup d ON o.repo_id = d.repo_id WHERE o.success GROUP BY 1, 2")(
    lambda c: O.success_dependencies(c.v_outcomes, c.deps))
_BAD = "(SELECT *, CASE WHEN error_message IS NULL OR error_message = '' THEN 'unknown_error' ELSE error_message END AS error FROM v_outcomes WHERE NOT success)"
query("q_failures", f"""
SELECT category, count, recency, repo_id, strategy, substr(error, 1, 200) AS error FROM (
  SELECT *, count(*) OVER (PARTITION BY category) AS count, row_number() OVER (PARTITION BY category ORDER BY ts DESC, outcome_id DESC) AS recency
  FROM (SELECT *, {ERR6.format(m='error')} AS category FROM {_BAD})) WHERE recency <= 10""")(
    lambda c: O.failure_patterns(c.v_outcomes))
query("q_failure_matrix", f"""
WITH e AS (SELECT o.*, {ERR8.format(m='error_message')} AS error_type FROM v_outcomes o WHERE NOT success)
SELECT strategy, e.error_type, count(*) AS count, count(DISTINCT repo_id) AS causes, coalesce(f.fix, {q(R.ERROR_FIX_DEFAULT)}) AS suggested_fix
FROM e LEFT JOIN v_fixes f ON e.error_type = f.error_type GROUP BY 1, 2, f.fix""")(
    lambda c: O.failure_matrix(O.failure_causes(c.v_outcomes, c.v_repos, FE.dependency_counts(c.deps))))
query("q_failure_causes", f"""
SELECT o.strategy, {ERR8.format(m='error_message')} AS error_type, 'Repo: ' || f.name || ', Dependencies: ' || CAST(f.total_dependencies AS VARCHAR) AS cause, count(*) AS n
FROM v_outcomes o JOIN v_features f ON o.repo_id = f.repo_id WHERE NOT o.success GROUP BY 1, 2, 3""")(
    lambda c: O.failure_causes(c.v_outcomes, c.v_repos, FE.dependency_counts(c.deps)))
query("q_failure_rollup", f"SELECT strategy, {ERR8.format(m='error_message')} AS error_type, count(*) AS count FROM v_outcomes WHERE NOT success GROUP BY ROLLUP (1, 2)")(
    lambda c: O.failure_rollup(c.v_outcomes))
query("q_running", """
SELECT outcome_id, strategy, count(*) OVER w AS running_count, round(avg(setup_time) OVER w, 6) AS running_avg FROM v_outcomes WHERE success
WINDOW w AS (PARTITION BY strategy ORDER BY ts, outcome_id ROWS UNBOUNDED PRECEDING)""")(
    lambda c: O.running_setup_time(c.v_outcomes).withColumns(r6("running_avg")))
query("q_first_last", """
SELECT strategy, arg_min(duration, (ts, outcome_id)) AS first_duration, arg_max(duration, (ts, outcome_id)) AS last_duration,
  round(arg_max(duration, (ts, outcome_id)) - arg_min(duration, (ts, outcome_id)), 6) AS change FROM v_outcomes GROUP BY 1""")(
    lambda c: O.first_last(c.v_outcomes).withColumns(r6("change")))
query("q_latest", """
SELECT repo_id, arg_max(outcome_id, (ts, outcome_id)) AS outcome_id, arg_max(strategy, (ts, outcome_id)) AS strategy FROM v_outcomes
WHERE success AND TIMESTAMP '2024-01-31 00:00:00' - ts <= INTERVAL 7 DAY GROUP BY 1""")(
    lambda c: O.latest_within(c.v_outcomes.where("success"), "repo_id", F.expr(NOW), F.expr("interval 7 days"))
    .select("repo_id", "outcome_id", "strategy"))
query("q_last_n", """
SELECT strategy, outcome_id, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, outcome_id DESC) AS rn FROM v_outcomes) WHERE rn <= 50""")(
    lambda c: O.last_n(c.v_outcomes, ["strategy"], [F.desc("ts"), F.desc("outcome_id")], 50).select("strategy", "outcome_id", F.col("rn").cast("bigint").alias("rn")))
query("q_expire", "SELECT outcome_id, repo_id FROM v_outcomes WHERE TIMESTAMP '2024-01-31 00:00:00' - ts < INTERVAL 20 DAY")(
    lambda c: O.expire(c.v_outcomes, F.expr(NOW), F.expr("interval 20 days"), inclusive=False)[0].select("outcome_id", "repo_id"))
query("q_expired_count", "SELECT count(*) AS removed FROM v_outcomes WHERE NOT (TIMESTAMP '2024-01-31 00:00:00' - ts <= INTERVAL 20 DAY)")(
    lambda c: O.expire(c.v_outcomes, F.expr(NOW), F.expr("interval 20 days"))[1])
query("q_current_outcomes", """
SELECT repo_id, success, substr(md5(strategy || '_' || url), 1, 8) AS solution_id, arg_max(outcome_id, (ts, outcome_id)) AS outcome_id
FROM (SELECT o.*, r.url FROM v_outcomes o JOIN v_repos r ON o.repo_id = r.repo_id) GROUP BY 1, 2, 3""")(
    lambda c: TB.current_outcomes(TB.with_solution_id(c.v_outcomes.join(c.v_repos.select("repo_id", "url"), "repo_id")))
    .select("repo_id", "success", "solution_id", "outcome_id"))
query("q_storage_stats", """
SELECT 'total_repos' AS name, count(DISTINCT repo_id) AS value FROM v_outcomes UNION ALL SELECT 'total_analyses', count(*) FROM v_outcomes
UNION ALL SELECT 'successful_solutions', count(*) FILTER (success) FROM v_outcomes UNION ALL SELECT 'failed_solutions', count(*) FILTER (NOT success) FROM v_outcomes
UNION ALL SELECT 'patterns', count(DISTINCT strategy) FROM v_outcomes""")(
    lambda c: TB.storage_stats(c.v_outcomes, c.v_outcomes, c.v_outcomes.select("strategy").distinct()))
query("q_cache_keys", """SELECT page_id, md5(url || '|[["page","' || CAST(page_id AS VARCHAR) || '"],["per","9"]]') AS key FROM pages""")(
    lambda c: c.table("pages").select("page_id", S.cache_key(F.col("url"), F.create_map(
        F.lit("per"), F.lit("9"), F.lit("page"), F.col("page_id").cast("string"))).alias("key")))

# -- patterns --------------------------------------------------------------------------------------------------------
def _newest_cases(c):
    rest = [x for x in c.stored_records.columns if x != "repo_id"]
    return c.stored_records.groupBy("repo_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "record_id")).alias("r")).select("repo_id", "r.*")


_rng = lambda f: f"'{f}_range=' || CAST(min({f}) AS VARCHAR) || '-' || CAST(max({f}) AS VARCHAR)"


def _group_sql(group: str, where: str) -> str:
    """Conditions, support and confidence of each group, from first principles."""
    return f"""
base AS (SELECT {group} AS grp, * FROM v_records WHERE {where}),
mode AS (SELECT grp, arg_max(strategy, n) AS s, max(n) AS n FROM (SELECT grp, strategy, count(*) AS n FROM base GROUP BY 1, 2) GROUP BY 1),
cond AS (SELECT b.grp, count(*) AS support,
    [{', '.join(_rng(f) for f in P.RANGE_FIELDS)}] AS ranges,
    avg(CAST(is_ml_repo AS INT)) >= 0.8 AS f1, avg(CAST(gpu_dependencies > 0 AS INT)) >= 0.8 AS f2, avg(CAST(has_nvidia_gpu AS INT)) >= 0.8 AS f3,
    avg(CAST(has_gpu_support AS INT)) >= 0.8 AS f4, CASE WHEN any_value(m.n) >= count(*) * 0.8 THEN any_value(m.s) END AS strat
  FROM base b JOIN mode m ON b.grp = m.grp GROUP BY 1),
conf AS (SELECT b.grp, avg(CASE WHEN 6 + CAST(f1 AND is_ml_repo AS INT) + CAST(f2 AND gpu_dependencies > 0 AS INT) + CAST(f3 AND has_nvidia_gpu AS INT) + CAST(f4 AND has_gpu_support AS INT) + CAST(coalesce(strategy = strat, false) AS INT)
      >= (6 + CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) + CAST(strat IS NOT NULL AS INT)) * 0.8 THEN 1 ELSE 0 END) AS confidence FROM base b JOIN cond c ON b.grp = c.grp GROUP BY 1),
pat AS (SELECT cond.grp, support, round(confidence, 6) AS confidence, array_to_string(list_sort(list_filter(ranges || [CASE WHEN f1 THEN 'is_ml_repo=true' END, CASE WHEN f2 THEN 'requires_gpu=true' END,
    CASE WHEN f3 THEN 'has_nvidia_gpu=true' END, CASE WHEN f4 THEN 'has_gpu_support=true' END, 'strategy_type=' || strat], lambda x: x IS NOT NULL)), ';') AS conditions
  FROM cond JOIN conf ON cond.grp = conf.grp WHERE support >= 2)"""


def _bucket_sql(case: str) -> str:
    return f"""
top AS (SELECT grp, arg_max(strategy, n) AS s, max(n) AS n, sum(n) AS support FROM (SELECT {case} AS grp, strategy, count(*) AS n FROM v_records WHERE success GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 2)"""


_DEP = "CASE WHEN ml_dependencies >= 3 AND gpu_dependencies >= 1 THEN 'complex_ml_gpu' WHEN ml_dependencies >= 2 THEN 'ml_heavy' WHEN gpu_dependencies >= 1 THEN 'gpu_required' WHEN total_dependencies >= 20 THEN 'many_dependencies' ELSE 'simple' END"
_SYS = "CASE WHEN gpu_count >= 1 AND memory_gb >= 16 THEN 'high_end_gpu' WHEN gpu_count >= 1 THEN 'gpu_available' WHEN memory_gb >= 16 AND cpu_cores >= 8 THEN 'high_end_cpu' ELSE 'standard' END"


def _flat(df):
    return df.select("pattern_id", "pattern_type", "description", "support", F.round("confidence", 6).alias("confidence"),
                     F.array_join(F.array_sort(F.transform(F.map_entries("conditions"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("conditions"),
                     F.array_join("recommendations", "|").alias("recommendations"))


_STRATEGY_SQL = f"""WITH {_group_sql('strategy', 'success')}
SELECT 'strategy_' || grp || '_success' AS pattern_id, 'strategy_success' AS pattern_type, 'Successful ' || grp || ' strategy patterns' AS description, support, confidence, conditions,
  'Consider ' || grp || ' strategy for similar cases' AS recommendations FROM pat"""
query("q_strategy_patterns", _STRATEGY_SQL)(lambda c: _flat(P.strategy_patterns(c.stored_records)))
_tipsql = "CASE grp " + " ".join(f"WHEN {q(k)} THEN {q('|'.join(v))}" for k, v in R.ERROR_TIPS.items()) + f" ELSE {q(R.ERROR_TIP_DEFAULT)} END"
_ERROR_SQL = f"""WITH {_group_sql('error_type', 'NOT success')}
SELECT 'error_' || grp AS pattern_id, 'error_pattern' AS pattern_type, 'Common characteristics of ' || grp || ' failures' AS description, support, confidence, conditions, {_tipsql} AS recommendations FROM pat"""
query("q_error_patterns", _ERROR_SQL)(lambda c: _flat(P.error_patterns(c.stored_records)))
_cap = "upper(s[1]) || s[2:]"
_bucket = lambda kind, pre, key, a, b, u, v, mc: f"""SELECT '{pre}_' || grp || '_' || s AS pattern_id, '{kind}' AS pattern_type, {_cap} || '{a}' || replace(grp, '_', ' ') || '{b}' AS description,
  CAST(support AS BIGINT) AS support, round(n / support, 6) AS confidence, array_to_string(list_sort(['{key}=' || grp, 'strategy=' || s]), ';') AS conditions, 'Use ' || s || '{u}' || replace(grp, '_', ' ') || '{v}' AS recommendations FROM top WHERE n / support >= {mc}"""
# four strategies of similar size: with the usual 0.7 no bucket has a dominant one, so 0.2 shows rows
_DEP_SQL = f"WITH {_bucket_sql(_DEP)} {_bucket('dependency_strategy', 'deps', 'dependency_type', ' strategy works well for ', ' repositories', ' strategy for ', ' repositories', 0.2)}"
_SYS_SQL = f"WITH {_bucket_sql(_SYS)} {_bucket('system_strategy', 'sys', 'system_type', ' strategy works well on ', ' systems', ' strategy on ', ' systems', 0.2)}"
query("q_dep_patterns", _DEP_SQL)(lambda c: _flat(P.dependency_patterns(c.records, 0.2)))
query("q_sys_patterns", _SYS_SQL)(lambda c: _flat(P.system_patterns(c.records, 0.2)))
_ALL_PATTERNS = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_STRATEGY_SQL, _DEP_SQL, _SYS_SQL, _ERROR_SQL))
query("q_discover_patterns", _ALL_PATTERNS)(lambda c: _flat(P.discover_patterns(c.stored_records, 0.2)))
_PATS = f"""{_group_sql('strategy', 'success')},
e_base AS (SELECT 1)"""
query("q_pattern_summary", f"""WITH {_group_sql('strategy', 'success')}
SELECT 'type' AS section, 'strategy_success' AS key, CAST(count(*) AS DOUBLE) AS value FROM pat
UNION ALL SELECT 'confidence', 'total', count(*) FROM pat UNION ALL SELECT 'confidence', 'mean', round(avg(confidence), 6) FROM pat
UNION ALL SELECT 'confidence', 'min', min(confidence) FROM pat UNION ALL SELECT 'confidence', 'max', max(confidence) FROM pat
UNION ALL (SELECT 'top', 'strategy_' || grp || '_success', support FROM pat ORDER BY support DESC, confidence DESC, grp LIMIT 5)""")(
    lambda c: P.pattern_summary(P.strategy_patterns(c.stored_records)).withColumns(r6("value")))
query("q_top_patterns", f"""WITH {_group_sql('strategy', 'success')}
SELECT 'strategy_' || grp || '_success' AS pattern_id, support, confidence FROM pat ORDER BY support DESC, confidence DESC, grp LIMIT 3""")(
    lambda c: P.top_patterns(P.strategy_patterns(c.stored_records), 3).select("pattern_id", "support", F.round("confidence", 6).alias("confidence")))
def _condition_sql(strategy: str | None = None, support: str | None = None) -> str:
    """Whether condition (k, v) holds; without a strategy, conditions on it hold."""
    ranges = " ".join(f"WHEN k = '{f}_range' THEN {f} BETWEEN CAST(split_part(v, '-', 1) AS DOUBLE) AND CAST(split_part(v, '-', 2) AS DOUBLE)" for f in P.RANGE_FIELDS)
    return f"""CASE {ranges} WHEN k = 'is_ml_repo' THEN is_ml_repo WHEN k = 'requires_gpu' THEN gpu_dependencies > 0 WHEN k = 'has_nvidia_gpu' THEN has_nvidia_gpu
  WHEN k = 'has_gpu_support' THEN {support or 'true'} WHEN k = 'dependency_type' THEN dep = v WHEN k = 'system_type' THEN sys = v
  WHEN k IN ('strategy', 'strategy_type') THEN {f'{strategy} = v' if strategy else 'true'} ELSE false END"""


# every condition of every pattern, one by one, against the features of the newest record of each repository
query("q_pattern_matches", f"""
WITH pats AS ({_ALL_PATTERNS}),
conds AS (SELECT pattern_id, confidence, unnest(string_split(conditions, ';')) AS cond FROM pats WHERE confidence > 0.2),
c AS (SELECT pattern_id, confidence, split_part(cond, '=', 1) AS k, split_part(cond, '=', 2) AS v FROM conds),
r AS (SELECT * FROM v_records QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, record_id DESC) = 1),
x AS (SELECT r.*, {_DEP} AS dep, {_SYS} AS sys FROM r),
m AS (SELECT x.repo_id, c.pattern_id, c.confidence, {_condition_sql('strategy', 'has_gpu_support')} AS ok FROM x, c)
SELECT repo_id, pattern_id, confidence FROM m GROUP BY 1, 2, 3 HAVING bool_and(coalesce(ok, false))""")(
    lambda c: P.match_patterns(_newest_cases(c), P.discover_patterns(c.stored_records, 0.2), 0.2).select("repo_id", "pattern_id", F.round("confidence", 6).alias("confidence")))
_ITEMS = """i AS (SELECT record_id, unnest(list_filter(['strategy:' || strategy, CASE WHEN is_ml_repo THEN 'repo_type:ml' END, CASE WHEN gpu_dependencies > 0 THEN 'repo:gpu_required' END,
  CASE WHEN gpu_count > 0 THEN 'system:has_gpu' END, CASE WHEN memory_gb >= 16 THEN 'system:high_memory' END], lambda x: x IS NOT NULL)) AS item FROM v_records WHERE success),
t AS (SELECT count(*) AS total FROM v_records WHERE success)"""
query("q_frequent_items", f"WITH {_ITEMS} SELECT item, count(*) AS count, round(count(*) / any_value(total), 6) AS support FROM i, t GROUP BY 1 HAVING count(*) >= floor(any_value(total) * 0.1)")(
    lambda c: P.frequent_items(P.successes(c.records)).withColumns(r6("support")))
# every subset of a record's items, by bit masks over the sorted list
_LATTICE = f"""{_ITEMS}, l AS (SELECT record_id, list(item ORDER BY item) AS items FROM i GROUP BY 1),
f AS (SELECT items, len(items) AS size, count(*) AS n FROM (
  SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (SELECT items, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS mask FROM l))
  GROUP BY 1 HAVING count(*) >= floor((SELECT total FROM t) * 0.1))"""
_joined = lambda df, name: df.withColumn(name, F.array_join(name, " & "))
query("q_frequent_sets", f"WITH {_LATTICE} SELECT array_to_string(items, ' & ') AS items, CAST(size AS INTEGER) AS size, n AS count, round(n / total, 6) AS support FROM f, t")(
    lambda c: _joined(P.frequent_sets(P.item_sets(P.successes(c.records)), 0.1), "items").withColumns(r6("support")))
query("q_rules", f"""WITH {_LATTICE},
p AS (SELECT list_filter(items, lambda x: x <> consequent) AS antecedent, consequent, n FROM (SELECT items, n, unnest(items) AS consequent FROM f WHERE size > 1))
SELECT array_to_string(p.antecedent, ' & ') AS antecedent, CAST(len(p.antecedent) AS INTEGER) AS size, p.consequent, round(p.n / total, 6) AS support, round(p.n / b.n, 6) AS confidence,
  round(p.n / b.n / (c.n / total), 6) AS lift FROM p JOIN f b ON b.items = p.antecedent JOIN f c ON c.items = [p.consequent], t WHERE p.n / b.n >= 0.5""")(
    lambda c: _joined(P.association_rules(P.successes(c.records), 0.1, 0.5).withColumn("size", F.size("antecedent")), "antecedent")
    .withColumns(r6("support", "confidence", "lift")))

# -- similar cases and recommendations ---------------------------------------------------------------------------------
_ps = lambda f, w: f"{w} * CASE WHEN q.{f} = 0 AND r.{f} = 0 THEN 1 ELSE 1 - abs(q.{f} - r.{f}) / greatest(abs(q.{f}), abs(r.{f}), 1) END"
_cols = list(R.CASE_WEIGHTS)
_num = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _cols)


def _case_sql(where: str, k: int, bound: float) -> str:
    return f"""
fq AS (SELECT repo_id AS query_id, {_num} FROM v_features), fr AS (SELECT record_id, strategy, success, {_num} FROM v_records WHERE {where}),
rp AS (SELECT {', '.join(_cols)}, list(record_id ORDER BY record_id)[1:{k}] AS ids FROM fr GROUP BY ALL), qp AS (SELECT DISTINCT {', '.join(_cols)} FROM fq),
pr AS (SELECT {', '.join('q.' + f for f in _cols)}, unnest(r.ids) AS record_id, round({' + '.join(_ps(f, w) for f, w in R.CASE_WEIGHTS.items())}, 9) AS similarity FROM qp q, rp r),
rk AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_cols)} ORDER BY similarity DESC, record_id) AS rank FROM pr WHERE similarity > {bound} QUALIFY rank <= {k}),
cases AS (SELECT fq.query_id, rk.record_id, rk.similarity, rk.rank, fr.strategy, fr.success FROM fq JOIN rk USING ({', '.join(_cols)}) JOIN fr USING (record_id))"""


def _records_flat(records, ok: bool):
    r = P.successes(records) if ok else records
    return r.select("record_id", F.col("resolution_features.strategy_type").alias("strategy"), "outcome.success",
                    *[F.col(f"repository_features.{f}").alias(f) for f in _cols])


def _cases(c, ok: bool = True, k: int = 10, bound: float = 0.3):
    records = FE.training_records(c.v_outcomes, c.stored_features, c.system_features)
    rec = materialize(_records_flat(records, ok))
    return SIM.similar_cases(c.stored_features.withColumnRenamed("repo_id", "query_id"), rec, k, bound, ["strategy", "success"])


query("q_similar_cases", f"WITH {_case_sql('success', 10, 0.3)} SELECT query_id, record_id, round(similarity, 6) AS similarity, rank, strategy FROM cases")(
    lambda c: _cases(c).select("query_id", "record_id", F.round("similarity", 6).alias("similarity"), "rank", "strategy"))
query("q_recommend", f"""WITH {_case_sql('success', 10, 0.3)}, g AS (SELECT query_id, strategy, count(*) AS similar_cases, least(avg(similarity), 0.95) AS p FROM cases GROUP BY 1, 2)
SELECT query_id, strategy, similar_cases, round(p, 6) AS success_probability, CASE WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM g""")(
    lambda c: O.recommend_from_cases(_cases(c)).withColumns(r6("success_probability")))
query("q_recommendation_confidence", f"""WITH {_case_sql('success', 10, 0.3)}
SELECT query_id, round(least(1.0, avg(similarity) * 0.7 + least(count(*) / 5.0, 1.0) * 0.3), 6) AS confidence FROM cases GROUP BY 1""")(
    lambda c: O.recommendation_confidence(_cases(c)).withColumns(r6("confidence")))
query("q_case_insights", f"""WITH {_case_sql('true', 5, 0.2)}
SELECT query_id, rank, strategy, round(similarity, 6) AS similarity, 'Similar repository successfully used ' || strategy || ' strategy' AS message, CASE WHEN similarity > 0.7 THEN 'high' ELSE 'medium' END AS confidence
FROM cases WHERE rank <= 3 AND success AND similarity >= 0.3""")(
    lambda c: O.case_insights(_cases(c, False, 5, 0.2)).withColumns(r6("similarity")))
# sets as bit masks over the package names; the six best of each distinct pair of sets, as one number of (distance, id)
query("q_similar_repos", """
WITH d AS (SELECT repo_id, CAST(bit_or(1 << CAST(v.idx AS INT)) AS BIGINT) AS dm FROM v_dedup x JOIN vocab v ON x.name = v.name GROUP BY 1),
p AS (SELECT r.repo_id, dm, CAST((1 << CAST(a.idx AS INT)) | (1 << CAST(b.idx AS INT)) AS BIGINT) AS tm FROM v_repos r JOIN d ON r.repo_id = d.repo_id JOIN vocab a ON a.name = r.topic1 JOIN vocab b ON b.name = r.topic2),
s AS (SELECT tm, dm, list(repo_id ORDER BY repo_id)[1:6] AS ids FROM p GROUP BY 1, 2),
m AS (SELECT a.tm, a.dm, b.ids, CAST(round((bit_count(a.tm & b.tm) / bit_count(a.tm | b.tm) + bit_count(a.dm & b.dm) / bit_count(a.dm | b.dm)) / 2, 9) * 1000000000 AS BIGINT) AS sim FROM s a, s b),
k AS (SELECT tm, dm, min((1000000000 - sim) * 100000000 + id, 6) AS best FROM (SELECT tm, dm, sim, unnest(ids) AS id FROM m WHERE sim > 100000000) GROUP BY 1, 2),
o AS (SELECT p.repo_id, list_filter(best, lambda x: x % 100000000 <> p.repo_id)[1:5] AS best FROM p JOIN k ON p.tm = k.tm AND p.dm = k.dm)
SELECT repo_id, best[rank] % 100000000 AS other_id, round((1000000000 - best[rank] // 100000000) / 1000000000, 6) AS similarity, rank
FROM (SELECT repo_id, best, unnest(range(1, len(best) + 1)) AS rank FROM o)""")(
    lambda c: SIM.similar_repos(c.repo_sets).withColumns(r6("similarity")))


def _merge_inputs(c):
    base = c.v_outcomes.groupBy("repo_id", "strategy").agg(F.avg(F.col("success").cast("double")).alias("success_probability"))
    base = base.withColumn("confidence", S.probability_label(F.col("success_probability"), "three"))
    model = c.v_repos.where("has_dockerfile").select("repo_id", F.explode(F.array(*[F.lit(s) for s in R.SCORED_STRATEGIES])).alias("strategy"),
                                                     F.lit(0.5).alias("success_probability"))
    return base, model.withColumn("confidence", S.probability_label(F.col("success_probability")))


query("q_merge", """
WITH b AS (SELECT repo_id, strategy, avg(CAST(success AS DOUBLE)) AS p FROM v_outcomes GROUP BY 1, 2), m AS (SELECT repo_id, unnest(['docker', 'conda', 'venv']) AS strategy FROM v_repos WHERE has_dockerfile)
SELECT coalesce(b.repo_id, m.repo_id) AS repo_id, coalesce(b.strategy, m.strategy) AS strategy, round(CASE WHEN m.repo_id IS NOT NULL THEN 0.5 ELSE p END, 6)::DOUBLE AS success_probability,
  CASE WHEN m.repo_id IS NOT NULL THEN 'low' WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN b.repo_id IS NOT NULL AND m.repo_id IS NOT NULL THEN 'ml_enhanced' WHEN m.repo_id IS NOT NULL THEN 'ml_only' ELSE 'base' END AS source
FROM b FULL JOIN m ON b.repo_id = m.repo_id AND b.strategy = m.strategy""")(
    lambda c: ST.merge_recommendations(*_merge_inputs(c)).withColumns(r6("success_probability")))
query("q_quality_score", """
SELECT doc_id, round(least(1.0, greatest(0.0, 0.5 + (doc_id % 4) * 0.05 + (doc_id % 3) * 0.03 - CASE WHEN quality = 0 THEN 0.09 ELSE 0.0 END)), 6)::DOUBLE AS score,
  CASE WHEN doc_id % 4 > 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS boosted FROM labels""")(
    lambda c: c.table("labels").select(
        "doc_id", F.round(S.quality_score(F.lit(0.5), F.col("doc_id") % 4, F.col("doc_id") % 3,
                                          F.when(F.col("quality") == 0, 0.9).otherwise(0.2)), 6).alias("score"),
        F.round(S.boosted_confidence(F.lit(0.5), F.col("doc_id") % 4), 6).alias("boosted")))

# -- learning metrics ----------------------------------------------------------------------------------------------------
_METRICS = f"""{_group_sql('strategy', 'success')},
dayr AS (SELECT CAST(ts AS DATE) AS day, avg(CAST(success AS INT)) AS r FROM v_outcomes GROUP BY 1),
met AS (SELECT (SELECT count(*) FROM v_outcomes) AS total_analyses, (SELECT avg(CAST(success AS INT)) FROM v_outcomes) AS success_rate, (SELECT arg_max(accuracy, saved_at) FROM v_models WHERE name = 'strategy_predictor') AS model_accuracy,
  1707955200 - (SELECT CAST(floor(epoch(max(saved_at))) AS BIGINT) FROM v_models WHERE name = 'strategy_predictor') AS seconds_since_update,
  (SELECT count(*) FROM pat) AS pattern_count, (SELECT greatest(0.0, arg_max(r, day) - arg_min(r, day)) FROM dayr) AS learning_velocity, (SELECT least(1.0, avg(confidence)) FROM pat) AS insight_quality)"""
REPORT_AT = "timestamp_ntz'2024-02-15 00:00:00'"
_metrics = lambda c: O.learning_metrics(c.v_outcomes, P.strategy_patterns(c.stored_records), c.v_models, TB.storage_size_mb(c.table("events")), F.expr(REPORT_AT))
query("q_metrics", f"""WITH {_METRICS}
SELECT total_analyses, round(success_rate, 6) AS success_rate, round(model_accuracy, 6) AS model_accuracy, total_analyses AS feedback_count, seconds_since_update, pattern_count, round(learning_velocity, 6) AS learning_velocity, round(insight_quality, 6) AS insight_quality,
  round(least(1.0, model_accuracy * 0.4 + success_rate * 0.4 + insight_quality * 0.2), 6) AS learning_confidence, least(1.0, total_analyses / 100.0)::DOUBLE AS pattern_discovery_rate,
  least(1.0, total_analyses / 50.0)::DOUBLE AS recommendation_quality, 1707955200 - seconds_since_update + 86400 AS next_retraining FROM met""")(
    lambda c: _metrics(c).drop("storage_size_mb").withColumns(r6("success_rate", "model_accuracy", "learning_velocity", "insight_quality", "learning_confidence")))
query("q_health", f"""WITH {_METRICS}, s AS (SELECT *, CAST(success_rate > 0.7 AS INT) + CAST(model_accuracy > 0.8 AS INT) + CAST(pattern_count > 5 AS INT) + CAST(learning_velocity > 0.05 AS INT) + 1 AS score FROM met)
SELECT CAST(score AS BIGINT) AS health_score, CASE WHEN score >= 4 THEN 'excellent' WHEN score >= 3 THEN 'good' ELSE 'needs_attention' END AS health_status, total_analyses, round(success_rate, 6) AS success_rate, pattern_count FROM s""")(
    lambda c: O.health_status(_metrics(c)).withColumns(r6("success_rate")))
_adv = " UNION ALL ".join(f"SELECT {i}::BIGINT AS rule, {q(t)} AS recommendation FROM met WHERE {m} {op} {b}" for i, (m, op, b, t) in enumerate(R.LEARNING_ADVICE, 1)
                          if m != "storage_size_mb")  # the tables' files are far below its bound of a gigabyte
query("q_recommendations", f"WITH {_METRICS} {_adv}")(lambda c: O.learning_advice(_metrics(c)))
query("q_trends", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS runs, avg(CAST(success AS INT)) AS r, max(ts) AS last FROM v_outcomes GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, runs, round(r, 6) AS success_rate, round(greatest(0.0, coalesce(r - lag(r) OVER (ORDER BY day), 0.0)), 6) AS learning_velocity,
  round(coalesce((SELECT arg_max(accuracy, saved_at) FROM v_models WHERE name = 'strategy_predictor' AND saved_at <= last), 0.0), 6) AS model_accuracy FROM d""")(
    lambda c: O.daily_trends(c.v_outcomes, c.v_models).withColumns(r6("success_rate", "learning_velocity", "model_accuracy")))
query("q_report", f"""WITH {_METRICS}
SELECT 'metrics' AS section, 'total_analyses' AS key, CAST(total_analyses AS DOUBLE) AS value FROM met UNION ALL SELECT 'metrics', 'success_rate', round(success_rate, 6) FROM met
UNION ALL SELECT 'metrics', 'model_accuracy', round(model_accuracy, 6) FROM met UNION ALL SELECT 'metrics', 'pattern_count', pattern_count FROM met UNION ALL SELECT 'metrics', 'learning_velocity', round(learning_velocity, 6) FROM met
UNION ALL SELECT 'metrics', 'insight_quality', round(insight_quality, 6) FROM met UNION ALL SELECT 'patterns', 'strategy_' || grp || '_success', confidence FROM pat UNION ALL SELECT 'insights', 'strategy_' || grp || '_success', confidence FROM pat
UNION ALL SELECT 'model', name || '.accuracy', round(arg_max(accuracy, saved_at), 6) FROM v_models GROUP BY name UNION ALL SELECT 'model', name || '.feature_count', arg_max(feature_count, saved_at) FROM v_models GROUP BY name
UNION ALL SELECT 'trends', CAST(day AS VARCHAR), round(r, 6) FROM dayr UNION ALL SELECT 'recommendations', recommendation, rule FROM ({_adv})""")(
    lambda c: O.learning_report(_metrics(c), P.strategy_patterns(c.stored_records), O.daily_trends(c.v_outcomes), O.learning_advice(_metrics(c)),
                                P.recent_insights(c.stored_records, P.strategy_patterns(c.stored_records), 20), c.v_models)
    .withColumns(r6("value")))

# -- caches and runs ------------------------------------------------------------------------------------------------------
_STORES = """
t AS (SELECT DISTINCT cache_key, epoch_us(ts) AS t FROM v_requests),
l AS (SELECT cache_key, list(t ORDER BY t) AS ts FROM t GROUP BY 1),
st AS (SELECT cache_key, list_reduce(list_transform(ts, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {ttl} THEN list_concat(acc, x) ELSE acc END) AS stores FROM l)"""
_STATS = f"""WITH {_STORES.format(ttl=3600 * 1000000)},
s AS (SELECT r.cache_key, count(*) AS requests, any_value(len(st.stores)) AS misses FROM v_requests r JOIN st ON r.cache_key = st.cache_key GROUP BY 1)"""
query("q_cache_stats", f"""{_STATS}
SELECT cache_key, requests, requests - misses AS hits, misses, round((requests - misses) / requests * 100, 6) AS hit_rate, misses - 1 AS evictions, requests - misses AS calls_saved FROM s""")(
    lambda c: O.cache_stats(c.v_requests).withColumns(r6("hit_rate")))
query("q_cache_stats_hot", f"""{_STATS}
SELECT cache_key, requests, requests - misses AS hits, misses, round((requests - misses) / requests * 100, 6) AS hit_rate, misses - 1 AS evictions, requests - misses AS calls_saved FROM s""")(
    lambda c: O.cache_stats(c.v_requests, fold_limit=12).withColumns(r6("hit_rate")))
query("q_cache_totals", f"""{_STATS}
SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(requests - misses) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(misses - 1) AS BIGINT) AS evictions,
  CAST(sum(requests - misses) AS BIGINT) AS calls_saved, round(sum(requests - misses) / sum(requests) * 100, 6) AS hit_rate, count(*) AS entries FROM s""")(
    lambda c: O.cache_totals(O.cache_stats(c.v_requests)).withColumns(r6("hit_rate")))
_T = "CASE agent WHEN 'profile_agent' THEN 2.0 WHEN 'analysis_agent' THEN 10.0 WHEN 'resolution_agent' THEN 5.0 ELSE 0.0 END::DOUBLE"
query("q_sla", f"""
SELECT agent, target, count(*) AS runs, count(*) FILTER (duration <= target) AS met, round(avg(duration), 6) AS avg_duration,
  CASE WHEN target > 0 THEN round(max(duration / target), 6) ELSE -1 END::DOUBLE AS worst_ratio FROM (SELECT *, {_T} AS target FROM v_runs) GROUP BY 1, 2""")(
    lambda c: O.sla_report(c.v_runs).drop("p95_duration").withColumns(r6("avg_duration", "worst_ratio"))
    .withColumn("worst_ratio", F.when(F.col("target") > 0, F.col("worst_ratio")).otherwise(-1.0)))
query("q_agent_health", """
WITH l AS (SELECT agent, arg_max(status, (ts, run_id)) AS status FROM v_runs GROUP BY 1)
SELECT agent, status, CASE WHEN (SELECT bool_or(status = 'unhealthy') FROM l) THEN 'unhealthy' WHEN (SELECT bool_or(status = 'degraded') FROM l) THEN 'degraded' ELSE 'healthy' END AS overall,
  (SELECT count(*) FROM l WHERE status = 'healthy') AS healthy, (SELECT count(*) FROM l WHERE status = 'degraded') AS degraded, (SELECT count(*) FROM l WHERE status = 'unhealthy') AS unhealthy FROM l""")(
    lambda c: O.health_rollup(c.v_runs))
query("q_rate_limits", """
SELECT event_id, 5000 - event_id % 5000 AS remaining, event_id % 5000 AS used, round((event_id % 5000) / 5000 * 100, 6) AS percentage_used,
  CASE WHEN 5000 - event_id % 5000 < 100 THEN 'CRITICAL' WHEN 5000 - event_id % 5000 < 500 THEN 'WARNING' ELSE 'OK' END AS status, 5000 - event_id % 5000 < 100 AS low FROM events""")(
    lambda c: O.rate_limits(c.table("events").select("event_id", (F.lit(5000) - F.col("event_id") % 5000).alias("remaining"),
                                                     F.lit(5000).alias("limit"))).drop("limit").withColumns(r6("percentage_used")))
