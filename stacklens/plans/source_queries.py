"""Sources and sinks: each query writes a derived table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklens.functions import scalars as S
from stacklens.operators import conflicts as C
from stacklens.operators import features as FE
from stacklens.operators import patterns as P
from stacklens.plans.learning_queries import _group_sql
from stacklens.plans.registry import query
from stacklens.session import shared_dir
from stacklens.sources import tables as TB


def _written(c, df, write):
    path = shared_dir(c.spark)
    write(df, path)
    return path


def _analyses(c):
    rows = c.sql("SELECT repo_id, ts, strategy, duration FROM v_outcomes")
    back = c.spark.read.parquet(_written(c, rows, TB.write_analyses))
    return back.select("repo_id", "strategy", F.date_format("day", "yyyy-MM-dd").alias("day"), F.length("commit_hash").cast("bigint").alias("hash_chars"))


query("q_write_analyses", "SELECT repo_id, strategy, strftime(ts, '%Y-%m-%d') AS day, 12::BIGINT AS hash_chars FROM v_outcomes")(_analyses)


def _outcomes(c):
    rows = c.v_outcomes.join(c.v_repos.select("repo_id", "url"), "repo_id")
    back = TB.read_outcomes(c.spark, _written(c, rows, TB.write_outcomes))
    return back.groupBy("success").agg(F.count("*").alias("n"), F.count_distinct("solution_id").alias("solutions"))


query("q_write_outcomes", """
SELECT success, count(*) AS n, count(DISTINCT substr(md5(strategy || '_' || url), 1, 8)) AS solutions FROM v_outcomes o JOIN v_repos r ON o.repo_id = r.repo_id GROUP BY 1""")(_outcomes)


def _training(c):
    path = _written(c, c.records, TB.append_training_records)
    return TB.read_training_records(c.spark, path, 50).select("record_id", "outcome.success")


query("q_stored_training", "SELECT record_id, success FROM v_records ORDER BY ts DESC, record_id DESC LIMIT 50")(_training)


def _patterns(c):
    path = _written(c, P.strategy_patterns(c.stored_records), TB.write_patterns)
    return TB.read_patterns(c.spark, path, "docker").select("pattern_id", "support", F.round("confidence", 6).alias("confidence"))


query("q_stored_patterns", f"WITH {_group_sql('strategy', 'success')} SELECT 'strategy_' || grp || '_success' AS pattern_id, support, confidence FROM pat WHERE grp = 'docker'")(_patterns)


def _csv(c):
    path = _written(c, c.records, TB.export_csv)
    back = c.spark.read.option("header", True).csv(path)
    return back.select(F.col("record_id").cast("bigint").alias("record_id"),
                       F.col("repository_features_ml_dependencies").cast("bigint").alias("ml_dependencies"),
                       F.col("outcome_error_type").alias("error_type"))


query("q_export_csv", "SELECT record_id, ml_dependencies, error_type FROM v_records")(_csv)
_JSON = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", T.LongType())])


def _json(c):
    lines = c.sql("""SELECT CASE WHEN event_id % 10 = 0 THEN '{"k": broken' ELSE '{"id": ' || CAST(event_id AS VARCHAR(20)) || ', "k": ' || regexp_extract(props, '[0-9]+', 0) || '}' END AS value FROM events""")
    path = _written(c, lines, lambda df, p: df.write.text(p))
    good, bad = TB.read_json_tolerant(c.spark, path, _JSON)
    n = bad.select("corrupt").scalar()
    return good.groupBy().agg(F.count("*").alias("good"), F.sum("k").cast("bigint").alias("total")).withColumn("corrupt", n)


query("q_json_tolerant", """
SELECT count(*) FILTER (event_id % 10 <> 0) AS good, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) FILTER (event_id % 10 <> 0) AS BIGINT) AS total, count(*) FILTER (event_id % 10 = 0) AS corrupt FROM events""")(_json)


def _run_logs(c):
    lines = c.v_runs.select(F.to_json(F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"), F.lit("INFO").alias("level"),
        F.lit("perf").alias("logger"), F.lit("done").alias("message"), "agent", "status", "duration")).alias("value"))
    path = _written(c, lines, lambda df, p: df.write.text(p))
    return TB.read_run_logs(c.spark, path).groupBy("agent", "status").agg(
        F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("avg_duration"), F.max(F.unix_seconds("ts")).alias("last_s"))


query("q_run_logs", "SELECT agent, status, count(*) AS n, round(avg(duration), 6) AS avg_duration, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM v_runs GROUP BY 1, 2")(_run_logs)


def _size(c):
    return TB.storage_size_mb(c.table("events")).select("files", (F.col("storage_size_mb") >= 0).alias("measured"))


query("q_storage_size", "SELECT 1::BIGINT AS files, true AS measured FROM events HAVING count(*) > 0")(_size)


def _repo_files(c):
    path = _written(c, c.v_manifests.withColumn("size", F.length("content")), lambda df, p: df.write.parquet(p))
    return TB.read_repo_files(c.spark, path).groupBy("path").agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("chars"))


query("q_repo_files", "SELECT path, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_manifests GROUP BY 1")(_repo_files)
query("q_recent_insights", f"""WITH {_group_sql('strategy', 'success')}, seen AS (SELECT strategy, max((ts, record_id)) AS newest, arg_max(record_id, (ts, record_id)) AS last_record FROM v_records WHERE success GROUP BY 1)
SELECT 'strategy_' || grp || '_success' AS pattern_id, support, confidence, last_record FROM pat JOIN seen ON pat.grp = seen.strategy ORDER BY newest DESC LIMIT 3""")(
    lambda c: P.recent_insights(c.stored_records, P.strategy_patterns(c.stored_records), 3).withColumn("confidence", F.round("confidence", 6)))
query("q_resolution_context", """
SELECT repo_id, name, owner, python_version_required AS python_version FROM v_repos WHERE repo_id IN (SELECT repo_id FROM v_deps)""")(
    lambda c: FE.resolution_context(C.analysis_summary(c.deps, c.v_repos.select("repo_id", "has_dockerfile", "python_version_required")), c.v_repos)
    .select("repo_id", "repository.name", "repository.owner", "requirements.python_version"))
query("q_matrices", """
WITH m AS (SELECT 'torch' AS p, '2.0.0' AS v UNION ALL SELECT 'jax', '0.4.20')
SELECT d.name, d.version, count(*) AS n FROM v_deps d JOIN v_support s ON d.name = s.package AND d.version = s.known GROUP BY 1, 2""")(
    lambda c: c.v_deps.join(F.broadcast(TB.load_matrix(c.spark, "cuda_support").withColumnRenamed("package", "name")), ["name", "version"])
    .groupBy("name", "version").agg(F.count("*").alias("n")))


def _updated_matrix(c):
    """Three built-in matrices are stored, one is replaced by a newer version, and the dependencies meet what is read back."""
    path = shared_dir(c.spark)
    for kind in ("cuda_support", "cuda", "python"):
        TB.update_matrix(TB.load_matrix(c.spark, kind), f"{path}/{kind}")
    first = TB.read_matrix(c.spark, f"{path}/cuda_support")
    more = F.when(F.col("package") == "torch", F.concat("supported", F.array(F.lit("13.0")))).otherwise(F.col("supported"))
    version = TB.update_matrix(first.withColumn("supported", more), f"{path}/cuda_support")
    latest = TB.read_matrix(c.spark, f"{path}/cuda_support").select(
        F.col("package").alias("name"), "version", F.array_join("supported", ",").alias("supported"))
    return (c.v_deps.join(F.broadcast(latest), ["name", "version"]).groupBy("name", "version", "supported")  # a rule table
            .agg(F.count("*").alias("n")).withColumn("matrix_version", F.lit(version).cast("bigint")))


query("q_matrix_update", """
SELECT d.name, d.version, array_to_string(s.cuda, ',') || CASE WHEN d.name = 'torch' THEN ',13.0' ELSE '' END AS supported, count(*) AS n, 2::BIGINT AS matrix_version
FROM v_deps d JOIN v_support s ON d.name = s.package AND d.version = s.known GROUP BY 1, 2, 3""")(_updated_matrix)


def _retained(c):
    path = _written(c, c.records, TB.append_training_records)
    removed = TB.expire_stored(c.spark, path, F.expr("timestamp_ntz'2024-01-31 12:00:00' - interval 20 days"))
    return TB.read_training_records(c.spark, path).select(
        "record_id", "repo_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.lit(removed).cast("bigint").alias("removed"))


query("q_retention", """
SELECT record_id, repo_id, strftime(ts, '%Y-%m-%d') AS day, (SELECT count(*) FROM v_records WHERE ts < TIMESTAMP '2024-01-11 12:00:00') AS removed
FROM v_records WHERE ts >= TIMESTAMP '2024-01-11 12:00:00'""")(_retained)
query("q_learning_storage", """
SELECT 'training_records' AS name, count(*) AS value FROM v_records UNION ALL SELECT 'feature_vectors', count(DISTINCT repo_id) FROM v_records
UNION ALL SELECT 'models', count(DISTINCT name) FROM v_models UNION ALL SELECT 'patterns', count(DISTINCT strategy) FROM v_records WHERE success""")(
    lambda c: TB.learning_storage_stats(c.records, c.v_models, P.strategy_patterns(c.stored_records)))
query("q_normalized_features", """
SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(props, '[0-9]+', 0), '') AS DOUBLE), 0.0) AS text_number, CAST(event_type = 'error' AS INT)::DOUBLE AS flag, coalesce(value, 0.0) AS number FROM events""")(
    lambda c: c.table("events").select(
        "event_id", S.normalize_feature(F.nullif(F.regexp_extract("props", "[0-9]+", 0), F.lit("")), "text").alias("text_number"),
        S.normalize_feature(F.col("event_type") == "error", "boolean").alias("flag"), S.normalize_feature(F.col("value"), "number").alias("number")))
