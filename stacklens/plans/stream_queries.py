"""Streaming jobs over the event table; each has the SQL of its batch twin."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from stacklens.operators import features as FE
from stacklens.plans.bindings import with_views
from stacklens.plans.registry import query
from stacklens.session import materialize
from stacklens.streaming import jobs as J

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _view(c, name: str):
    """A derived view over the event table that arrives in four batches, out of order, instead of the table."""
    view = f"arriving_{uuid.uuid4().hex}"
    J.arrivals(c.table("events")).createOrReplaceTempView(view)
    return c.spark.sql(re.sub(r"\bevents\b", view, with_views(f"SELECT * FROM {name}")))


query("q_stream_success", """
SELECT strategy, count(*) FILTER (success) AS count, round(avg(setup_time) FILTER (success), 6) AS avg_setup_time, count(*) FILTER (NOT success) AS failures FROM v_outcomes GROUP BY 1""")(
    lambda c: J.stream_success_patterns(_view(c, "v_outcomes")).withColumn("avg_setup_time", F.round("avg_setup_time", 6)))
query("q_stream_ewma", """
SELECT strategy, max(n) AS count, round(sum(setup_time * pow(0.5, rn)), 6) AS avg_setup_time FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, outcome_id DESC) AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM v_outcomes WHERE success) GROUP BY 1""")(
    lambda c: J.stream_ewma(_view(c, "v_outcomes")).withColumn("avg_setup_time", F.round("avg_setup_time", 6)))
query("q_stream_windows", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS runs, round(avg(CAST(success AS INT)), 6) AS success_rate FROM v_outcomes GROUP BY 1""")(
    lambda c: J.stream_outcome_windows(_view(c, "v_outcomes")).select(
        stamp("window_start").alias("window_start"), "runs", F.round("success_rate", 6).alias("success_rate")))
query("q_stream_sliding", """
WITH s AS (SELECT success, unnest([date_trunc('hour', ts) - INTERVAL (h) HOUR FOR h IN generate_series(0, 5)]) AS w FROM v_outcomes)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS runs, round(avg(CAST(success AS INT)), 6) AS success_rate FROM s GROUP BY 1""")(
    lambda c: J.stream_outcome_windows(_view(c, "v_outcomes"), "6 hours", "1 hour").select(
        stamp("window_start").alias("window_start"), "runs", F.round("success_rate", 6).alias("success_rate")))
_TTL = """
late AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS wm FROM v_requests),
t AS (SELECT DISTINCT cache_key, epoch_us(ts) AS t FROM v_requests, late WHERE epoch_us(ts) < wm * 1000),
l AS (SELECT cache_key, list(t ORDER BY t) AS ts FROM t GROUP BY 1),
st AS (SELECT cache_key, unnest(list_reduce(list_transform(ts, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 3600000000 THEN list_concat(acc, x) ELSE acc END)) AS store FROM l)"""
query("q_stream_ttl_fetches", f"WITH {_TTL} SELECT r.cache_key, min(r.request_id) AS request_id FROM st JOIN v_requests r ON r.cache_key = st.cache_key AND epoch_us(r.ts) = st.store GROUP BY r.cache_key, st.store")(
    lambda c: J.ttl_fetches(J.stream_ttl_cache(_view(c, "v_requests"))))
query("q_stream_cache_stats", f"""WITH {_TTL}, n AS (SELECT cache_key, count(*) AS misses FROM st GROUP BY 1)
SELECT r.cache_key, count(*) AS requests, any_value(misses) AS misses, count(*) - any_value(misses) AS hits, any_value(misses) - 1 AS evictions
FROM v_requests r JOIN n ON r.cache_key = n.cache_key, late WHERE epoch_us(r.ts) < wm * 1000 GROUP BY 1""")(
    lambda c: J.ttl_statistics(J.stream_ttl_cache(_view(c, "v_requests"))))
query("q_stream_health", """
SELECT agent, arg_max(status, (ts, run_id)) AS status, count(*) AS runs, count(*) FILTER (duration > CASE agent WHEN 'profile_agent' THEN 2.0 WHEN 'analysis_agent' THEN 10.0 WHEN 'resolution_agent' THEN 5.0 ELSE 0.0 END) AS breaches FROM v_runs GROUP BY 1""")(
    lambda c: J.stream_agent_health(_view(c, "v_runs")))


def _ingest(c):
    # every batch joins the features: they are computed once
    stream = FE.training_records(_view(c, "v_outcomes"), c.stored_features, materialize(c.system_features))
    broken = F.when(F.col("record_id") % 17 != 0, F.col("system_features"))
    stored, held = J.stream_training_ingest(stream.withColumn("system_features", broken))
    none = F.lit(None).cast("string")
    return stored.select("record_id", "repo_id", F.lit("stored").alias("place"), none.alias("issues")).unionByName(held.select(
        "record_id", "repo_id", F.lit("quarantine").alias("place"), F.array_join(F.array_sort(F.transform("issues", lambda i: i["severity"])), ",").alias("issues")))


query("q_stream_ingest", """
SELECT record_id, repo_id, CASE WHEN record_id % 17 <> 0 THEN 'stored' ELSE 'quarantine' END AS place,
  CASE WHEN record_id % 17 = 0 THEN 'critical' || CASE WHEN gpu_dependencies > 0 AND NOT has_gpu_support THEN ',medium' ELSE '' END END AS issues FROM v_records""")(_ingest)
query("q_stream_retrain", "SELECT count(*) AS samples, count(*) >= 5 AS rediscover, count(*) >= 10 AS retrain FROM v_outcomes")(
    lambda c: J.stream_retrain_trigger(_view(c, "v_outcomes")).groupBy().agg(
        F.max("samples").alias("samples"), F.bool_or("rediscover").alias("rediscover"), F.bool_or("retrain").alias("retrain")))
query("q_stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s
GROUP BY user_id, sid HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events)""")(
    lambda c: J.stream_sessions(J.arrivals(c.table("events")), "user_id").select(
        "user_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"), "n"))
