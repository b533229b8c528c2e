"""Incremental jobs on Structured Streaming.

Every sink writes one folder per micro-batch, named by the batch id and overwritten on a retry, so
a restarted batch leaves no duplicates. Checkpoints and tables live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.operators import quality as Q
from stacklens.operators.outcomes import cache_stores, decayed, half_life_average
from stacklens.rules import fixed as R
from stacklens.session import materialize, shared_dir


def file_batches(df: DataFrame, n: int, late_minutes: int, key: str) -> tuple[str, int]:
    """Files of ``df`` that arrive in ``n`` batches: a row arrives up to ``late_minutes`` after its ``ts``, by a hash of
    ``key``. Returns the folder and how many files make a batch; older batches have older files.

    Batches overlap in time, so a stream over them sees rows out of order, but none later than that bound.
    """
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    arrives = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64(key), F.lit(late_minutes * 60))
    ends = df.agg(F.min(arrives).alias("a"), F.max(arrives).alias("b"), F.count("*").alias("n")).first()
    files = max(1, (ends["n"] or 0) // n // 1_000_000)
    width = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // n + 1)
    for batch in range(n):
        low = (ends["a"] or 0) + batch * width
        df.where((arrives >= low) & (arrives < low + width)).repartition(files).write.parquet(f"{base}/arrival={batch}")
    return base, files


def arrivals(df: DataFrame, n: int = 4, late_minutes: int = 45, key: str = "event_id") -> DataFrame:
    """A table with ``ts`` as a stream of ``n`` batches or more, out of order by ``late_minutes`` at most."""
    folder, files = file_batches(df, n, late_minutes, key)
    return (df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
            .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int, str], None] | None = None,
          settings: dict[str, str] | None = None, progress: dict | None = None) -> DataFrame:
    """Process all available input and return the written table (with ``batch_id``).

    ``settings`` hold for this query only. ``progress`` receives the numbers of ``batches``, of ``rows`` read and
    of ``late`` rows that the watermark dropped.
    """
    spark, base = stream.sparkSession, shared_dir(stream.sparkSession)
    table = f"{base}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        if each is not None:
            each(batch, batch_id, table)
        else:
            batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
                 .trigger(availableNow=True).foreachBatch(write).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if progress is not None:
        seen = query.recentProgress
        progress |= {"batches": len([p for p in seen if p["numInputRows"]]), "rows": sum(p["numInputRows"] for p in seen),
                     "late": sum(o["numRowsDroppedByWatermark"] for p in seen for o in p["stateOperators"])}
    return spark.read.parquet(table)


def newest_state(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last value per key of a table written in update mode."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


# -- success patterns -----------------------------------------------------------------------------
def stream_success_patterns(outcomes: DataFrame) -> DataFrame:
    """Successes, mean setup time and failures per strategy (update mode)."""
    agg = outcomes.groupBy("strategy").agg(
        F.count_if("success").alias("count"), F.avg(F.when(F.col("success"), F.col("setup_time"))).alias("avg_setup_time"),
        F.count_if(~F.col("success")).alias("failures"))
    return newest_state(drain(agg, "update"), ["strategy"])


def stream_ewma(outcomes: DataFrame) -> DataFrame:
    """Half-life average per strategy in event time, whatever the order in which batches bring their rows.

    A batch stores its rows by day and then sums up the days it touched again, from all rows of those days that
    have come so far: late rows take their place in time. The newest sums of each day combine to the average.
    """
    spark = outcomes.sparkSession

    def fold(batch: DataFrame, batch_id: int, table: str) -> None:
        ok = batch.where("success").select("strategy", "ts", "outcome_id", "setup_time", F.to_date("ts").alias("day"))
        ok.write.mode("overwrite").partitionBy("day").parquet(f"{table}_rows/batch_id={batch_id}")
        kept = spark.read.schema(f"{_ddl(ok)}, batch_id int").parquet(f"{table}_rows").where(F.col("batch_id") <= batch_id)
        touched = kept.where(F.col("batch_id") == batch_id).select("day").distinct()
        decayed(kept.join(touched, "day"), ["strategy", "day"], "setup_time", ["ts", "outcome_id"]) \
            .write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    sums = drain(outcomes, "append", fold)
    newest = sums.groupBy("day").agg(F.max("batch_id").alias("batch_id"))
    return half_life_average(sums.join(newest, ["day", "batch_id"]), ["strategy"]).select(
        "strategy", F.col("n").alias("count"), F.col("part").alias("avg_setup_time"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


# -- windows ------------------------------------------------------------------------------------------
def stream_outcome_windows(outcomes: DataFrame, size: str = "1 day", slide: str | None = None,
                           lateness: str = "1 day", progress: dict | None = None) -> DataFrame:
    """Runs and success rate per tumbling or sliding window; ``progress`` tells how many rows came too late."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = outcomes.withWatermark("ts", lateness).groupBy(w.alias("w")).agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("success_rate"))
    flat = agg.select(F.col("w.start").alias("window_start"), "runs", "success_rate")
    return newest_state(drain(flat, "update", progress=progress), ["window_start"])


def stream_sessions(events: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Closed sessions per key; sessions still open at the end of the input are not emitted."""
    agg = events.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap).alias("w")) \
        .agg(F.count("*").alias("n"))
    return drain(agg.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"),
                 "append").drop("batch_id")


# -- cache -------------------------------------------------------------------------------------------------
def stream_ttl_cache(requests: DataFrame, ttl_seconds: int = R.CACHE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Requests up to the final watermark with ``fetched``: true on a miss, false on a hit.

    Batches need not arrive in order: the watermark is the latest time so far less ``lateness``; rows that come behind
    it are dropped, and rows ahead of it wait. A batch marks the rows that its watermark has passed, all keys in one
    join. The store time, not the last hit, starts the time to live. The state of a batch is a folder of waiting rows
    and one of the stores that can still serve, which are those of the last time to live; a key's earlier stores go.
    """
    spark, ttl = requests.sparkSession, ttl_seconds * 1_000_000
    late_us = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {lateness}"))).first()[0]

    def mark(batch: DataFrame, batch_id: int, table: str) -> None:
        folder = lambda name, n: f"{table}_{name}/batch_id={n}"
        waiting, stores, before = batch.withColumn("t", F.unix_micros("ts")), None, None
        if batch_id > 0:
            stores = spark.read.parquet(folder("stores", batch_id - 1))
            before = spark.read.parquet(folder("limit", batch_id - 1)).first()[0]
            if before is not None:
                waiting = waiting.where(F.col("t") >= before)
            waiting = waiting.unionByName(spark.read.parquet(folder("waiting", batch_id - 1)))
        newest = batch.agg(F.max(F.unix_millis("ts"))).first()[0]
        passed = [x for x in (before, None if newest is None else newest * 1000 - late_us) if x is not None]
        limit = max(passed, default=None)
        due = F.col("t") < limit if passed else F.lit(False)
        now = waiting.where(due)
        carried = now.select("cache_key", "ts") if stores is None else now.select("cache_key", "ts").unionByName(
            stores.select("cache_key", F.timestamp_micros("t").alias("ts")))
        # a carried store comes before all rows that are due: it is its key's first, and counts as stored already
        found = materialize(cache_stores(carried, ttl_seconds))
        at = found.select("cache_key", F.col("store_us").alias("t"), F.lit(True).alias("stored"))
        first = now.groupBy("cache_key", "t").agg(F.min("request_id").alias("first_id"))
        fetches = first.join(at, ["cache_key", "t"]).select("cache_key", "t", F.col("first_id").alias("request_id"), "stored")
        now.join(fetches, ["cache_key", "t", "request_id"], "left").select(
            "cache_key", "request_id", "t", F.coalesce("stored", F.lit(False)).alias("fetched")) \
            .write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        waiting.where(~due).write.mode("overwrite").parquet(folder("waiting", batch_id))
        found.where(F.col("store_us") > limit - ttl if passed else F.lit(False)).groupBy("cache_key").agg(F.max("store_us").alias("t")) \
            .write.mode("overwrite").parquet(folder("stores", batch_id))
        spark.range(1).select(F.lit(limit).cast("bigint").alias("limit_us")).write.mode("overwrite").parquet(folder("limit", batch_id))

    return drain(requests.select("cache_key", "request_id", "ts"), "append", mark).drop("batch_id")


def ttl_fetches(marked: DataFrame) -> DataFrame:
    """The de-duplicated stream: one fetch per key within the time to live."""
    return marked.where("fetched").select("cache_key", "request_id")


def ttl_statistics(marked: DataFrame) -> DataFrame:
    """Hit and miss counts per key from marked requests."""
    misses = F.count_if("fetched")
    return marked.groupBy("cache_key").agg(F.count("*").alias("requests"), misses.alias("misses"),
                                           F.count_if(~F.col("fetched")).alias("hits"), (misses - 1).alias("evictions"))


# -- runs -----------------------------------------------------------------------------------------------------
def stream_agent_health(runs: DataFrame, targets: dict[str, float] = R.SLA_TARGETS) -> DataFrame:
    """Last status and SLA breaches per agent (update mode)."""
    target = F.coalesce(S.string_map(targets)[F.col("agent")], F.lit(0.0))
    agg = runs.groupBy("agent").agg(
        F.max_by("status", F.struct("ts", "run_id")).alias("status"), F.count("*").alias("runs"),
        F.count_if(F.col("duration") > target).alias("breaches"))
    return newest_state(drain(agg, "update"), ["agent"])


# -- training records ---------------------------------------------------------------------------------------
def stream_training_ingest(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored records, quarantine). Records with a critical or high issue do not enter the store: they wait as
    they came in a table of their own, with their issues. Both tables have one folder per batch id, so a batch
    that is run again replaces what it wrote in both.
    """
    path: list[str] = []

    def ingest(batch: DataFrame, batch_id: int, table: str) -> None:
        path[:] = [table]
        checks = F.array_compact(F.array(*Q.record_checks(batch.schema)))
        marked = batch.withColumn("issues", checks).persist()
        grave = F.exists("issues", lambda i: i["severity"].isin("critical", "high"))
        Q.clean_records(marked.where(~grave).drop("issues")).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        marked.where(grave).write.mode("overwrite").parquet(f"{table}_quarantine/batch_id={batch_id}")
        marked.unpersist()

    stored = drain(records, "append", ingest)
    return stored.drop("batch_id"), records.sparkSession.read.parquet(f"{path[0]}_quarantine").drop("batch_id")


def stream_retrain_trigger(feedback: DataFrame, interval: int = R.RETRAIN_INTERVAL_SECONDS,
                           min_samples: int = R.RETRAIN_MIN_SAMPLES, min_feedback: int = R.FEEDBACK_MIN) -> DataFrame:
    """Per batch: whether to rediscover patterns and whether to retrain, from a one-row control state."""
    spark = feedback.sparkSession
    def decide(batch: DataFrame, batch_id: int, table: str) -> None:
        now = batch.agg(F.count("*").alias("n"), F.unix_seconds(F.max("ts")).alias("now"))
        if batch_id > 0:
            old = spark.read.parquet(f"{table}/batch_id={batch_id - 1}")
            prev = old.select(F.struct("samples", "last_retraining", "pending").alias("p")).scalar()
        else:
            prev = F.struct(F.lit(0).cast("bigint").alias("samples"), F.lit(0).cast("bigint").alias("last_retraining"),
                            F.lit(0).cast("bigint").alias("pending"))
        s = now.select("*", prev.alias("p")).select(
            (F.col("p.samples") + F.col("n")).alias("samples"), (F.col("p.pending") + F.col("n")).alias("waiting"),
            F.coalesce("now", "p.last_retraining").alias("now"), F.col("p.last_retraining").alias("last"))
        due = (F.col("now") - F.col("last") >= interval) & (F.col("samples") >= min_samples)
        fresh = F.col("waiting") >= min_feedback
        s.select("samples", fresh.alias("rediscover"), due.alias("retrain"),
                 F.when(due | fresh, F.col("now")).otherwise(F.col("last")).alias("last_retraining"),
                 F.when(fresh, F.lit(0).cast("bigint")).otherwise(F.col("waiting")).alias("pending")) \
            .write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
    return drain(feedback, "append", decide)
