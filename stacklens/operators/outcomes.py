"""Outcome, cache and run statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.rules import fixed as R
from stacklens.session import materialize


def last_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key; the rank bound becomes a group limit before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def latest_within(df: DataFrame, key: str, now: Column, max_age: Column, inclusive: bool = True) -> DataFrame:
    """Newest row per key among rows of at most ``max_age``."""
    age = now - F.col("ts")
    fresh = df.where(age <= max_age if inclusive else age < max_age)
    cols = [c for c in df.columns if c != key]
    tie = [c for c in ("outcome_id", "run_id") if c in df.columns]
    return (fresh.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("ts", *tie)).alias("r"))
            .select(key, "r.*"))


def expire(df: DataFrame, now: Column, max_age: Column, inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of removed rows) under an age limit."""
    age = now - F.col("ts")
    keep = age <= max_age if inclusive else age < max_age
    return df.where(keep), df.agg(F.count_if(~keep).alias("removed"))


# -- success and failure patterns ----------------------------------------------------------------
#: Time slots by which ordered aggregates are combined, fine to coarse: no window holds more than a second's rows,
#: an hour's seconds or a group's hours.
SLOTS = ("second", "hour")


def decayed(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """(key, slot, n, part) per second: ``part`` is the sum of value * 0.5^rank, the newest at rank 1 (``order`` ascends)."""
    slot = F.date_trunc(SLOTS[0], F.col(order[0])).alias("slot")
    newest = Window.partitionBy(*key, "slot").orderBy(*(F.desc(c) for c in order))
    ranked = rows.select(*key, slot, *{value, *order}).withColumn("rank", F.row_number().over(newest))
    return ranked.groupBy(*key, "slot").agg(F.count("*").alias("n"), F.sum(F.col(value) * F.pow(F.lit(0.5), F.col("rank"))).alias("part"))


def combined(slots: DataFrame, key: list[str], into: str | None) -> DataFrame:
    """Slots of (n, part) joined to coarser ones, or to one per key: newer slots shift older ones by their counts.

    The operation is associative, so any grouping of slots in time order gives the same value. Any number of older
    values takes part; that their weight fades to zero is left to the arithmetic.
    """
    keys = [*key, "to"]
    to = F.date_trunc(into, "slot") if into else F.lit(None).cast("timestamp")
    newer = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.pow(F.lit(0.5), F.coalesce(F.sum("n").over(newer), F.lit(0)))
    return (slots.withColumn("to", to).withColumn("shifted", F.col("part") * shift).groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.sum("shifted").alias("part")).withColumnRenamed("to", "slot"))


def half_life_average(slots: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, part) of all slots of a key, by way of its hours."""
    return combined(combined(slots, key, SLOTS[1]), key, None).drop("slot")


def success_patterns_ewma(outcomes: DataFrame) -> DataFrame:
    """Per strategy: successes and the half-life average ``avg = (avg + new) / 2`` from 0.

    The recurrence equals the sum of x * 0.5^rank with the newest at rank 1.
    """
    slots = decayed(outcomes.where("success"), ["strategy"], "setup_time", ["ts", "outcome_id"])
    return half_life_average(slots, ["strategy"]).select("strategy", F.col("n").alias("count"), F.col("part").alias("avg_setup_time"))


def success_patterns(outcomes: DataFrame, gpu_repos: DataFrame) -> DataFrame:
    """Per strategy: successes, mean setup time, GPU success share. ``gpu_repos`` has repo_id, gpu."""
    per_repo = outcomes.where("success").groupBy("strategy", "repo_id").agg(
        F.count("*").alias("n"), F.sum("setup_time").alias("t"))
    joined = per_repo.join(gpu_repos.select("repo_id", "gpu"), "repo_id", "left")
    gpu_n = F.sum(F.when(F.col("gpu"), F.col("n")).otherwise(0))
    return joined.groupBy("strategy").agg(
        F.sum("n").alias("count"), (F.sum("t") / F.sum("n")).alias("avg_setup_time"),
        gpu_n.alias("gpu_successes"), (gpu_n / F.sum("n")).alias("gpu_success_rate"))


def success_dependencies(outcomes: DataFrame, deps: DataFrame) -> DataFrame:
    """How often each package occurs in successful runs, per strategy.

    Outcomes are counted per (repository, strategy) before they meet the packages.
    """
    per_repo = outcomes.where("success").groupBy("strategy", "repo_id").agg(F.count("*").alias("n"))
    return (per_repo.join(deps.select("repo_id", F.lower("name").alias("name")), "repo_id")
            .groupBy("strategy", "name").agg(F.sum("n").alias("count")))


def failure_patterns(outcomes: DataFrame) -> DataFrame:
    """Failures per category (six-way) with the newest ten as rows."""
    bad = outcomes.where("NOT success").withColumn("error", F.when(
        F.coalesce(F.length("error_message"), F.lit(0)) > 0, F.col("error_message")).otherwise("unknown_error"))
    bad = bad.withColumn("category", S.categorize_error(F.col("error"), "six"))
    counts = bad.groupBy("category").agg(F.count("*").alias("count"))
    newest = last_n(bad.select("category", "repo_id", "strategy", "error", "ts", "outcome_id"),
                    ["category"], [F.desc("ts"), F.desc("outcome_id")], 10)
    return newest.join(counts, "category").select(
        "category", "count", F.col("rn").cast("bigint").alias("recency"), "repo_id", "strategy",
        F.substring("error", 1, 200).alias("error"))


def failure_causes(outcomes: DataFrame, repos: DataFrame, dep_counts: DataFrame) -> DataFrame:
    """Distinct causes of failure per (strategy, error type)."""
    bad = (outcomes.where("NOT success")
           .withColumn("error_type", S.categorize_error(F.col("error_message")))
           .groupBy("strategy", "error_type", "repo_id").agg(F.count("*").alias("n")))
    named = bad.join(repos.select("repo_id", "name"), "repo_id") \
        .join(dep_counts.select("repo_id", "total_dependencies"), "repo_id", "left")
    cause = F.concat(F.lit("Repo: "), "name", F.lit(", Dependencies: "),
                     F.coalesce("total_dependencies", F.lit(0)).cast("string"))
    return named.groupBy("strategy", "error_type", cause.alias("cause")).agg(F.sum("n").alias("n"))


def failure_matrix(causes: DataFrame) -> DataFrame:
    """Failures, distinct causes and the suggested fix per (strategy, error type)."""
    return causes.groupBy("strategy", "error_type").agg(
        F.sum("n").alias("count"), F.count("*").alias("causes")).withColumn(
        "suggested_fix", S.suggest_fix(F.col("error_type")))


def failure_rollup(outcomes: DataFrame) -> DataFrame:
    """Failure counts with subtotals per strategy and overall."""
    bad = outcomes.where("NOT success").withColumn(
        "error_type", S.categorize_error(F.col("error_message")))
    return bad.rollup("strategy", "error_type").agg(F.count("*").alias("count"))


def running_setup_time(outcomes: DataFrame) -> DataFrame:
    """Running count and mean of setup time per strategy over time.

    A running value over few, long groups must not put a group into one task. Seconds and hours are totalled
    first; offsets come from earlier hours, and earlier seconds of the hour, so only a second's rows share a window.
    """
    fine, coarse = SLOTS
    ok = outcomes.where("success").withColumn("fine", F.date_trunc(fine, "ts"))
    sums = [F.sum("n").alias("n"), F.sum("t").alias("t")]
    seconds = ok.groupBy("strategy", "fine").agg(F.count("*").alias("n"), F.sum("setup_time").alias("t")) \
        .withColumn("coarse", F.date_trunc(coarse, "fine"))

    def before(df: DataFrame, by: list[str], order: str, suffix: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"n{suffix}": F.coalesce(F.sum("n").over(w), F.lit(0)), f"t{suffix}": F.coalesce(F.sum("t").over(w), F.lit(0.0))})

    hours = before(seconds.groupBy("strategy", "coarse").agg(*sums), ["strategy"], "coarse", "0").select("strategy", "coarse", "n0", "t0")
    offsets = before(seconds, ["strategy", "coarse"], "fine", "1").join(hours, ["strategy", "coarse"]) \
        .select("strategy", "fine", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("t0") + F.col("t1")).alias("t0"))
    inside = Window.partitionBy("strategy", "fine").orderBy("ts", "outcome_id").rowsBetween(Window.unboundedPreceding, 0)
    return (ok.join(offsets, ["strategy", "fine"])
            .withColumn("running_count", F.count("*").over(inside) + F.col("n0"))
            .withColumn("running_avg", (F.sum("setup_time").over(inside) + F.col("t0")) / F.col("running_count"))
            .select("outcome_id", "strategy", "running_count", "running_avg"))


def first_last(outcomes: DataFrame) -> DataFrame:
    """First and last duration per strategy and the change between them."""
    at = F.struct("ts", "outcome_id")
    return outcomes.groupBy("strategy").agg(
        F.min_by("duration", at).alias("first_duration"), F.max_by("duration", at).alias("last_duration")) \
        .withColumn("change", F.col("last_duration") - F.col("first_duration"))


# -- learning metrics -----------------------------------------------------------------------------------
def accuracy_as_of(times: DataFrame, models: DataFrame, name: str = "strategy_predictor") -> DataFrame:
    """``times`` (with ``at``, one row per report) with ``model_accuracy``, ``feature_count`` and ``saved_at`` of the model
    of that name that was the newest then; accuracy 0.0 before the first.

    An as-of join: reports and stored models stand in one line of time, and each report looks back to the last model.
    """
    info = F.struct("accuracy", "feature_count", "saved_at")
    line = models.where(F.col("name") == name).select(F.col("saved_at").alias("at"), F.lit(0).alias("kind"), info.alias("m"), F.lit(None).alias("t")) \
        .unionByName(times.select("at", F.lit(1).alias("kind"), F.lit(None).alias("m"), F.struct("*").alias("t")))
    back = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)  # one row per report and model
    seen = line.withColumn("m", F.last("m", ignorenulls=True).over(back)).where("kind = 1")
    return seen.select("t.*", F.coalesce("m.accuracy", F.lit(0.0)).alias("model_accuracy"), F.col("m.feature_count").alias("feature_count"),
                       F.col("m.saved_at").alias("saved_at"))


def daily_trends(outcomes: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Runs, success rate and the gain over the previous day, per day; with stored models, the accuracy at its end."""
    daily = outcomes.groupBy(F.to_date("ts").alias("d")).agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.max("ts").alias("at"))
    w = Window.orderBy("d")  # one row per day
    out = daily.withColumn("learning_velocity", F.greatest(F.lit(0.0), F.coalesce(
        F.col("success_rate") - F.lag("success_rate").over(w), F.lit(0.0))))
    if models is not None:
        out = accuracy_as_of(out, models)
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "runs", "success_rate", "learning_velocity",
                      *(["model_accuracy"] if models is not None else []))


def learning_metrics(outcomes: DataFrame, patterns: DataFrame, models: DataFrame | None = None,
                     storage: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One row: totals, success rate, velocity, insight quality, confidence, effectiveness.

    ``models`` (name, accuracy, feature_count, saved_at) gives the accuracy of the newest model and the time since it
    was saved; ``storage`` is one row with storage_size_mb; ``now`` is the time of the report (default: the last outcome).
    """
    per_day = outcomes.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.max("ts").alias("last"))
    base = per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_analyses"), (F.sum("ok") / F.sum("n")).alias("success_rate"),
        F.greatest(F.lit(0.0), F.max_by(F.col("ok") / F.col("n"), "day")
                   - F.min_by(F.col("ok") / F.col("n"), "day")).alias("learning_velocity"),
        F.max("last").alias("last_outcome"))
    pats = patterns.agg(F.count("*").alias("pattern_count"),
                        F.least(F.lit(1.0), F.coalesce(F.avg("confidence"), F.lit(0.0))).alias("insight_quality"))
    pat = pats.select(F.struct("*")).scalar()  # one row, as a scalar subquery
    out = base.select("*", pat.alias("p")).select("*", "p.*").withColumn("at", now if now is not None else F.col("last_outcome"))
    if models is not None:
        out = accuracy_as_of(out, models)
    else:
        out = out.withColumns({"model_accuracy": F.lit(0.0), "saved_at": F.lit(None).cast("timestamp_ntz")})
    size = storage.select("storage_size_mb").scalar() if storage is not None else F.lit(0.0)
    n, seconds = F.col("total_analyses"), lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return out.select(
        "total_analyses", "success_rate", "model_accuracy", "pattern_count", "learning_velocity",
        "insight_quality", n.alias("feedback_count"), size.cast("double").alias("storage_size_mb"),
        (seconds("at") - F.coalesce(seconds("saved_at"), F.lit(0))).alias("seconds_since_update"),
        F.least(F.lit(1.0), F.col("model_accuracy") * 0.4 + F.col("success_rate") * 0.4
                + F.col("insight_quality") * 0.2).alias("learning_confidence"),
        F.least(F.lit(1.0), n / 100.0).alias("pattern_discovery_rate"),
        F.least(F.lit(1.0), n / 50.0).alias("recommendation_quality"),
        (F.coalesce(seconds("saved_at"), seconds("last_outcome")) + R.RETRAIN_INTERVAL_SECONDS).alias("next_retraining"))


def health_status(metrics: DataFrame, learning_enabled: bool = True) -> DataFrame:
    m = F.col
    score = ((m("success_rate") > 0.7).cast("int") + (m("model_accuracy") > 0.8).cast("int")
             + (m("pattern_count") > 5).cast("int") + (m("learning_velocity") > 0.05).cast("int")
             + F.lit(int(learning_enabled)))
    return metrics.withColumn("health_score", score.cast("bigint")).withColumn(
        "health_status", F.when(F.col("health_score") >= 4, "excellent")
        .when(F.col("health_score") >= 3, "good").otherwise("needs_attention")).select(
        "health_score", "health_status", "total_analyses", "success_rate", "pattern_count")


def learning_advice(metrics: DataFrame, rules=R.LEARNING_ADVICE) -> DataFrame:
    """Texts of the threshold rules that apply; none when there is no data at all."""
    def hit(i, name, op, bound, text):
        cond = F.col(name) < bound if op == "<" else F.col(name) > bound
        return F.when(cond, F.struct(F.lit(i).alias("rule"), F.lit(text).alias("recommendation")))
    hits = [hit(i, *r) for i, r in enumerate(rules, 1)]
    return (metrics.where("total_analyses > 0 OR pattern_count > 0")
            .select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select(
                F.col("h.rule").cast("bigint").alias("rule"), "h.recommendation"))


def learning_report(metrics: DataFrame, patterns: DataFrame, trends: DataFrame, advice: DataFrame,
                    insights: DataFrame, models: DataFrame) -> DataFrame:
    """Metrics, insights, top patterns, model performance, trends and advice as (section, key, value) rows."""
    from stacklens.operators.patterns import top_patterns

    nums = ["total_analyses", "success_rate", "model_accuracy", "pattern_count",
            "learning_velocity", "insight_quality"]
    wide = metrics.select(*[F.col(c).cast("double").alias(c) for c in nums])
    part = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    newest = models.groupBy("name").agg(F.max_by(F.struct("accuracy", "feature_count"), "saved_at").alias("m"))
    parts = [part(insights, "insights", F.col("pattern_id"), F.col("confidence")),
             part(top_patterns(patterns, 10), "patterns", F.col("pattern_id"), F.col("confidence")),
             part(newest, "model", F.concat("name", F.lit(".accuracy")), F.col("m.accuracy")),
             part(newest, "model", F.concat("name", F.lit(".feature_count")), F.col("m.feature_count")),
             part(trends, "trends", F.col("day"), F.col("success_rate")),
             part(advice, "recommendations", F.col("recommendation"), F.col("rule"))]
    out = part(wide.unpivot([], nums, "key", "value"), "metrics", F.col("key"), F.col("value"))
    for p in parts:
        out = out.unionByName(p)
    return out


# -- recommendations from similar cases ---------------------------------------------------------------
def recommend_from_cases(cases: DataFrame) -> DataFrame:
    """Per query and strategy: capped mean similarity, label, count. At most ten cases per query."""
    agg = cases.groupBy("query_id", "strategy").agg(
        F.count("*").alias("similar_cases"), F.least(F.avg("similarity"), F.lit(0.95)).alias("success_probability"))
    return agg.withColumn("confidence", S.probability_label(F.col("success_probability"), "three"))


def recommendation_confidence(cases: DataFrame) -> DataFrame:
    return cases.groupBy("query_id").agg(F.least(
        F.lit(1.0), F.avg("similarity") * 0.7 + F.least(F.count("*") / 5.0, F.lit(1.0)) * 0.3).alias("confidence"))


def case_insights(cases: DataFrame, min_similarity: float = 0.3) -> DataFrame:
    """Messages from the three closest cases that succeeded."""
    return cases.where((F.col("rank") <= 3) & F.col("success") & (F.col("similarity") >= min_similarity)).select(
        "query_id", "rank", "strategy", "similarity",
        F.concat(F.lit("Similar repository successfully used "), "strategy", F.lit(" strategy")).alias("message"),
        F.when(F.col("similarity") > 0.7, "high").otherwise("medium").alias("confidence"))


# -- cache ---------------------------------------------------------------------------------------------------
def cache_stores(requests: DataFrame, ttl_seconds: int = R.CACHE_TTL_SECONDS,
                 fold_limit: int = 1_000_000) -> DataFrame:
    """Times at which a key is fetched and stored: the first request, then each first request at
    least ``ttl`` after the last store. One row per store: cache_key, store_us.

    Requests first shrink to distinct (key, time). Keys with at most ``fold_limit`` times fold in
    order inside one row; hotter keys take ``_stores_by_jumps``, which is exact as well and never
    puts a key into one task.
    """
    ttl = ttl_seconds * 1_000_000
    times = requests.select("cache_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).distinct()
    sizes = times.groupBy("cache_key").agg(F.count("*").alias("times"))
    hot = sizes.where(F.col("times") > fold_limit).select("cache_key")
    step = lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= ttl),
                                 F.concat(acc, F.array(t))).otherwise(acc)
    def fold(df: DataFrame) -> DataFrame:
        arr = df.groupBy("cache_key").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        none = F.expr("cast(array() as array<bigint>)")
        # the guard on the empty list keeps element_at off it
        first = F.when(F.size("ts") > 0, F.slice("ts", 1, 1)).otherwise(none)
        return arr.select("cache_key", F.explode(F.aggregate(
            F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0))), first, step)).alias("store_us"))

    if hot.isEmpty():
        return fold(times)
    hot = materialize(hot)
    small = times.join(hot, "cache_key", "left_anti")
    return fold(small).unionByName(_stores_by_jumps(times.join(hot, "cache_key", "left_semi"), ttl))


def _stores_by_jumps(times: DataFrame, ttl: int, slots_per_ttl: int = 64) -> DataFrame:
    """Stores of hot keys by pointer doubling.

    Every time points to the first time at least ``ttl`` later. A probe falls into one short time
    slot; its target is in that slot or is the earliest time of the next slot that has any. Slots
    are the unit of work, so a key spreads over as many tasks as it has slots. Stores are what the
    first time reaches; doubling the pointers finds them in log2(stores) rounds of joins on
    (key, time), each written to the shared folder.
    """
    width = max(ttl // slots_per_ttl, 1)
    slot = lambda at: F.floor(at / F.lit(width)).cast("bigint")
    targets = times.select("cache_key", slot(F.col("t")).alias("slot"), F.col("t").alias("at"),
                           F.col("t").alias("target"), F.lit(None).cast("bigint").alias("origin"))
    probes = times.select("cache_key", slot(F.col("t") + ttl).alias("slot"), (F.col("t") + ttl).alias("at"),
                          F.lit(None).cast("bigint").alias("target"), F.col("t").alias("origin"))
    both = targets.unionByName(probes)
    # newest first; at equal times the target precedes the probe, because it may serve it
    w = Window.partitionBy("cache_key", "slot").orderBy(F.desc("at"), F.col("target").isNull()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("hit", F.last("target", ignorenulls=True).over(w)).where("origin IS NOT NULL")
    slots = both.groupBy("cache_key", "slot").agg(F.min("target").alias("earliest"))
    later = Window.partitionBy("cache_key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("next_earliest", F.last("earliest", ignorenulls=True).over(later))
    jump = materialize(inside.join(slots, ["cache_key", "slot"]).select(
        "cache_key", F.col("origin").alias("t"), F.coalesce("hit", "next_earliest").alias("to"))
        .where(F.col("to").isNotNull()))
    reached = times.groupBy("cache_key").agg(F.min("t").alias("t"))
    span = times.agg(F.max("t") - F.min("t")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log2(span / ttl + 2)))):
        step = reached.join(jump, ["cache_key", "t"]).select("cache_key", F.col("to").alias("t"))
        reached = materialize(reached.unionByName(step).distinct())
        nxt = jump.select("cache_key", F.col("t").alias("to"), F.col("to").alias("to2"))
        jump = materialize(jump.join(nxt, ["cache_key", "to"]).select("cache_key", "t", F.col("to2").alias("to")))
    return reached.select("cache_key", F.col("t").alias("store_us"))


def cache_stats(requests: DataFrame, ttl_seconds: int = R.CACHE_TTL_SECONDS,
                fold_limit: int = 1_000_000) -> DataFrame:
    """Per key: requests, hits, misses, hit rate, evictions and calls saved."""
    stores = cache_stores(requests, ttl_seconds, fold_limit).groupBy("cache_key").agg(F.count("*").alias("misses"))
    total = requests.groupBy("cache_key").agg(F.count("*").alias("requests"))
    hits = F.col("requests") - F.col("misses")
    return total.join(stores, "cache_key").select(
        "cache_key", "requests", hits.alias("hits"), "misses",
        (hits / F.col("requests") * 100).alias("hit_rate"), (F.col("misses") - 1).alias("evictions"),
        hits.alias("calls_saved"))


def cache_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("requests", "hits", "misses", "evictions", "calls_saved")],
                     (F.sum("hits") / F.sum("requests") * 100).alias("hit_rate"), F.count("*").alias("entries"))


# -- runs -------------------------------------------------------------------------------------------------------
def sla_report(runs: DataFrame, targets: dict[str, float] = R.SLA_TARGETS) -> DataFrame:
    """Per agent: runs, runs within target, duration against target, quantiles."""
    target = F.coalesce(S.string_map(targets)[F.col("agent")], F.lit(0.0))
    r = runs.withColumn("target", target)
    ratio = F.when(F.col("target") > 0, F.col("duration") / F.col("target")).otherwise(F.lit(float("inf")))
    return r.withColumn("ratio", ratio).groupBy("agent", "target").agg(
        F.count("*").alias("runs"), F.count_if(F.col("duration") <= F.col("target")).alias("met"),
        F.avg("duration").alias("avg_duration"), F.max("ratio").alias("worst_ratio"),
        F.percentile_approx("duration", 0.95).alias("p95_duration"))


def health_rollup(runs: DataFrame) -> DataFrame:
    """Last status per agent, and the overall status: the worst of them."""
    last = runs.groupBy("agent").agg(F.max_by("status", F.struct("ts", "run_id")).alias("status"))
    rank = S.string_map(R.HEALTH_RANK)
    worst = Window.partitionBy()  # one row per agent
    names = {v: k for k, v in R.HEALTH_RANK.items()}
    overall = S.string_map(names)[F.max(rank[F.col("status")]).over(worst)]
    return last.select("agent", "status", overall.alias("overall"),
                       *[F.count_if(F.col("status") == s).over(worst).alias(s) for s in R.HEALTH_RANK])


def rate_limits(snapshots: DataFrame, threshold: int = 100) -> DataFrame:
    """Usage and urgency of API quota snapshots (remaining, limit)."""
    used = F.col("limit") - F.col("remaining")
    return snapshots.withColumn("used", used).withColumn("percentage_used", used / F.col("limit") * 100) \
        .withColumn("status", S.rate_limit_status(F.col("remaining"))) \
        .withColumn("low", F.col("remaining") < threshold)
