"""Patterns in recorded outcomes: what successful and failed runs have in common."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.session import materialize

# Numeric features whose range describes a group, and where they live in a training record.
RANGE_FIELDS = {
    "ml_dependencies": "repository_features", "gpu_dependencies": "repository_features",
    "total_dependencies": "repository_features", "gpu_count": "system_features",
    "memory_gb": "system_features", "cpu_cores": "system_features"}
SHARE = 0.8


def _flags() -> dict[str, Column]:
    return {"is_ml_repo": F.col("repository_features.is_ml_repo"),
            "requires_gpu": F.col("repository_features.gpu_dependencies") > 0,
            "has_nvidia_gpu": F.col("system_features.has_nvidia_gpu"),
            "has_gpu_support": F.col("resolution_features.has_gpu_support")}


def successes(records: DataFrame) -> DataFrame:
    return records.where(F.col("outcome.success"))


def failures(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("outcome.success", F.lit(False)))


def dominant(records: DataFrame, group: Column, value: Column) -> DataFrame:
    """Most frequent value per group with its count and share.

    Counts combine before the shuffle; the ranking then sees one row per (group, value).
    """
    counts = records.groupBy(group.alias("grp"), value.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    return (counts.withColumn("support", F.sum("n").over(w))
            .withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "value")))
            .where("rn = 1").select("grp", "value", "n", "support", (F.col("n") / F.col("support")).alias("share")))


def _extent() -> list[Column]:
    """What describes a group: its size, the ranges of numbers, the shares of flags."""
    aggs = [F.count("*").alias("support")]
    for f, s in RANGE_FIELDS.items():
        c = F.col(f"{s}.{f}")
        aggs += [F.min(c).alias(f"{f}_lo"), F.max(c).alias(f"{f}_hi")]
    return aggs + [F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"{n}_share") for n, c in _flags().items()]


def _described(base: DataFrame, mode: DataFrame) -> DataFrame:
    """Groups (``grp`` and their extent) with ``conditions``; ``mode`` has each group's most frequent strategy."""
    mode = mode.select("grp", F.when(F.col("share") >= SHARE, F.col("value")).alias("strategy_type"))
    entry = lambda k, v, cond=None: (F.struct(F.lit(k).alias("key"), v.alias("value")) if cond is None
                                     else F.when(cond, F.struct(F.lit(k).alias("key"), v.alias("value"))))
    entries = [entry(f"{f}_range", F.concat_ws("-", F.col(f"{f}_lo").cast("string"), F.col(f"{f}_hi").cast("string")))
               for f in RANGE_FIELDS]
    entries += [entry(n, F.lit("true"), F.col(f"{n}_share") >= SHARE) for n in _flags()]
    entries += [entry("strategy_type", F.col("strategy_type"), F.col("strategy_type").isNotNull())]
    return base.join(mode, "grp").withColumn("conditions", F.map_from_entries(F.array_compact(F.array(*entries))))


def common_conditions(records: DataFrame, group: Column) -> DataFrame:
    """Conditions a group of records shares: ranges, flags that hold for 80 %, dominant strategy."""
    base = records.groupBy(group.alias("grp")).agg(*_extent())
    return _described(base, dominant(records, group, F.col("resolution_features.strategy_type")))


def pattern_confidence(records: DataFrame, group: Column, conditions: DataFrame) -> DataFrame:
    """Share of a group's records that meet at least 80 % of the group's conditions."""
    cond = conditions.drop("support").alias("c")
    joined = records.withColumn("grp", group).join(cond, "grp")
    checks = [F.col(f"{s}.{f}").between(F.col(f"{f}_lo"), F.col(f"{f}_hi")) for f, s in RANGE_FIELDS.items()]
    met = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    total = F.lit(len(checks))
    for n, c in _flags().items():
        on = F.col(f"{n}_share") >= SHARE
        met = met + (on & F.coalesce(c, F.lit(False))).cast("int")
        total = total + on.cast("int")
    fixed = F.col("strategy_type").isNotNull()
    met = met + F.coalesce(F.col("resolution_features.strategy_type") == F.col("strategy_type"), F.lit(False)).cast("int")
    total = total + fixed.cast("int")
    return joined.groupBy("grp").agg(F.avg((met >= total * SHARE).cast("int")).alias("confidence"))


def _pattern(df: DataFrame, kind: str, pid: Column, text: Column, tips: Column) -> DataFrame:
    return df.select(pid.alias("pattern_id"), F.lit(kind).alias("pattern_type"),
                     text.alias("description"), "confidence", "support", "conditions",
                     tips.alias("recommendations"))


def strategy_patterns(records: DataFrame) -> DataFrame:
    ok, grp = successes(records), F.col("resolution_features.strategy_type")
    cond = common_conditions(ok, grp).where("support >= 2")
    return _strategy_rows(cond.join(pattern_confidence(ok, grp, cond), "grp"))


def _strategy_rows(groups: DataFrame) -> DataFrame:
    g = F.col("grp")
    return _pattern(groups, "strategy_success",
                    F.concat(F.lit("strategy_"), g, F.lit("_success")),
                    F.concat(F.lit("Successful "), g, F.lit(" strategy patterns")),
                    F.array(F.concat(F.lit("Consider "), g, F.lit(" strategy for similar cases"))))


def dependency_bucket() -> Column:
    r = lambda n: F.col(f"repository_features.{n}")
    return (F.when((r("ml_dependencies") >= 3) & (r("gpu_dependencies") >= 1), "complex_ml_gpu")
            .when(r("ml_dependencies") >= 2, "ml_heavy").when(r("gpu_dependencies") >= 1, "gpu_required")
            .when(r("total_dependencies") >= 20, "many_dependencies").otherwise("simple"))


def system_bucket() -> Column:
    s = lambda n: F.col(f"system_features.{n}")
    return (F.when((s("gpu_count") >= 1) & (s("memory_gb") >= 16), "high_end_gpu")
            .when(s("gpu_count") >= 1, "gpu_available")
            .when((s("memory_gb") >= 16) & (s("cpu_cores") >= 8), "high_end_cpu").otherwise("standard"))


def _bucket_rows(top, kind, prefix, key, works, use, min_confidence) -> DataFrame:
    top = top.where((F.col("support") >= 2) & (F.col("share") >= min_confidence))
    g, s = F.col("grp"), F.col("value")
    plain = F.replace(g, F.lit("_"), F.lit(" "))
    df = top.withColumn("confidence", F.col("share")).withColumn(
        "conditions", F.create_map(F.lit(key), g, F.lit("strategy"), s))
    return _pattern(df, kind, F.concat_ws("_", F.lit(prefix), g, s),
                    F.concat(F.initcap(s), F.lit(works[0]), plain, F.lit(works[1])),
                    F.array(F.concat(F.lit("Use "), s, F.lit(use[0]), plain, F.lit(use[1]))))


DEPENDENCY_KIND = ("dependency_strategy", "deps", "dependency_type", (" strategy works well for ", " repositories"),
                   (" strategy for ", " repositories"))
SYSTEM_KIND = ("system_strategy", "sys", "system_type", (" strategy works well on ", " systems"), (" strategy on ", " systems"))


def dependency_patterns(records: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    top = dominant(successes(records), dependency_bucket(), F.col("resolution_features.strategy_type"))
    return _bucket_rows(top, *DEPENDENCY_KIND, min_confidence)


def system_patterns(records: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    top = dominant(successes(records), system_bucket(), F.col("resolution_features.strategy_type"))
    return _bucket_rows(top, *SYSTEM_KIND, min_confidence)


def error_patterns(records: DataFrame) -> DataFrame:
    """Needs three failures overall and two per error type."""
    bad, grp = failures(records), F.col("outcome.error_type")
    cond = common_conditions(bad, grp)
    cond = _enough_failures(cond)
    return _error_rows(cond.join(pattern_confidence(bad, grp, cond), "grp"))


def _enough_failures(groups: DataFrame) -> DataFrame:
    return (groups.withColumn("all_failures", F.sum("support").over(Window.partitionBy()))  # one row per error type
            .where("all_failures >= 3 AND support >= 2"))


def _error_rows(groups: DataFrame) -> DataFrame:
    g = F.col("grp")
    return _pattern(groups, "error_pattern",
                    F.concat(F.lit("error_"), g),
                    F.concat(F.lit("Common characteristics of "), g, F.lit(" failures")), S.error_tips(g))


def discover_patterns(records: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Patterns of all four kinds from one aggregation of the records and one pass for the confidences.

    Grouping sets give every group's extent and every (group, strategy) count at once; the result has a few rows
    per strategy, bucket and error type. Each record then belongs to one described group, its strategy's if it
    succeeded and its error type's if not, so one join with those few rows finds all confidences.
    """
    ok = F.coalesce("outcome.success", F.lit(False))
    keyed = records.withColumns({"ok": ok, "strategy": F.col("resolution_features.strategy_type"), "dep": dependency_bucket(),
                                 "sys": system_bucket(), "error": F.col("outcome.error_type")})
    keys = {n: F.col(n) for n in ("ok", "strategy", "dep", "sys", "error")}
    pick = lambda *names: [keys[n] for n in ("ok", *names)]
    sets = [pick("strategy"), pick("dep", "strategy"), pick("sys", "strategy"), pick("error"), pick("error", "strategy")]
    groups = materialize(keyed.groupingSets(sets, *keys.values()).agg(
        *_extent(), *(F.grouping(n).alias(f"no_{n}") for n in ("strategy", "dep", "sys", "error"))))

    def of(success: bool, *names: str) -> DataFrame:
        has = [F.col(f"no_{n}") == (0 if n in names else 1) for n in ("strategy", "dep", "sys", "error")]
        return groups.where((F.col("ok") == success) & has[0] & has[1] & has[2] & has[3])

    def mode(counts: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy("grp")
        return (counts.select(F.col(by).alias("grp"), F.col("strategy").alias("value"), F.col("support").alias("n"))
                .withColumn("support", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "value")))
                .where("rn = 1").select("grp", "value", "n", "support", (F.col("n") / F.col("support")).alias("share")))

    extent = [c for c in groups.columns if c == "support" or c.endswith(("_lo", "_hi", "_share"))]
    named = lambda df, by: df.select(F.col(by).alias("grp"), *extent)
    strategies = _described(named(of(True, "strategy"), "strategy"), mode(of(True, "strategy"), "strategy")).where("support >= 2")
    errors = _enough_failures(_described(named(of(False, "error"), "error"), mode(of(False, "error", "strategy"), "error"))).drop("all_failures")
    side = lambda df, success: df.withColumn("grp", F.struct(F.lit(success).alias("ok"), F.col("grp").alias("name")))
    both = side(strategies, True).unionByName(side(errors, False))
    own = F.struct(ok.alias("ok"), F.when(ok, F.col("resolution_features.strategy_type")).otherwise(F.col("outcome.error_type")).alias("name"))
    sure = both.join(pattern_confidence(records, own, both), "grp")
    kind = lambda success: sure.where(F.col("grp.ok") == success).withColumn("grp", F.col("grp.name"))
    return (_strategy_rows(kind(True)).unionByName(_bucket_rows(mode(of(True, "dep", "strategy"), "dep"), *DEPENDENCY_KIND, min_confidence))
            .unionByName(_bucket_rows(mode(of(True, "sys", "strategy"), "sys"), *SYSTEM_KIND, min_confidence)).unionByName(_error_rows(kind(False))))


def top_patterns(patterns: DataFrame, limit: int = 5) -> DataFrame:
    return patterns.orderBy(F.desc("support"), F.desc("confidence"), "pattern_id").limit(limit)


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """Totals, counts per type and confidence statistics as (section, key, value) rows."""
    by_type = patterns.groupBy("pattern_type").agg(F.count("*").cast("double").alias("value")) \
        .select(F.lit("type").alias("section"), F.col("pattern_type").alias("key"), "value")
    stats = patterns.agg(F.count("*").cast("double").alias("total"),
                         F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"),
                         F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min"),
                         F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max"))
    long = stats.unpivot([], ["total", "mean", "min", "max"], "key", "value") \
        .select(F.lit("confidence").alias("section"), "key", "value")
    top = top_patterns(patterns).select(F.lit("top").alias("section"), F.col("pattern_id").alias("key"),
                                        F.col("support").cast("double").alias("value"))
    return by_type.unionByName(long).unionByName(top)


def record_items() -> Column:
    """Items of a record for association mining."""
    r, s = lambda n: F.col(f"repository_features.{n}"), lambda n: F.col(f"system_features.{n}")
    return F.array_compact(F.array(
        F.concat(F.lit("strategy:"), F.coalesce("resolution_features.strategy_type", F.lit("unknown"))),
        F.when(r("is_ml_repo"), "repo_type:ml"), F.when(r("gpu_dependencies") > 0, "repo:gpu_required"),
        F.when(s("gpu_count") > 0, "system:has_gpu"), F.when(s("memory_gb") >= 16, "system:high_memory")))


def item_sets(records: DataFrame) -> DataFrame:
    """Distinct item sets with their counts: at most sixteen per strategy, whatever the input."""
    return records.select(record_items().alias("items")).groupBy("items").agg(F.count("*").alias("n"))


def _with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.sum("n").over(Window.partitionBy()))


def frequent_items(records: DataFrame, min_support: float = 0.1) -> DataFrame:
    sets = _with_total(item_sets(records))
    counts = sets.select("total", "n", F.explode("items").alias("item")) \
        .groupBy("item").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    return counts.where(F.col("n") >= F.floor(F.col("total") * min_support)).select(
        "item", F.col("n").alias("count"), (F.col("n") / F.col("total")).alias("support"))


def frequent_sets(sets: DataFrame, min_support: float = 0.1) -> DataFrame:
    """Item sets that ``floor(total * min_support)`` of the baskets hold, once at least: items (sorted), size, count, support.

    ``sets`` has ``items`` (an array) and ``n``, how many baskets have just these. Items stand in one order, rare
    ones first. A round extends each frequent prefix by each later item of its baskets; baskets that share a
    prefix and its later items are one row from then on, and prefixes that have become rare go. So a round works
    on (prefix, rest) rows with counts, whatever the number of baskets, and no set is a task of its own.
    """
    sets = materialize(sets)  # read four times; what the baskets cost is paid once
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # baskets without items count as well
    sets = sets.where(F.size("items") > 0).select(F.array_sort(F.array_distinct("items")).alias("items"), "n") \
        .groupBy("items").agg(F.sum("n").alias("n"))
    least = max(1, math.floor(total * min_support))
    counts = sets.select("n", F.explode("items").alias("item")).groupBy("item").agg(F.sum("n").alias("count")) \
        .where(F.col("count") >= least)
    rest = (sets.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "item"))), lambda x: x["item"]).alias("rest")))
    rows = materialize(sets.join(rest, "items").groupBy("rest").agg(F.sum("n").alias("n"))
                       .select(F.expr("cast(array() as array<string>)").alias("prefix"), "rest", "n"))
    found = None
    while not rows.isEmpty():
        step = rows.select("n", "prefix", F.posexplode("rest").alias("at", "item"), "rest").select(
            F.concat("prefix", F.array("item")).alias("prefix"),
            F.slice("rest", F.col("at") + 2, F.greatest(F.size("rest") - F.col("at") - 1, F.lit(0))).alias("rest"), "n")
        step = step.groupBy("prefix", "rest").agg(F.sum("n").alias("n"))
        level = materialize(step.groupBy("prefix").agg(F.sum("n").alias("count")).where(F.col("count") >= least))
        found = level if found is None else found.unionByName(level)
        rows = materialize(step.where(F.size("rest") > 0).join(level.select("prefix"), "prefix", "left_semi"))
    if found is None:
        return sets.sparkSession.createDataFrame([], "items array<string>, size int, count long, support double")
    return found.select(F.array_sort("prefix").alias("items"), F.size("prefix").alias("size"), "count",
                        (F.col("count") / F.lit(total)).alias("support"))


def rules_of_sets(frequent: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Rules from all items of a frequent set but one to that one: antecedent and consequent, support, confidence, lift."""
    known = frequent.select(F.col("items").alias("antecedent"), F.col("count").alias("base"))
    alone = frequent.where("size = 1").select(F.col("items")[0].alias("consequent"), F.col("support").alias("expected"))
    split = frequent.where("size > 1").select("items", "count", "support", F.explode("items").alias("consequent"))
    return (split.withColumn("antecedent", F.array_remove("items", F.col("consequent"))).join(known, "antecedent")
            .join(alone, "consequent").withColumn("confidence", F.col("count") / F.col("base"))
            .where(F.col("confidence") >= min_confidence)
            .select("antecedent", "consequent", "support", "confidence", (F.col("confidence") / F.col("expected")).alias("lift")))


def association_rules(records: DataFrame, min_support: float = 0.1, min_confidence: float = 0.7) -> DataFrame:
    """Rules between the items of records, with one or several items on the left."""
    return rules_of_sets(frequent_sets(item_sets(records), min_support), min_confidence)


def match_patterns(cases: DataFrame, patterns: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Insights: patterns above the confidence bound all of whose conditions a case meets.

    ``cases`` has repo_id, repository_features, system_features and resolution_features, as records do. Conditions are
    ranges, flags, the dependency bucket, the system bucket and the strategy; a condition on the strategy or its GPU
    support also holds where the case has no strategy yet. A condition of an unknown name never holds.

    Discovered patterns are a report of bounded size (one per strategy, bucket or error type), so they reach the
    cases as one scalar-subquery value, grouped by what they ask of buckets: a case looks up the few lists of its own
    buckets and checks only those patterns, in one projection.
    """
    cond = F.col("conditions")
    strategy, buckets = ("strategy_type", "strategy"), ("dependency_type", "system_type")
    ranges = [f"{f}_range" for f in RANGE_FIELDS]
    bound = lambda f, i: F.substring_index(cond[f"{f}_range"], "-", i).try_cast("double")
    known = F.array(*(F.lit(k) for k in (*ranges, *_flags(), *strategy, *buckets)))
    sure = patterns.where((F.col("confidence") > min_confidence) & (F.size(F.array_except(F.map_keys(cond), known)) == 0)).select(
        *(F.coalesce(cond[b], F.lit("")).alias(b) for b in buckets), F.struct(
            "pattern_id", "description", "confidence", "recommendations",
            *(x for f in RANGE_FIELDS for x in (bound(f, 1).alias(f"{f}_lo"), bound(f, -1).alias(f"{f}_hi"), cond[f"{f}_range"].isNotNull().alias(f"{f}_on"))),
            *((cond[n] == "true").alias(n) for n in _flags()),
            F.coalesce(*(cond[k] for k in strategy)).alias("strategy")).alias("p"))
    key = lambda dep, sys: F.concat_ws("|", dep, sys)
    index = sure.groupBy(key(*(F.col(b) for b in buckets)).alias("key")).agg(F.collect_list("p").alias("ps")) \
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "ps")))).scalar()
    own = cases.select("repo_id", F.col("resolution_features.strategy_type").alias("strategy"),
                       *(F.col(f"{s}.{f}").alias(f) for f, s in RANGE_FIELDS.items()), *(c.alias(n) for n, c in _flags().items()),
                       dependency_bucket().alias("dep"), system_bucket().alias("sys"), index.alias("index"))
    lists = [F.col("index")[key(d, y)] for d in (F.lit(""), F.col("dep")) for y in (F.lit(""), F.col("sys"))]
    none = F.slice(F.flatten(F.map_values("index")), 1, 0)

    def holds(p):
        checks = [~p[f"{f}_on"] | F.col(f).between(p[f"{f}_lo"], p[f"{f}_hi"]) for f in RANGE_FIELDS]
        checks += [p[n].isNull() | ~p[n] | F.col(n) for n in _flags() if n != "has_gpu_support"]
        checks += [p["has_gpu_support"].isNull() | ~p["has_gpu_support"] | F.col("strategy").isNull() | F.col("has_gpu_support")]
        checks += [p["strategy"].isNull() | F.col("strategy").isNull() | (p["strategy"] == F.col("strategy"))]
        met = F.lit(True)
        for c in checks:
            met = met & F.coalesce(c, F.lit(False))
        return met
    found = own.withColumn("ps", F.concat(*(F.coalesce(x, none) for x in lists))).select("repo_id", F.explode(F.filter("ps", holds)).alias("p"))
    return found.select("repo_id", "p.pattern_id", "p.description", "p.confidence", "p.recommendations")


def recent_insights(records: DataFrame, patterns: DataFrame, limit: int = 10) -> DataFrame:
    """Newest strategy patterns first, by the last run that supports them."""
    seen = successes(records).groupBy(F.concat(F.lit("strategy_"), "resolution_features.strategy_type", F.lit("_success"))
                                      .alias("pattern_id")).agg(F.max(F.struct("ts", "record_id")).alias("at"))
    return (patterns.join(seen, "pattern_id").orderBy(F.desc("at"), "pattern_id").limit(limit)
            .select("pattern_id", "support", "confidence", F.col("at.record_id").alias("last_record")))
