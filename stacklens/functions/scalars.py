"""Scalar scoring, flagging and clean-up expressions (native columns only)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacklens.rules import fixed as R

_EDGE_SPACE = r"[\p{Z}\s\x{1C}-\x{1F}\x{85}]+"
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def string_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# -- packages ---------------------------------------------------------------
def flag_gpu(name: Column, scope: str = "requirements") -> Column:
    lists = {"requirements": R.GPU_REQUIREMENT_PACKAGES, "imports": R.GPU_IMPORT_PACKAGES,
             "features": R.GPU_FEATURE_PACKAGES}
    return name.isin(lists[scope])


def is_ml(name: Column) -> Column:
    return F.lower(name).isin(R.ML_PACKAGES)


def has_version(version: Column) -> Column:
    """A version is present: not null and not empty."""
    return F.coalesce(F.length(version) > 0, F.lit(False))


def is_constrained(version: Column) -> Column:
    return has_version(version) & (version != "*")


def is_pinned(version: Column) -> Column:
    return has_version(version) & ~version.rlike(r"[><~]|!=")


def dependency_category(name: Column, gpu: Column) -> Column:
    low = F.lower(name)
    return (F.when(is_ml(name), "ml").when(gpu, "gpu").when(low.contains("test"), "test")
            .when(low.contains("dev"), "dev").otherwise("other"))


# -- errors -----------------------------------------------------------------
def categorize_error(msg: Column, scheme: str = "eight") -> Column:
    """``eight`` ends at build errors and maps no text to no_error; ``six`` has neither."""
    low = F.lower(msg)
    empty = msg.isNull() | (msg == "")
    cats = R.ERROR_CATEGORIES if scheme == "eight" else R.ERROR_CATEGORIES[:5]
    out = F.when(empty, "no_error" if scheme == "eight" else "unknown_error")
    for cat, words in cats:
        out = out.when(contains_any(low, words), cat)
    return out.otherwise("unknown_error")


def suggest_fix(error_type: Column) -> Column:
    return F.coalesce(string_map(R.ERROR_FIXES)[error_type], F.lit(R.ERROR_FIX_DEFAULT))


def error_tips(error_type: Column) -> Column:
    tips = F.create_map(*[x for k, v in R.ERROR_TIPS.items()
                          for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(tips[error_type], F.array(F.lit(R.ERROR_TIP_DEFAULT)))


# -- scores -----------------------------------------------------------------
def confidence_score(n_deps: Column, has_requirements: Column, has_setup: Column,
                     has_docker: Column, python_version: Column) -> Column:
    pts = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = (pts(n_deps > 0, 0.4) + pts(has_requirements, 0.2) + pts(has_setup, 0.2)
             + pts(has_docker, 0.1) + pts(has_version(python_version), 0.1))
    return F.least(total, F.lit(1.0))


def compute_score(cores: Column, memory_gb: Column, gpus: Column) -> Column:
    gpu = F.aggregate(gpus, F.lit(0.0),
                      lambda acc, g: acc + F.least(g["memory_gb"] * 2, F.lit(25.0)))
    total = (F.least(cores.cast("double") * 2, F.lit(30.0))
             + F.least(memory_gb, F.lit(20.0)) + gpu)
    return F.least(total, F.lit(100.0)).cast("bigint")


def probability_label(p: Column, scale: str = "four") -> Column:
    if scale == "four":
        return (F.when(p >= 0.8, "high").when(p >= 0.6, "medium").when(p >= 0.4, "low")
                .otherwise("very_low"))
    return F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")


def rate_limit_status(remaining: Column) -> Column:
    return (F.when(remaining < 100, "CRITICAL").when(remaining < 500, "WARNING")
            .otherwise("OK"))


def similarity_to_known(n_ml: Column, n_gpu: Column) -> Column:
    return (F.when((n_ml >= 3) & (n_gpu >= 1), 0.8).when(n_ml >= 2, 0.6)
            .when(n_ml >= 1, 0.4).otherwise(0.2))


def complexity_score(n_deps: Column, n_issues: Column, gpu: Column, n_constr: Column) -> Column:
    part = lambda n, full, w: F.least(n / F.lit(full), F.lit(1.0)) * w
    total = (part(n_deps, 50.0, 0.3) + part(n_issues, 20.0, 0.3)
             + F.when(gpu, 0.2).otherwise(0.0) + part(n_constr, 20.0, 0.2))
    return F.least(total, F.lit(1.0))


def quality_score(confidence: Column, n_high_insights: Column, n_close_cases: Column,
                  conflict_probability: Column) -> Column:
    penalty = F.when(conflict_probability > 0.5, conflict_probability * 0.1).otherwise(0.0)
    raw = confidence + n_high_insights * 0.05 + n_close_cases * 0.03 - penalty
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def boosted_confidence(confidence: Column, n_high_insights: Column) -> Column:
    return F.when(n_high_insights > 0, F.least(F.lit(1.0), confidence + 0.1)).otherwise(confidence)


# -- systems ----------------------------------------------------------------
def system_capabilities(gpus: Column, cuda: Column, runtime: Column) -> Column:
    return F.struct(
        (F.size(gpus) > 0).alias("has_gpu"), cuda.isNotNull().alias("has_cuda"),
        runtime.isNotNull().alias("can_run_containers"),
        F.aggregate(gpus, F.lit(0.0), lambda a, g: a + g["memory_gb"]).alias("gpu_memory_gb"))


def has_nvidia(gpus: Column) -> Column:
    return F.exists(gpus, lambda g: F.lower(g["name"]).contains("nvidia"))


def has_amd(gpus: Column) -> Column:
    return F.exists(gpus, lambda g: contains_any(F.lower(g["name"]), ["amd", "radeon", "rx", "vega"]))


def tool_version(output: Column) -> Column:
    """First x.y.z in a tool's output, else its first line."""
    found = F.regexp_extract(output, r"(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", found).otherwise(F.element_at(F.split(F.trim(output), "\n"), 1))


def toolkit_release(output: Column) -> Column:
    """The X.Y of ``release X.Y,`` in a compiler banner; null when there is none."""
    rel = F.regexp_extract(output, r"(?i)release([^,\n]*)", 1)
    return F.when(F.trim(rel) != "", F.trim(rel))


# -- text and keys ------------------------------------------------------------
def clean_string(s: Column) -> Column:
    edge = F.regexp_replace(s, "^" + _EDGE_SPACE + "|" + _EDGE_SPACE + "$", "")
    return F.coalesce(F.regexp_replace(edge, _UNPRINTABLE, ""), F.lit(""))


def cache_key(url: Column, params: Column) -> Column:
    """md5 of the url, plus the parameters in key order when there are any."""
    entries = F.array_sort(F.map_entries(params))
    text = F.to_json(F.transform(entries, lambda e: F.array(e["key"], e["value"])))
    return F.md5(F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.concat_ws("|", url, text))
                 .otherwise(url))


def solution_id(strategy: Column, url: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", strategy, url)), 1, 8)


def base_image_type(files: Column) -> Column:
    """Kind of base image, read from the generated Dockerfile's content."""
    docker = F.get(F.filter(files, lambda f: _basename(f["path"]) == "Dockerfile"), 0)["content"]
    return (F.when(docker.contains("nvidia/cuda"), "nvidia_cuda")
            .when(docker.contains("python"), "python")
            .when(docker.contains("ubuntu") | docker.contains("debian"), "ubuntu_debian")
            .otherwise("unknown"))


def compose_has_gpu(files: Column) -> Column:
    return F.exists(files, lambda f: (_basename(f["path"]) == "docker-compose.yml")
                    & (f["content"].contains("gpus") | f["content"].contains("nvidia")))


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def is_research(name: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    return contains_any(text, R.RESEARCH_KEYWORDS)


def normalize_feature(v: Column, kind: str) -> Column:
    """Any value as a number: null 0, flags 0/1, numeric text as is, other text a hash bucket."""
    if kind == "boolean":
        return F.coalesce(v.cast("int").cast("double"), F.lit(0.0))
    if kind == "number":
        return F.coalesce(v.cast("double"), F.lit(0.0))
    bucket = F.pmod(F.xxhash64(v), F.lit(1000)) / F.lit(1000.0)
    return F.when(v.isNull(), 0.0).otherwise(F.coalesce(v.try_cast("double"), bucket))
