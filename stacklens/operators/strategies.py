"""Strategy selection and environment specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.rules import fixed as R


def strategy_facts(deps: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Per repository: whether an ML word occurs in a package name, GPU need, system blockers."""
    low = F.lower("name")
    facts = deps.groupBy("repo_id").agg(
        F.bool_or((F.col("dep_type") == "python") & S.contains_any(low, R.CONDA_CAPABLE_WORDS)).alias("has_ml_word"),
        F.bool_or("gpu_required").alias("gpu"))
    if issues is None:
        return facts.withColumn("system_blocked", F.lit(False))
    blocked = issues.where((F.col("severity") == "critical") & (F.col("type") == "system_dependency")) \
        .select("repo_id").distinct().withColumn("system_blocked", F.lit(True))
    return (facts.join(blocked, "repo_id", "left")
            .withColumn("system_blocked", F.coalesce("system_blocked", F.lit(False))))


def _capable(strategies=R.STRATEGIES) -> Column:
    """Array of the strategies that can handle a row of ``strategy_facts``."""
    rule = {"docker": F.lit(True), "conda": F.col("has_ml_word"), "micromamba": F.col("has_ml_word"),
            "venv": ~F.col("gpu") & ~F.col("system_blocked")}
    return F.array_compact(F.array(*[
        F.when(rule[n], F.struct(F.lit(n).alias("strategy"), F.lit(prio).alias("priority"),
                                 F.lit(sec).alias("setup_seconds"), F.lit(mb).alias("size_mb")))
        for n, prio, sec, mb, _ in strategies]))


def capable_strategies(facts: DataFrame, strategies=R.STRATEGIES) -> DataFrame:
    return (facts.select("repo_id", F.explode(_capable(strategies)).alias("s"))
            .select("repo_id", "s.*"))


def select_strategy(facts: DataFrame, preferred: Column | None = None,
                    strategies=R.STRATEGIES) -> DataFrame:
    """Preferred strategy if it is capable, else the capable one of highest priority."""
    pref = F.lit(None).cast("string") if preferred is None else preferred
    ranked = F.transform(_capable(strategies), lambda s: F.struct(
        F.coalesce(s["strategy"] == pref, F.lit(False)).alias("wanted"),
        s["priority"].alias("priority"), s.alias("s")))
    best = F.array_max(ranked)["s"]
    return (facts.select("repo_id", best.alias("s"))
            .select("repo_id", "s.strategy", "s.priority", "s.setup_seconds", "s.size_mb"))


def select_strategy_by_advice(facts: DataFrame, advice: DataFrame) -> DataFrame:
    """First advised strategy (lowest ``rank``) that is capable, else the priority choice."""
    first = (capable_strategies(facts).join(advice, ["repo_id", "strategy"])
             .groupBy("repo_id").agg(F.min_by(F.struct("strategy", "success_probability"), "rank").alias("a")))
    return (select_strategy(facts).select("repo_id", F.col("strategy").alias("fallback"))
            .join(first, "repo_id", "left")
            .select("repo_id", F.coalesce("a.strategy", "fallback").alias("strategy"),
                    F.col("a.success_probability").alias("learning_confidence")))


def merge_recommendations(base: DataFrame, model: DataFrame) -> DataFrame:
    """Union by (repo, strategy); model values replace base values and the source is recorded."""
    b = base.select("repo_id", "strategy", F.col("success_probability").alias("base_p"),
                    F.col("confidence").alias("base_c"), F.lit(True).alias("in_base"))
    m = model.select("repo_id", "strategy", F.col("success_probability").alias("model_p"),
                     F.col("confidence").alias("model_c"), F.lit(True).alias("in_model"))
    source = (F.when(F.col("in_base") & F.col("in_model"), "ml_enhanced")
              .when(F.col("in_model"), "ml_only").otherwise("base"))
    return b.join(m, ["repo_id", "strategy"], "full").select(
        "repo_id", "strategy", F.coalesce("model_p", "base_p").alias("success_probability"),
        F.coalesce("model_c", "base_c").alias("confidence"), source.alias("source"))


def apply_preset(requests: DataFrame, presets=R.PRESETS) -> DataFrame:
    """Fill request settings from the named preset; an unknown preset gives an error text."""
    names = ", ".join(p[0] for p in presets)
    def field(i: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for p in presets:
            out = F.when(F.col("preset") == p[0], F.lit(p[i]).cast(kind)).otherwise(out)
        return out
    known = F.col("preset").isin([p[0] for p in presets])
    return requests.select(
        "*", field(1, "string").alias("strategy"), field(2, "string").alias("gpu_mode"),
        field(3, "boolean").alias("validation"), field(4, "boolean").alias("cache_enabled"),
        field(5, "boolean").alias("response_analysis"), field(6, "boolean").alias("learning_enabled"),
        F.when(~known, F.concat(F.lit("Preset '"), F.col("preset"),
                                F.lit(f"' not found. Available presets: {names}"))).alias("error"))


# -- environment specifications ------------------------------------------------------------------------
def _channel(strategy: str) -> Column:
    low = F.lower("name")
    if strategy == "conda":
        return F.when(low.isin(R.CONDA_EXACT_PACKAGES), "conda").otherwise("pip")
    if strategy == "micromamba":
        return F.when(S.contains_any(low, R.MICROMAMBA_PACKAGE_WORDS), "conda").otherwise("pip")
    return F.lit("pip")


def route_packages(deps: DataFrame, strategy: str, python: DataFrame | None = None) -> DataFrame:
    """Every package with its channel and its pin text; conda environments also get the Python pin
    and, for GPU repositories, the accelerator packages."""
    pin = lambda sep: F.when(S.has_version(F.col("version")), F.concat_ws(sep, "name", "version")).otherwise(F.col("name"))
    rows = deps.where(F.col("dep_type") == "python").withColumn("channel", _channel(strategy))
    routed = rows.select("repo_id", "channel", "name",
                         F.when(F.col("channel") == "conda", pin("=")).otherwise(pin("==")).alias("spec"))
    if strategy not in ("conda", "micromamba"):
        return routed
    per_repo = deps.groupBy("repo_id").agg(F.bool_or("gpu_required").alias("gpu"))
    if python is not None:
        per_repo = per_repo.join(python.select("repo_id", "python_version_required"), "repo_id", "left")
        version = F.coalesce("python_version_required", F.lit(R.DEFAULT_PYTHON_VERSION))
    else:
        version = F.lit(R.DEFAULT_PYTHON_VERSION)
    extra = F.concat(F.array(F.struct(F.lit("python").alias("name"),
                                      F.concat(F.lit("python="), version).alias("spec"))),
                     F.when(F.col("gpu"), F.array(*[
                         F.struct(F.lit(p).alias("name"), F.lit(p).alias("spec"))
                         for p in ("cudatoolkit", "cudnn")])).otherwise(F.array()))
    added = (per_repo.select("repo_id", F.explode(extra).alias("e"))
             .select("repo_id", F.lit("conda").alias("channel"), "e.name", "e.spec"))
    return routed.unionByName(added)


def render_requirements(routed: DataFrame) -> DataFrame:
    """One text per repository and channel, one pin per line, in name order.

    The group is one environment file: the text is the result itself.
    """
    return (routed.groupBy("repo_id", "channel")
            .agg(F.array_sort(F.collect_list("spec")).alias("specs"))
            .select("repo_id", "channel", F.array_join("specs", "\n").alias("text"),
                    F.size("specs").cast("bigint").alias("lines")))


def base_image(gpu: Column, cuda: Column) -> Column:
    return F.when(gpu, F.concat(F.lit("nvidia/cuda:"), F.coalesce(cuda, F.lit(R.DEFAULT_CUDA_VERSION)),
                                F.lit("-devel-ubuntu20.04"))).otherwise(F.lit("python:3.10-slim"))


def base_images(facts: DataFrame, recommended: DataFrame) -> DataFrame:
    return (facts.join(recommended.select("repo_id", "cuda_version_required"), "repo_id", "left")
            .select("repo_id", "gpu", base_image(F.col("gpu"), F.col("cuda_version_required"))
                    .alias("base_image")))


def resource_estimates(chosen: DataFrame) -> DataFrame:
    """Setup seconds and disk size of the chosen strategies, totalled per strategy."""
    return chosen.groupBy("strategy").agg(
        F.count("*").alias("repos"), F.sum("setup_seconds").cast("bigint").alias("setup_seconds"),
        F.sum("size_mb").cast("bigint").alias("size_mb"))


# Validation commands (fixed values)
VALIDATION_BASE = [("python_version", "python --version"), ("pip_functionality", "pip --version"),
                   ("basic_imports", "python -c 'import sys; print(f\"Python {sys.version} ready\")'")]
VALIDATION_GPU = ("gpu_nvidia_smi", "nvidia-smi")
VALIDATION_TORCH_GPU = ("pytorch_gpu", "python -c 'import torch; print(f\"CUDA available: {torch.cuda.is_available()}\")'")
VALIDATION_TENSORFLOW_GPU = ("tensorflow_gpu", "python -c 'import tensorflow as tf; print(f\"GPU devices: {len(tf.config.list_physical_devices(\"GPU\"))}\")'")
VALIDATION_IMPORTS = ["torch", "tensorflow", "jax"]


def validation_plan(deps: DataFrame, first: int | None = None) -> DataFrame:
    """Test names and commands per repository.

    Import tests apply to all frameworks, or to those among the ``first`` dependencies. With a number,
    the rank becomes a window group limit, so each map task sends few rows per repository to the shuffle.
    """
    from pyspark.sql import Window

    python = deps.where(F.col("dep_type") == "python")
    w = Window.partitionBy("repo_id").orderBy("first_ord")
    if first is not None:
        python = python.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
    imports = (python.where(F.col("name").isin(VALIDATION_IMPORTS))
               .select("repo_id", F.concat(F.lit("import_"), "name").alias("test"),
                      F.concat(F.lit("python -c 'import "), "name", F.lit("; print(f\""), "name",
                               F.lit(" imported successfully\")'")).alias("command")))
    facts = deps.groupBy("repo_id").agg(
        F.bool_or("gpu_required").alias("gpu"),
        F.bool_or((F.col("dep_type") == "python") & (F.col("name") == "torch")).alias("torch"),
        F.bool_or((F.col("dep_type") == "python") & F.col("name").isin("tensorflow", "tensorflow-gpu")).alias("tf"))
    test = lambda t: F.struct(F.lit(t[0]).alias("test"), F.lit(t[1]).alias("command"))
    tests = F.array_compact(F.array(
        *[test(t) for t in VALIDATION_BASE], F.when(F.col("gpu"), test(VALIDATION_GPU)),
        F.when(F.col("gpu") & F.col("torch"), test(VALIDATION_TORCH_GPU)),
        F.when(F.col("gpu") & F.col("tf"), test(VALIDATION_TENSORFLOW_GPU))))
    fixed = facts.select("repo_id", F.explode(tests).alias("t")).select("repo_id", "t.*")
    return fixed.unionByName(imports)
