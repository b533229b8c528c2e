"""Data quality: rule checks, cleaning, reports and contracts. Rules are rows of (condition, issue)
and run as one projection; records never leave their partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklens.functions import scalars as S
from stacklens.functions import versions as V
from stacklens.rules import fixed as R

FEATURE_GROUPS = ["repository_features", "system_features", "resolution_features"]


def _issue(kind, severity, description, field, fix) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("issue_type"), lit(severity).alias("severity"),
                    lit(description).alias("description"), lit(field).alias("field"),
                    lit(fix).alias("suggested_fix"))


def record_checks(schema: T.StructType) -> list[Column]:
    """The five rule groups for records of this schema: each entry is an issue or null."""
    checks: list[Column] = []
    for f in ["ts", *FEATURE_GROUPS]:
        missing = F.col(f).isNull() if f in schema.names else F.lit(True)
        checks.append(F.when(missing, _issue("missing_required_field", "critical",
                                             f"Required field '{f}' is missing", f, f"Add the missing '{f}' field")))
    for f in FEATURE_GROUPS:
        if f in schema.names and not isinstance(schema[f].dataType, T.StructType):
            checks.append(F.when(F.col(f).isNotNull(), _issue(
                "invalid_data_type", "high", f"{f} should be a dictionary", f,
                f"Convert {f} to dictionary format")))
    repo = schema["repository_features"].dataType if "repository_features" in schema.names else None
    repo_names = repo.names if isinstance(repo, T.StructType) else []
    texts = {"star_count": ("Star count cannot be negative", "Set star_count to 0 or positive value")}
    for f in ["star_count", "total_dependencies", "gpu_dependencies", "ml_dependencies"]:
        if f in repo_names:
            desc, fix = texts.get(f, (f"{f} cannot be negative", f"Set {f} to 0 or positive value"))
            checks.append(F.when(F.col(f"repository_features.{f}") < 0, _issue(
                "invalid_value_range", "medium", desc, f"repository_features.{f}", fix)))
    if "resolution_features" in schema.names and "gpu_dependencies" in repo_names:
        support = F.coalesce("resolution_features.has_gpu_support", F.lit(False))
        present = F.col("repository_features").isNotNull() & F.col("resolution_features").isNotNull()
        checks.append(F.when(present & (F.col("repository_features.gpu_dependencies") > 0) & ~support, _issue(
            "inconsistent_data", "medium", "Repository requires GPU but resolution doesn't support it",
            "resolution_features.has_gpu_support", "Verify GPU support configuration")))
    for f in FEATURE_GROUPS:
        if f in schema.names and isinstance(schema[f].dataType, T.StructType):
            empty = F.forall(F.array(*[F.col(f"{f}.{n}").isNull() for n in schema[f].dataType.names]), lambda x: x)
            checks.append(F.when(F.col(f).isNotNull() & empty, _issue(
                "incomplete_data", "high", f"{f} is empty", f, f"Populate {f} with relevant data")))
    return checks


def validate_records(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    found = F.array_compact(F.array(*record_checks(records.schema)))
    return records.select(id_col, F.explode(found).alias("i")).select(id_col, "i.*")


def _numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def _not_finite(c: Column) -> Column:
    d = c.cast("double")
    return F.isnan(d) | (F.abs(d) == float("inf"))


def validate_feature_vectors(df: DataFrame, id_col: str) -> DataFrame:
    """Missing values, values outside the known ranges, and NaN or infinite values."""
    checks = []
    for f in df.schema.fields:
        if f.name == id_col:
            continue
        c = F.col(f.name)
        checks.append(F.when(c.isNull(), _issue("missing_value", "medium", f"Feature '{f.name}' has missing value",
                                                f.name, f"Provide default value for '{f.name}'")))
        if f.name in R.OUTLIER_RANGES and _numeric(f.dataType):
            lo, hi = R.OUTLIER_RANGES[f.name]
            text = c.cast("string")
            checks.append(F.when(~F.isnan(c.cast("double")) & ((c < lo) | (c > hi)), _issue(
                "outlier_value", "low",
                F.concat(F.lit(f"Feature '{f.name}' value "), text, F.lit(f" is outside expected range [{lo}, {hi}]")),
                f.name, F.concat(F.lit("Verify if value "), text, F.lit(f" is correct for '{f.name}'")))))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            checks.append(F.when(_not_finite(c), _issue(
                "invalid_numeric_value", "high",
                F.concat(F.lit(f"Feature '{f.name}' has invalid numeric value: "), c.cast("string")),
                f.name, f"Replace invalid value with default for '{f.name}'")))
    return df.select(id_col, F.explode(F.array_compact(F.array(*checks))).alias("i")).select(id_col, "i.*")


def _clean(c: Column, dt: T.DataType, name: str) -> Column:
    if isinstance(dt, T.StructType):
        inner = F.struct(*[_clean(c[f.name], f.dataType, f.name).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(_not_finite(c), F.lit(0).cast(dt)).otherwise(c)
    if isinstance(dt, T.StringType):
        text = F.when(c.isNotNull(), S.clean_string(c))
        return V.normalize_version(text) if "version" in name.lower() else text
    return c


def clean_records(records: DataFrame, now: Column | None = None) -> DataFrame:
    """NaN and infinite values to 0, tidy text, normal version text, a time where it is missing."""
    cols = []
    for f in records.schema.fields:
        c = F.col(f.name)
        if f.name in FEATURE_GROUPS:
            c = _clean(c, f.dataType, f.name)
        elif f.name == "ts":
            c = F.coalesce(c, (F.current_timestamp() if now is None else now).cast(f.dataType))
        cols.append(c.alias(f.name))
    return records.select(*cols)


def clean_feature_vectors(df: DataFrame, id_col: str, defaults: dict = R.FEATURE_DEFAULTS) -> DataFrame:
    """Missing, NaN and infinite values to the field's default; tidy text."""
    cols = []
    for f in df.schema.fields:
        c, d = F.col(f.name), defaults.get(f.name, 0)
        if f.name == id_col:
            cols.append(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(c.isNull() | _not_finite(c), F.lit(d).cast(f.dataType)).otherwise(c).alias(f.name))
        elif _numeric(f.dataType):
            cols.append(F.coalesce(c, F.lit(d).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.coalesce(c, F.lit(bool(d))).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.when(c.isNull(), F.lit(str(d))).otherwise(S.clean_string(c)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to flat columns named by their path; arrays and maps become JSON text."""
    def walk(prefix: str, name: str, dt: T.DataType):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                yield from walk(f"{prefix}.`{f.name}`", f"{name}{sep}{f.name}", f.dataType)
        elif isinstance(dt, (T.ArrayType, T.MapType)):
            yield F.to_json(F.col(prefix)).alias(name)
        else:
            yield F.col(prefix).alias(name)
    return df.select(*[c for f in df.schema.fields for c in walk(f"`{f.name}`", f.name, f.dataType)])


def field_statistics(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, missing, distinct values and number statistics per flat field.

    One pass: every field is an aggregate of the same scan. Exact distinct counts expand the rows
    once per field, so ``approximate`` swaps them for sketches on very wide or large data.
    """
    flat = flatten(records)
    kinds = {f.name: _numeric(f.dataType) for f in flat.schema.fields}
    text = flat.select(*[F.struct(F.col(c).cast("string").alias("text"),
                                  (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("num")).alias(c)
                         for c, num in kinds.items()])
    long = text.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"`{c}`.text").alias("text"), F.col(f"`{c}`.num").alias("num"))
        for c in kinds])).alias("e")).select("e.*")
    unique = F.approx_count_distinct("text") if approximate else F.count_distinct("text")
    return long.groupBy("field").agg(
        F.count("text").alias("count"), (F.count("*") - F.count("text")).alias("missing"),
        unique.alias("unique"), F.min("num").alias("min"), F.max("num").alias("max"),
        F.avg("num").alias("mean"), F.stddev_pop("num").alias("std")).where(F.col("count") > 0)


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("count"))


def quality_advice(issues: DataFrame, records: DataFrame) -> DataFrame:
    """Recommendation texts from issue counts; more than one issue per ten records adds one."""
    n = lambda kind: F.count_if(F.col("issue_type") == kind)
    total = records.agg(F.count("*")).scalar()
    agg = issues.agg(F.count("*").alias("all"), n("missing_required_field").alias("a"),
                     n("invalid_data_type").alias("b"), n("missing_value").alias("c"),
                     n("outlier_value").alias("d")).withColumn("total", total)
    text = lambda c, before, after: F.when(F.col(c) > 0, F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after)))
    tips = F.array_compact(F.array(
        F.when(F.col("all") == 0, F.lit("Data quality is good - no issues found")),
        text("a", "Fix ", " missing required fields"), text("b", "Fix ", " data type issues"),
        text("c", "Handle ", " missing values"), text("d", "Review ", " outlier values"),
        F.when(F.col("all") > F.col("total") * 0.1, F.lit("Consider implementing data validation pipeline"))))
    return agg.select(F.explode(tips).alias("recommendation"))


# -- contracts -------------------------------------------------------------------------------------------
def _contracts(kind: str) -> list[tuple[str, Column, Column]]:
    """(rule, condition that must hold, message) per kind."""
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    m = lambda text, c: F.concat(F.lit(text), t(c))
    blank = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    if kind == "profile":
        return [("cpu_cores", F.col("cpu_cores") > 0, F.lit("CPU cores must be > 0")),
                ("memory", F.col("memory_gb") > 0, F.lit("Memory must be > 0")),
                ("architecture", F.col("architecture").isin("x86_64", "arm64", "unknown"),
                 m("Invalid architecture: ", "architecture")),
                ("python_version", F.col("python_version") != "unknown", F.lit("Python version must be detected")),
                ("compute_score", F.col("compute_score").between(0, 100), m("Invalid compute score: ", "compute_score"))]
    if kind == "analysis":
        return [("name", blank(F.col("name")), F.lit("Repository name is required")),
                ("owner", blank(F.col("owner")), F.lit("Repository owner is required")),
                ("url", blank(F.col("url")), F.lit("Repository URL is required")),
                ("confidence", F.col("confidence_score").between(0.0, 1.0),
                 m("Invalid confidence score: ", "confidence_score")),
                ("analysis_time", F.col("analysis_time") >= 0, m("Invalid analysis time: ", "analysis_time"))]
    if kind == "dependency":
        return [("type", F.col("dep_type").isin("python", "conda", "system", "gpu"), m("Invalid dependency type: ", "dep_type")),
                ("name", blank(F.col("name")), F.lit("Dependency name is required")),
                ("source", blank(F.col("source")), F.lit("Dependency source is required"))]
    if kind == "issue":
        return [("severity", F.col("severity").isin("critical", "warning", "info"), m("Invalid severity: ", "severity")),
                ("message", blank(F.col("message")), F.lit("Compatibility issue message is required")),
                ("component", blank(F.col("component")), F.lit("Compatibility issue component is required"))]
    if kind == "resolution":
        every = lambda field: F.forall("files", lambda f: blank(f[field]))
        return [("strategy", F.col("strategy").isin(*R.CONTRACT_STRATEGIES), m("Invalid strategy type: ", "strategy")),
                ("file_path", every("path"), F.lit("Generated file path is required")),
                ("file_content", every("content"), F.lit("Generated file content is required")),
                ("file_description", every("description"), F.lit("Generated file description is required")),
                ("setup_commands", F.forall("setup_commands", blank), F.lit("Setup command cannot be empty")),
                ("instructions", blank(F.col("instructions")), F.lit("Instructions are required")),
                ("size", F.col("estimated_size_mb") >= 0, m("Invalid estimated size: ", "estimated_size_mb"))]
    raise ValueError(f"unknown contract {kind!r}")


def check_contracts(df: DataFrame, kind: str, id_col: str) -> DataFrame:
    """All violated rules per row (a missing value violates the rule)."""
    hits = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule"), msg.alias("message")))
            for rule, ok, msg in _contracts(kind)]
    return df.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("v")).select(
        id_col, F.lit(kind).alias("contract"), "v.*")
