"""Install logs, validation logs and model responses as tables of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.functions import text as X
from stacklens.rules import fixed as R

CONFLICT_COLUMNS = ["log_id", "error_type", "package", "required_by", "current_version",
                    "required_version", "error_message", "suggested_resolution"]


def required_by(log: Column, package: Column) -> Column:
    """Names in "<package> ... required by X" and "X requires <package>", sorted and distinct."""
    quoted = F.concat(F.lit(r"\Q"), package, F.lit(r"\E"))
    after = F.regexp_extract_all(log, F.concat(F.lit("(?i)"), quoted, F.lit(r".*required by ([a-zA-Z0-9\-_]+)")), 1)
    before = F.regexp_extract_all(log, F.concat(F.lit(r"(?i)([a-zA-Z0-9\-_]+) requires "), quoted), 1)
    return F.array_sort(F.array_distinct(F.concat(after, before)))


def conflict_details(log: Column) -> Column:
    """First "A 1.0 depends on B>=2" line of the cause block: struct(package, by, required)."""
    block = F.split(F.substring_index(log, "The conflict is caused by:", -1), r"\n\n", 2)[0]
    # the block starts with a line end, so the first blank line after it closes the block
    pat = r"([a-zA-Z0-9\-_]+) ([0-9.]+) (?:depends on|requires) ([a-zA-Z0-9\-_]+)([><=!]+[0-9.]+)?"
    hits = F.filter(F.split(block, "\n"), lambda l: l.rlike(pat))
    first = F.get(hits, 0)
    required = F.regexp_extract(first, pat, 4)
    return F.when(log.contains("The conflict is caused by:") & first.isNotNull(), F.struct(
        F.regexp_extract(first, pat, 3).alias("package"),
        F.array(F.regexp_extract(first, pat, 1)).alias("required_by"),
        F.when(required != "", required).alias("required")))


def wheel_package(log: Column) -> Column:
    name = F.regexp_extract(log, r"([a-zA-Z0-9\-_]+)-[0-9.]+-.*\.whl", 1)
    return F.when(name != "", name)


def build_hint(log: Column) -> Column:
    return (F.when(log.contains("Microsoft Visual C++"), "Install Microsoft Visual C++ Build Tools")
            .when(log.contains("gcc") | log.contains("g++"), "Install gcc/g++ compiler")
            .when(log.contains("Rust"), "Install Rust compiler")
            .otherwise("Install build dependencies"))


def _finding(error_type, package, by, current, required, message, resolution) -> Column:
    none, lit = F.lit(None).cast("string"), lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        lit(error_type).alias("error_type"), lit(package).alias("package"),
        (F.expr("cast(array() as array<string>)") if by is None else by).alias("required_by"),
        (none if current is None else current).alias("current_version"),
        (none if required is None else required).alias("required_version"),
        lit(message).alias("error_message"), lit(resolution).alias("suggested_resolution"))


def _line_findings(line: Column, log: Column) -> Column:
    """Findings of one line, one entry per pattern that occurs in it."""
    pats = dict(R.PIP_PATTERNS)
    hit = lambda kind: line.rlike(pats[kind])
    grp = lambda kind, g: F.regexp_extract(line, pats[kind], g)
    detail = conflict_details(log)
    pkg, missing = grp("has_requirement", 1), grp("no_distribution", 1)
    spec = grp("unsatisfied", 1)
    bare = F.trim(F.substring_index(F.substring_index(F.substring_index(spec, "==", 1), ">=", 1), "<=", 1))
    return F.array_compact(F.array(
        F.when(hit("has_requirement"), _finding(
            "version_conflict", pkg, required_by(log, pkg), grp("has_requirement", 4),
            grp("has_requirement", 2), grp("has_requirement", 0),
            F.concat(F.lit("Downgrade "), grp("has_requirement", 3), F.lit(" to "),
                     grp("has_requirement", 2), F.lit(" or find compatible versions")))),
        F.when(hit("cannot_install") & detail.isNotNull(), _finding(
            "version_conflict", detail["package"], detail["required_by"], None, detail["required"],
            grp("cannot_install", 0),
            "Resolve version conflicts by finding mutually compatible versions")),
        F.when(hit("resolver_notice"), _finding(
            "version_conflict", "multiple", None, None, None, grp("resolver_notice", 0),
            "Use pip install --use-deprecated=legacy-resolver or resolve conflicts manually")),
        F.when(hit("no_distribution"), _finding(
            "missing_dependency", missing, required_by(log, missing), None, None,
            grp("no_distribution", 0),
            F.concat(F.lit("Check if "), missing, F.lit(" exists on PyPI or use correct package name")))),
        F.when(hit("unsatisfied"), _finding(
            "incompatible_version", bare, None, None, spec, grp("unsatisfied", 0),
            F.concat(F.lit("No compatible version of "), bare, F.lit(" found for requirement "), spec))),
        F.when(hit("wheel_build"), _finding(
            "build_error", grp("wheel_build", 1), None, None, None, grp("wheel_build", 0), build_hint(log))),
        F.when(hit("compiler"), _finding(
            "build_error", "unknown", None, None, None, grp("compiler", 0),
            "Install Microsoft Visual C++ Build Tools from https://visualstudio.microsoft.com/downloads/")),
        F.when(hit("platform"), _finding(
            "platform_mismatch", F.coalesce(wheel_package(log), F.lit("unknown")), None, None, None,
            grp("platform", 0), "Download correct wheel for your platform or build from source"))))


def parse_pip_logs(logs: DataFrame) -> DataFrame:
    """One row per (line, matching pattern); logs without any get the generic rows.

    The generic branch looks at the log's own findings, so no anti-join or shuffle is needed.
    """
    log = F.col("text")
    typed = F.flatten(F.transform(F.filter(F.split(log, "\n"), lambda l: l.rlike("(?:ERROR|error):")),
                                  lambda l: _line_findings(l, log)))
    generic = F.array_compact(F.array(
        F.when(log.contains("ResolutionImpossible"), _finding(
            "version_conflict", "multiple", None, None, None,
            "Resolution impossible due to conflicting dependencies",
            "Review all package versions and find compatible combinations")),
        F.when(log.contains("Network") | log.contains("Connection"), _finding(
            "network_error", "unknown", None, None, None, "Network connectivity issue",
            "Check internet connection and proxy settings"))))
    found = logs.select("log_id", typed.alias("typed"), generic.alias("generic"))
    return (found.select("log_id", F.explode(F.when(F.size("typed") > 0, F.col("typed"))
                                             .otherwise(F.col("generic"))).alias("f"))
            .select("log_id", "f.*"))


def suggest_resolutions(conflicts: DataFrame) -> DataFrame:
    """Distinct tips per log: by error type, one for ML packages, one for version conflicts."""
    tips = F.create_map(*[x for k, v in R.PIP_RESOLUTION_TIPS.items()
                          for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    empty = F.expr("cast(array() as array<string>)")
    row = F.concat(
        F.coalesce(tips[F.col("error_type")], empty),
        F.when(F.col("package").isin("torch", "tensorflow"), F.array(F.lit(R.PIP_ML_TIP))).otherwise(empty),
        F.when(F.col("error_type") == "version_conflict", F.array(F.lit(R.PIP_PIN_TIP))).otherwise(empty))
    return (conflicts.select("log_id", F.explode(row).alias("suggestion")).distinct())


# -- validation logs --------------------------------------------------------------------------------
def validation_results(logs: DataFrame) -> DataFrame:
    """One row per test line of a validation log: name, status and exit code."""
    line = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)([A-Za-z0-9_]+): (?:PASSED|FAILED \(exit code \d+\))"), 0)
    hit = logs.select("log_id", F.posexplode(line).alias("pos", "line"))
    code = F.regexp_extract("line", r"exit code (\d+)", 1)
    return hit.select("log_id", F.col("pos").cast("bigint").alias("pos"),
                      F.regexp_extract("line", r"^([A-Za-z0-9_]+):", 1).alias("test"),
                      F.when(F.col("line").contains("PASSED"), "PASSED").otherwise("FAILED").alias("status"),
                      F.when(code != "", code.cast("bigint")).otherwise(F.lit(0)).alias("exit_code"))


def summarize_validation_logs(logs: DataFrame) -> DataFrame:
    """Pass/fail counts, first failing test and last ten lines, all within the row of the log."""
    tests = F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z0-9_]+): PASSED"), 1)
    failed = F.regexp_extract_all(F.col("text"), F.lit(r"([A-Za-z0-9_]+): FAILED \(exit code \d+\)"), 1)
    tail = F.slice(F.split(F.regexp_replace("text", r"\n+$", ""), "\n"),
                   F.greatest(F.size(F.split(F.regexp_replace("text", r"\n+$", ""), "\n")) - 9, F.lit(1)), 10)
    return logs.select("log_id", F.size(tests).cast("bigint").alias("passed"),
                       F.size(failed).cast("bigint").alias("failed"),
                       F.get(failed, 0).alias("failing_test"), F.array_join(tail, "\n").alias("last_lines"))


# -- model responses -----------------------------------------------------------------------------------
def response_answers(responses: DataFrame) -> DataFrame:
    """The JSON answer of each response, or its text without thinking blocks."""
    return responses.withColumn("json_answer", X.last_json_object(F.col("content"))) \
        .withColumn("answer", F.coalesce("json_answer", X.strip_thinking(F.col("content"))))
