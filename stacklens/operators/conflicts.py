"""Compatibility checks. Rules are small tables that compile to row-local expressions: after the
packages of a repository meet once (one shuffle on ``repo_id``), every check is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.functions import versions as V
from stacklens.rules import fixed as R

SUPPORT = {p: [{"version": v, "cuda": c} for v, c in rows] for p, rows in R.CUDA_SUPPORT.items()}
RANGES = {p: [{"version": v, "min_cuda": lo, "max_cuda": hi, "recommended": rec}
              for v, lo, hi, rec in rows] for p, rows in R.CUDA_RANGES.items()}
TRACKED = sorted({p for r in R.CONFLICT_RULES for p in r[:2]} | {p[0] for p in R.PROBLEM_VERSIONS}
                 | set(SUPPORT) | set(RANGES))
ISSUE = "struct<type:string,severity:string,message:string,component:string,suggested_fix:string>"


def versioned_packages(deps: DataFrame, tracked: list[str] = TRACKED) -> DataFrame:
    """Python packages with a version that some rule mentions; the last row of a name counts."""
    return (deps.where((F.col("dep_type") == "python") & S.has_version(F.col("version"))
                       & F.col("name").isin(tracked))
            .groupBy("repo_id", "name")
            .agg(F.max_by("version", "ord").alias("version"), F.min("ord").alias("ord")))


def nearest_entry(name: Column, version: Column, table: dict[str, list[dict]], metric: str) -> Column:
    """The closest entry of the row's own package; null for packages the table does not know."""
    return V.closest(version, V.version_tables(table)[name], metric)


def repo_packages(deps: DataFrame, tracked: list[str] = TRACKED, ranges=RANGES,
                  support=SUPPORT) -> DataFrame:
    """One row per repository: its rule-relevant packages in order, and as a name -> version map.

    The list holds one entry per tracked name, so its length is bounded by the rule tables. Closest
    table entries are found on the rows before they are grouped: the aggregation is a barrier, so
    that search runs once per row however often later projections use its result.
    """
    name, version = F.col("name"), F.col("version")
    fields = ["ord", "name", "version"]
    rows = versioned_packages(deps, tracked)
    if ranges:
        rows = rows.withColumn("range", nearest_entry(name, version, ranges, "weighted"))
        fields.append("range")
    if support:
        rows = rows.withColumn("support", nearest_entry(name, V.clean_version(version), support, "digits"))
        fields.append("support")
    return (rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pkgs"))
            .withColumn("pkg", F.map_from_entries(F.transform(
                "pkgs", lambda p: F.struct(p["name"], p["version"])))))


# -- pairwise and single-version rules ---------------------------------------------------------
def pairwise_hits(pkg: Column, rules=R.CONFLICT_RULES) -> Column:
    """Array of rule hits; each rule's patterns are literals, compiled once per task."""
    def hit(p1, p2, pat1, pat2, severity, resolution):
        v1, v2 = pkg[p1], pkg[p2]
        return F.when(V.clean_version(v1).rlike(pat1) & V.clean_version(v2).rlike(pat2), F.struct(
            F.lit(p1).alias("package1"), F.lit(p2).alias("package2"), v1.alias("version1"),
            v2.alias("version2"), F.lit(severity).alias("severity"),
            F.concat(F.lit(f"Version conflict between {p1} "), v1, F.lit(f" and {p2} "), v2)
            .alias("description"),
            F.lit(resolution).alias("resolution"), F.lit("version").alias("conflict_type")))

    return F.array_compact(F.array(*[hit(*r) for r in rules]))


def problem_hits(pkg: Column, rules=R.PROBLEM_VERSIONS) -> Column:
    def hit(p, version, severity, description, resolution):
        return F.when(V.clean_version(pkg[p]) == version, F.struct(
            F.lit(p).alias("package1"), F.lit("").alias("package2"), pkg[p].alias("version1"),
            F.lit("").alias("version2"), F.lit(severity).alias("severity"),
            F.lit(description).alias("description"), F.lit(resolution).alias("resolution"),
            F.lit("version").alias("conflict_type")))

    return F.array_compact(F.array(*[hit(*r) for r in rules]))


def support_hits(pkgs: Column, cuda: Column) -> Column:
    """Packages whose closest known version does not list the system's runtime."""
    mm = V.major_minor(cuda)
    bad = F.filter(pkgs, lambda p: p["support"].isNotNull() & ~F.array_contains(p["support"]["cuda"], mm))
    return F.when(cuda.isNotNull(), F.transform(bad, lambda p: F.struct(
        p["name"].alias("package1"), F.lit("CUDA").alias("package2"), p["version"].alias("version1"),
        cuda.alias("version2"), F.lit("critical").alias("severity"),
        F.concat(p["name"], F.lit(" "), V.clean_version(p["version"]),
                 F.lit(" is not compatible with CUDA "), cuda).alias("description"),
        F.concat(F.lit("Use CUDA "), F.array_join(p["support"]["cuda"], ", "), F.lit(" or adjust "),
                 p["name"], F.lit(" version")).alias("resolution"),
        F.lit("cuda").alias("conflict_type"))))


def all_conflicts(pkgs: Column, pkg: Column, cuda: Column | None = None) -> Column:
    """Pairwise, runtime and known-bad-version conflicts, most urgent first."""
    parts = [pairwise_hits(pkg), problem_hits(pkg)]
    if cuda is not None:
        parts.append(F.coalesce(support_hits(pkgs, cuda), F.array()))
    return prioritize(F.concat(*parts))


def prioritize(conflicts: Column) -> Column:
    """Severity first, runtime conflicts before others, then package names."""
    rank = S.string_map({"critical": 0, "warning": 1, "info": 2})
    keyed = F.transform(conflicts, lambda c: F.struct(
        rank[c["severity"]].alias("rank"),
        F.when(c["conflict_type"] == "cuda", 0).otherwise(1).alias("kind"),
        c["package1"].alias("p1"), c["package2"].alias("p2"), c["description"].alias("d"),
        c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def conflict_rows(repos: DataFrame, hits: Column) -> DataFrame:
    return repos.select("repo_id", F.explode(hits).alias("h")).select("repo_id", "h.*")


def pairwise_conflicts(deps: DataFrame, rules=R.CONFLICT_RULES) -> DataFrame:
    names = sorted({p for r in rules for p in r[:2]})
    return conflict_rows(repo_packages(deps, names, None, None), pairwise_hits(F.col("pkg"), rules))


def problem_versions(deps: DataFrame, rules=R.PROBLEM_VERSIONS) -> DataFrame:
    repos = repo_packages(deps, [r[0] for r in rules], None, None)
    return conflict_rows(repos, problem_hits(F.col("pkg"), rules))


def cuda_support_conflicts(deps: DataFrame, systems: DataFrame) -> DataFrame:
    repos = repo_packages(deps, list(SUPPORT), None).join(systems.select("repo_id", "cuda_version"), "repo_id")
    return conflict_rows(repos, support_hits(F.col("pkgs"), F.col("cuda_version")))


def prioritized_conflicts(deps: DataFrame, systems: DataFrame) -> DataFrame:
    repos = repo_packages(deps, ranges=None).join(
        systems.select("repo_id", "cuda_version"), "repo_id", "left")
    ranked = repos.select("repo_id", F.posexplode(
        all_conflicts(F.col("pkgs"), F.col("pkg"), F.col("cuda_version"))).alias("pos", "h"))
    return ranked.select("repo_id", (F.col("pos") + 1).cast("bigint").alias("priority"), "h.*")


# -- closest versions and runtime ranges ---------------------------------------------------------
def closest_version(deps: DataFrame, table: dict[str, list[dict]], metric: str) -> DataFrame:
    """Adds ``nearest``: the table entry closest to each row's version. A narrow projection."""
    version = V.clean_version(F.col("version")) if metric == "digits" else F.col("version")
    return (deps.where(F.col("name").isin(list(table)) & S.has_version(F.col("version")))
            .withColumn("nearest", nearest_entry(F.col("name"), version, table, metric)))


def range_check(name: Column, version: Column, near: Column, cuda: Column) -> Column:
    """struct(compatible, message): outside the range, or inside but not recommended."""
    mm = V.major_minor(cuda)
    head = F.concat(name, F.lit(" "), version)
    low = V.compare_versions(mm, near["min_cuda"]) < 0
    high = V.compare_versions(mm, near["max_cuda"]) > 0
    return F.struct(
        F.coalesce(~(low | high), F.lit(True)).alias("compatible"),
        F.when(low, F.concat(head, F.lit(" requires CUDA >= "), near["min_cuda"], F.lit(", but got "), cuda))
        .when(high, F.concat(head, F.lit(" requires CUDA <= "), near["max_cuda"], F.lit(", but got "), cuda))
        .when(~F.array_contains(near["recommended"], mm),
              F.concat(head, F.lit(" works best with CUDA "), F.array_join(near["recommended"], ", "),
                       F.lit(", using "), cuda, F.lit(" may cause issues"))).alias("message"))


def cuda_range_check(deps: DataFrame, systems: DataFrame, table=RANGES) -> DataFrame:
    near = closest_version(versioned_packages(deps, list(table)), table, "weighted")
    joined = near.join(systems.select("repo_id", "cuda_version"), "repo_id")
    checked = joined.where(F.col("cuda_version").isNotNull()).withColumn("c", range_check(
        F.col("name"), F.col("version"), F.col("nearest"), F.col("cuda_version")))
    return checked.select("repo_id", "name", "version", "cuda_version",
                          "c.compatible", "c.message")


def with_ranges(deps: DataFrame, table=RANGES) -> DataFrame:
    """Repositories with their packages of known runtime range, in order of appearance."""
    return (repo_packages(deps, list(table), table, None)
            .withColumn("ranged", F.filter("pkgs", lambda p: p["range"].isNotNull())))


def common_recommended(ranged: Column) -> Column:
    """Runtimes that all ranged packages of a repository recommend, sorted."""
    lists = F.transform(ranged, lambda r: r["range"]["recommended"])
    both = F.aggregate(lists, F.get(lists, 0), lambda acc, x: F.array_intersect(acc, x))
    return F.when(F.size(ranged) > 0, F.array_sort(both))


def recommended_cuda(deps: DataFrame) -> DataFrame:
    rec = common_recommended(F.col("ranged"))
    return (with_ranges(deps).select("repo_id", rec.alias("recommended"))
            .where(F.size("recommended") > 0)
            .withColumn("cuda_version_required", F.get("recommended", 0)))


def _list_text(a: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))


def multi_cuda_pairs(ranged: Column) -> Column:
    """Pairs of a repository's ranged packages (one entry per framework of the rule table, so a
    handful) without a common recommended runtime."""
    def against(x: Column, i: Column) -> Column:
        later = F.filter(ranged, lambda y, j: (j > i) & ~F.arrays_overlap(
            x["range"]["recommended"], y["range"]["recommended"]))
        return F.transform(later, lambda y: F.struct(
            F.concat_ws(" ", x["name"], x["version"]).alias("package1"),
            F.concat_ws(" ", y["name"], y["version"]).alias("package2"),
            F.concat(F.lit("No common CUDA version: "), x["name"], F.lit(" needs "),
                     _list_text(x["range"]["recommended"]), F.lit(", "), y["name"],
                     F.lit(" needs "), _list_text(y["range"]["recommended"])).alias("description")))

    return F.flatten(F.transform(ranged, against))


def multi_cuda_conflicts(deps: DataFrame) -> DataFrame:
    return conflict_rows(with_ranges(deps), multi_cuda_pairs(F.col("ranged")))


def compute_capability(systems: DataFrame) -> DataFrame:
    """Lowest compute capability of each system's runtime."""
    return systems.withColumn("compute_capability", S.string_map(R.CUDA_COMPUTE_CAPABILITY)[
        V.major_minor(F.col("cuda_version"))])


def runtime_conflicts(deps: DataFrame) -> DataFrame:
    """Clashing runtime families among the recommended runtimes of a repository's packages."""
    families = F.array_distinct(F.transform(F.flatten(F.transform(
        "ranged", lambda r: r["range"]["recommended"])), lambda c: F.substring_index(c, ".", 1)))
    hits = F.array_compact(F.array(*[
        F.when(F.array_contains(families, a) & F.array_contains(families, b), F.struct(
            F.lit(f"{a}.x").alias("family1"), F.lit(f"{b}.x").alias("family2"), F.lit(m).alias("message")))
        for a, b, m in R.RUNTIME_CONFLICTS]))
    return conflict_rows(with_ranges(deps), hits)


def python_support(deps: DataFrame, systems: DataFrame, matrix=R.STORED_PYTHON_MATRIX) -> DataFrame:
    """Whether the closest stored framework version allows each repository's Python version."""
    alias = {"pytorch": "torch"}
    table: dict[str, list[dict]] = {}
    for package, version, pythons in matrix:
        table.setdefault(alias.get(package, package), []).append(
            {"version": version, "pythons": pythons})
    near = closest_version(versioned_packages(deps, list(table)), table, "weighted")
    joined = near.join(systems.select("repo_id", "python_version"), "repo_id")
    mm = V.major_minor(F.col("python_version"))
    return joined.where(F.col("nearest").isNotNull()).select(
        "repo_id", "name", "version", F.col("nearest.version").alias("closest_version"),
        mm.alias("python"), F.array_contains("nearest.pythons", mm).alias("supported"))


# -- the issue table and the analysis summary --------------------------------------------------------
def _issue(kind, severity, message, component, fix) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("type"), lit(severity).alias("severity"),
                    lit(message).alias("message"), lit(component).alias("component"),
                    lit(fix).alias("suggested_fix"))


def detect_issues(deps: DataFrame, raw_deps: DataFrame, systems: DataFrame,
                  docs: DataFrame) -> DataFrame:
    """Every kind of compatibility issue, one row each.

    ``deps`` are de-duplicated, ``raw_deps`` are not (duplicate versions are found there),
    ``systems`` gives a runtime per repository and ``docs`` whether its documentation mentions it.
    """
    gpu = deps.groupBy("repo_id").agg(F.bool_or("gpu_required").alias("gpu"))
    repos = (gpu.join(repo_packages(deps), "repo_id", "left")
             .join(systems.select("repo_id", "cuda_version"), "repo_id", "left")
             .join(docs.select("repo_id", "cuda_mentioned"), "repo_id", "left")
             .withColumn("pkg", F.coalesce("pkg", F.expr("cast(map() as map<string,string>)")))
             .withColumn("ranged", F.filter("pkgs", lambda p: p["range"].isNotNull())))
    pkg, cuda, ranged = F.col("pkg"), F.col("cuda_version"), F.col("ranged")
    conflicts = F.transform(all_conflicts(F.col("pkgs"), pkg, cuda), lambda c: _issue(
        c["conflict_type"], c["severity"], c["description"],
        F.concat_ws("-", c["package1"], c["package2"]), c["resolution"]))
    checked = F.filter(ranged, lambda r: r["name"].isin(R.RANGE_CHECKED_FRAMEWORKS))
    ranges = F.when(cuda.isNotNull(), F.filter(
        F.transform(checked, lambda r: F.struct(
            range_check(r["name"], r["version"], r["range"], cuda).alias("c"), r["name"].alias("name"))),
        lambda x: ~x["c"]["compatible"]))
    range_issues = F.transform(F.coalesce(ranges, F.array()), lambda x: _issue(
        "cuda_incompatibility", "critical", x["c"]["message"], x["name"],
        F.concat(F.lit("Install compatible CUDA version for "), x["name"])))
    multi = F.transform(F.coalesce(multi_cuda_pairs(ranged), F.array()), lambda p: _issue(
        "cuda_version_conflict", "critical", p["description"],
        F.concat_ws("-", p["package1"], p["package2"]),
        "Use a single ML framework or ensure CUDA compatibility"))
    rec = common_recommended(ranged)
    recommend = F.when((F.size(rec) > 0) & cuda.isNull(), _issue(
        "cuda_recommendation", "info",
        F.concat(F.lit("Recommended CUDA versions: "), F.array_join(rec, ", ")), "cuda",
        F.concat(F.lit("Install CUDA "), F.get(rec, 0), F.lit(" for best compatibility"))))
    undocumented = F.when(F.col("gpu") & ~F.coalesce("cuda_mentioned", F.lit(False)), _issue(
        "gpu_requirement", "warning",
        "Repository appears to require GPU but CUDA setup not clearly documented",
        "gpu_dependencies", "Ensure CUDA toolkit is installed and configured"))
    singles = F.array_compact(F.array(recommend, undocumented))
    found = repos.select("repo_id", F.explode(F.concat(
        conflicts, range_issues, multi, singles)).alias("i")).select("repo_id", "i.*")
    dup = inconsistent_issue_rows(raw_deps)
    return found.unionByName(dup)


def inconsistent_issue_rows(raw_deps: DataFrame) -> DataFrame:
    from stacklens.operators.dependencies import inconsistent_versions

    row = _issue("duplicate_dependency", "warning",
                 F.concat(F.lit("Package '"), F.col("name"),
                          F.lit("' specified multiple times with different versions: "),
                          F.array_join("versions", ", ")),
                 F.col("name"), "Consolidate to a single compatible version")
    return inconsistent_versions(raw_deps).select("repo_id", row.alias("i")).select("repo_id", "i.*")


def critical_issues(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity") == "critical")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issue counts per repository; pre-aggregated before the shuffle."""
    low = F.lower("message")
    versioned = low.contains("version")
    n = lambda cond: F.count_if(cond)
    return issues.groupBy("repo_id").agg(
        F.count("*").alias("issues_count"),
        n(F.col("severity") == "critical").alias("critical_issues"),
        n(F.col("severity") == "warning").alias("warning_issues"),
        n(S.contains_any(low, ["gpu", "cuda", "nvidia", "amd", "rocm", "opencl"])).alias("gpu_issues"),
        n(S.contains_any(low, ["cuda", "nvidia"]) & versioned).alias("cuda_version_conflicts"),
        n(S.contains_any(low, ["python", "py"]) & versioned).alias("python_version_conflicts"))


def analysis_summary(deps: DataFrame, findings: DataFrame) -> DataFrame:
    """Analysis row per repository: file flags, GPU needs, confidence.

    ``findings`` gives ``has_dockerfile`` and ``python_version_required`` per repository.
    """
    src = F.substring_index("source", ":", 1)
    agg = deps.groupBy("repo_id").agg(
        F.count("*").alias("dependencies_count"),
        F.bool_or("gpu_required").alias("any_gpu"),
        F.max(F.when(F.col("gpu_required") & F.col("name").isin(R.GPU_MEMORY_PACKAGES), 4.0)
              .otherwise(0.0)).alias("min_gpu_memory_gb"),
        F.bool_or(F.col("source").contains("environment.yml")).alias("has_conda_env"),
        F.bool_or(F.col("source").contains("requirements.txt")).alias("has_requirements"),
        F.bool_or(F.col("source").contains("setup.py")).alias("has_setup_py"),
        F.bool_or(F.col("source").contains("pyproject.toml")).alias("has_pyproject_toml"),
        F.bool_or(src == "requirements.txt").alias("_req"),
        F.bool_or(src.isin("setup.py", "pyproject.toml")).alias("_setup"))
    joined = agg.join(findings, "repo_id", "left")
    docker = F.coalesce("has_dockerfile", F.lit(False))
    return joined.select(
        "repo_id", "dependencies_count",
        (F.col("any_gpu") | (F.col("min_gpu_memory_gb") > 0)).alias("gpu_required"),
        "min_gpu_memory_gb", "has_conda_env", "has_requirements", "has_setup_py",
        "has_pyproject_toml", docker.alias("has_dockerfile"), "python_version_required",
        S.confidence_score(F.col("dependencies_count"), F.col("_req"), F.col("_setup"), docker,
                           F.col("python_version_required")).alias("confidence_score"))
