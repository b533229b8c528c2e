"""Views that only the checking engine uses: independent SQL forms of shared steps."""

from __future__ import annotations

from stacklens.rules import fixed as R


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


CLEAN = "trim(regexp_replace(regexp_replace({v}, '^[><=~^!]+', ''), '[,<>=~^!].*$', ''))"
MM = "array_to_string(string_split({v}, '.')[1:2], '.')"
NUM = "coalesce(TRY_CAST(regexp_extract({v}, '(\\d+)\\.(\\d+)') AS DOUBLE), 0.0)"

_rules = ", ".join(f"({i}, {', '.join(q(x) for x in r)})" for i, r in enumerate(R.CONFLICT_RULES))
_problems = ", ".join(f"({', '.join(q(x) for x in r)})" for r in R.PROBLEM_VERSIONS)
_support = ", ".join(f"({q(p)}, {q(v)}, {i}, {lst(c)})" for p, rows in R.CUDA_SUPPORT.items()
                     for i, (v, c) in enumerate(rows))
_ranges = ", ".join(f"({q(p)}, {q(v)}, {i}, {q(a)}, {q(b)}, {lst(c)})" for p, rows in R.CUDA_RANGES.items()
                    for i, (v, a, b, c) in enumerate(rows))
_strategies = ", ".join(f"({q(n)}, {p}, {s}, {m})" for n, p, s, m, _ in R.STRATEGIES)
_fixes = ", ".join(f"({q(k)}, {q(v)})" for k, v in R.ERROR_FIXES.items())

ERR8 = ("CASE WHEN {m} IS NULL OR {m} = '' THEN 'no_error' "
        + " ".join(f"WHEN {contains_any('lower({m})', ws)} THEN {q(c)}" for c, ws in R.ERROR_CATEGORIES)
        + " ELSE 'unknown_error' END")
ERR6 = ("CASE " + " ".join(f"WHEN {contains_any('lower({m})', ws)} THEN {q(c)}" for c, ws in R.ERROR_CATEGORIES[:5])
        + " ELSE 'unknown_error' END")

OV: dict[str, str] = {}
OV["v_rules"] = f"SELECT * FROM (VALUES {_rules}) t(rule_ord, p1, p2, pat1, pat2, severity, resolution)"
OV["v_problems"] = f"SELECT * FROM (VALUES {_problems}) t(package, bad, severity, description, resolution)"
OV["v_support"] = f"SELECT * FROM (VALUES {_support}) t(package, known, rule_ord, cuda)"
OV["v_ranges"] = f"SELECT * FROM (VALUES {_ranges}) t(package, known, rule_ord, min_cuda, max_cuda, rec)"
OV["v_strategies"] = f"SELECT * FROM (VALUES {_strategies}) t(strategy, priority, setup_seconds, size_mb)"
OV["v_fixes"] = f"SELECT * FROM (VALUES {_fixes}) t(error_type, fix)"

# the ordered replacement rule, as a fold over each group in order of appearance
OV["v_dedup"] = """
SELECT repo_id, r.ord AS ord, r.name AS name, r.version AS version, r.op AS op, r.dep_type AS dep_type,
       r.source AS source, r.gpu_required AS gpu_required, first_ord
FROM (SELECT repo_id, min(ord) AS first_ord, list_reduce(
        list({'ord': ord, 'name': name, 'version': version, 'op': op, 'dep_type': dep_type, 'source': source, 'gpu_required': gpu_required} ORDER BY ord),
        lambda acc, x: CASE WHEN (x.version IS NOT NULL AND acc.version IS NULL) OR (x.gpu_required AND NOT acc.gpu_required) THEN x ELSE acc END) AS r
      FROM v_deps GROUP BY repo_id, lower(name))
"""
OV["v_pinned"] = f"SELECT repo_id, ord, name, version, {CLEAN.format(v='version')} AS clean FROM v_dedup WHERE version IS NOT NULL"
OV["v_pairwise"] = """
SELECT a.repo_id, r.p1 AS package1, r.p2 AS package2, a.version AS version1, b.version AS version2, r.severity,
       'Version conflict between ' || r.p1 || ' ' || a.version || ' and ' || r.p2 || ' ' || b.version AS description,
       r.resolution, 'version' AS conflict_type
FROM v_rules r JOIN v_pinned a ON a.name = r.p1 JOIN v_pinned b ON b.name = r.p2 AND b.repo_id = a.repo_id
WHERE regexp_matches(a.clean, r.pat1) AND regexp_matches(b.clean, r.pat2)
"""
OV["v_bad"] = """
SELECT d.repo_id, d.name AS package1, '' AS package2, d.version AS version1, '' AS version2, p.severity,
       p.description, p.resolution, 'version' AS conflict_type
FROM v_pinned d JOIN v_problems p ON d.name = p.package AND d.clean = p.bad
"""
OV["v_near_support"] = """
SELECT d.repo_id, d.name, d.version, d.clean, arg_min({'known': s.known, 'cuda': s.cuda},
       abs(CAST(replace(d.clean, '.', '') AS DOUBLE) - CAST(replace(s.known, '.', '') AS DOUBLE)) * 1000 + s.rule_ord) AS near
FROM v_pinned d JOIN v_support s ON d.name = s.package GROUP BY ALL
"""
_dist = " + ".join(f"abs(CAST(split_part(d.version, '.', {i}) AS BIGINT) - CAST(split_part(s.known, '.', {i}) AS BIGINT)) * {w}"
                   for i, w in ((1, 10000), (2, 100), (3, 1)))
OV["v_near_range"] = f"""
SELECT d.repo_id, d.ord, d.name, d.version, arg_min({{'known': s.known, 'lo': s.min_cuda, 'hi': s.max_cuda, 'rec': s.rec}}, ({_dist}) * 1000 + s.rule_ord) AS near
FROM v_pinned d JOIN v_ranges s ON d.name = s.package GROUP BY d.repo_id, d.ord, d.name, d.version
"""
OV["v_cuda_conflicts"] = f"""
SELECT n.repo_id, n.name AS package1, 'CUDA' AS package2, n.version AS version1, s.cuda_version AS version2, 'critical' AS severity,
       n.name || ' ' || n.clean || ' is not compatible with CUDA ' || s.cuda_version AS description,
       'Use CUDA ' || array_to_string(n.near.cuda, ', ') || ' or adjust ' || n.name || ' version' AS resolution, 'cuda' AS conflict_type
FROM v_near_support n JOIN v_repo_systems s ON n.repo_id = s.repo_id
WHERE s.cuda_version IS NOT NULL AND NOT list_contains(n.near.cuda, {MM.format(v='s.cuda_version')})
"""
OV["v_all_conflicts"] = "SELECT * FROM v_pairwise UNION ALL SELECT * FROM v_bad UNION ALL SELECT * FROM v_cuda_conflicts"
_mmnum = "CAST(split_part({v}, '.', 1) AS INT) * 1000 + CAST(split_part({v}, '.', 2) AS INT)"
OV["v_range_check"] = f"""
SELECT repo_id, name, version, cuda_version, (low OR high) AS bad,
       CASE WHEN low THEN name || ' ' || version || ' requires CUDA >= ' || lo || ', but got ' || cuda_version
            WHEN high THEN name || ' ' || version || ' requires CUDA <= ' || hi || ', but got ' || cuda_version
            WHEN NOT list_contains(rec, {MM.format(v='cuda_version')}) THEN name || ' ' || version || ' works best with CUDA ' || array_to_string(rec, ', ') || ', using ' || cuda_version || ' may cause issues' END AS message
FROM (SELECT n.repo_id, n.name, n.version, s.cuda_version, n.near.lo AS lo, n.near.hi AS hi, n.near.rec AS rec,
             {_mmnum.format(v='s.cuda_version')} < {_mmnum.format(v='n.near.lo')} AS low,
             {_mmnum.format(v='s.cuda_version')} > {_mmnum.format(v='n.near.hi')} AS high
      FROM v_near_range n JOIN v_repo_systems s ON n.repo_id = s.repo_id WHERE s.cuda_version IS NOT NULL)
"""
OV["v_recommended"] = """
SELECT repo_id, list_sort(list(c)) AS recommended, min(c) AS cuda_version_required
FROM (SELECT r.repo_id, r.c FROM (SELECT repo_id, unnest(near.rec) AS c FROM v_near_range) r
      JOIN (SELECT repo_id, count(*) AS n FROM v_near_range GROUP BY 1) k ON r.repo_id = k.repo_id
      GROUP BY r.repo_id, r.c, k.n HAVING count(*) = k.n) GROUP BY 1
"""
OV["v_multi"] = """
SELECT a.repo_id, a.name || ' ' || a.version AS package1, b.name || ' ' || b.version AS package2,
       'No common CUDA version: ' || a.name || ' needs [''' || array_to_string(a.near.rec, ''', ''') || '''], ' || b.name || ' needs [''' || array_to_string(b.near.rec, ''', ''') || ''']' AS description
FROM v_near_range a JOIN v_near_range b ON a.repo_id = b.repo_id AND a.ord < b.ord
WHERE NOT list_has_any(a.near.rec, b.near.rec)
"""
OV["v_dups"] = """
SELECT repo_id, lower(name) AS name, list_sort(list(DISTINCT version)) AS versions FROM v_deps
WHERE version IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT version) > 1
"""
OV["v_issues"] = f"""
SELECT repo_id, conflict_type AS type, severity, description AS message, package1 || '-' || package2 AS component, resolution AS suggested_fix FROM v_all_conflicts
UNION ALL SELECT repo_id, 'cuda_incompatibility', 'critical', message, name, 'Install compatible CUDA version for ' || name FROM v_range_check
  WHERE bad AND name IN {inlist(R.RANGE_CHECKED_FRAMEWORKS)}
UNION ALL SELECT repo_id, 'cuda_version_conflict', 'critical', description, package1 || '-' || package2, 'Use a single ML framework or ensure CUDA compatibility' FROM v_multi
UNION ALL SELECT r.repo_id, 'cuda_recommendation', 'info', 'Recommended CUDA versions: ' || array_to_string(r.recommended, ', '), 'cuda', 'Install CUDA ' || r.cuda_version_required || ' for best compatibility'
  FROM v_recommended r LEFT JOIN v_repo_systems s ON r.repo_id = s.repo_id WHERE s.cuda_version IS NULL
UNION ALL SELECT g.repo_id, 'gpu_requirement', 'warning', 'Repository appears to require GPU but CUDA setup not clearly documented', 'gpu_dependencies', 'Ensure CUDA toolkit is installed and configured'
  FROM (SELECT repo_id FROM v_dedup GROUP BY 1 HAVING bool_or(gpu_required)) g LEFT JOIN v_repos r ON g.repo_id = r.repo_id WHERE NOT coalesce(r.cuda_mentioned, false)
UNION ALL SELECT repo_id, 'duplicate_dependency', 'warning', 'Package ''' || name || ''' specified multiple times with different versions: ' || array_to_string(versions, ', '), name, 'Consolidate to a single compatible version' FROM v_dups
"""
OV["v_counts"] = f"""
SELECT repo_id, count(*) AS total_dependencies, count(*) FILTER (gpu_required) AS gpu_dependencies,
       count(*) FILTER (lower(name) IN {inlist(R.ML_PACKAGES)}) AS ml_dependencies,
       count(DISTINCT CASE WHEN lower(name) IN {inlist(R.ML_PACKAGES)} THEN 'ml' WHEN gpu_required THEN 'gpu' WHEN contains(lower(name), 'test') THEN 'test' WHEN contains(lower(name), 'dev') THEN 'dev' ELSE 'other' END) / count(*) AS dependency_diversity,
       count(*) FILTER (version IS NOT NULL AND version <> '*') AS version_constraints,
       count(*) FILTER (version IS NOT NULL AND NOT regexp_matches(version, '[><~]|!=')) AS pinned_versions,
       max(CASE WHEN gpu_required AND name IN ('torch', 'tensorflow') THEN 4.0 ELSE 0.0 END) AS min_gpu_memory_gb
FROM v_dedup GROUP BY 1
"""
OV["v_features"] = f"""
SELECT r.repo_id, r.name, r.description, r.language, r.stars, r.has_dockerfile, CASE WHEN topic1 = topic2 THEN 1 ELSE 2 END AS topics_count,
       coalesce(c.total_dependencies, 0) AS total_dependencies, coalesce(c.gpu_dependencies, 0) AS gpu_dependencies,
       coalesce(c.ml_dependencies, 0) AS ml_dependencies, coalesce(c.dependency_diversity, 0.0) AS dependency_diversity,
       coalesce(c.version_constraints, 0) AS version_constraints, coalesce(c.pinned_versions, 0) AS pinned_versions,
       coalesce(CAST(c.min_gpu_memory_gb AS DOUBLE), 0.0) AS min_gpu_memory_gb,
       {NUM.format(v='r.python_version_required')} AS python_version_required, {NUM.format(v='k.cuda_version_required')} AS cuda_version_required,
       coalesce(c.ml_dependencies, 0) >= 2 AS is_ml_repo, r.system_id
FROM v_repos r LEFT JOIN v_counts c ON r.repo_id = c.repo_id LEFT JOIN v_recommended k ON r.repo_id = k.repo_id
"""
OV["v_records"] = f"""
SELECT o.outcome_id AS record_id, o.repo_id, o.ts, f.ml_dependencies, f.gpu_dependencies, f.total_dependencies, f.is_ml_repo,
       f.python_version_required, f.cuda_version_required, s.gpu_count, s.memory_gb, s.cpu_cores,
       (s.gpu_count > 0 AND contains(lower(s.gpu_name), 'nvidia')) AS has_nvidia_gpu, o.strategy, o.setup_time,
       (o.strategy = 'docker' AND f.gpu_dependencies > 0) AS has_gpu_support, o.success, o.duration,
       {ERR8.format(m='o.error_message')} AS error_type
FROM v_outcomes o JOIN v_features f ON o.repo_id = f.repo_id JOIN v_systems s ON f.system_id = s.system_id
"""
