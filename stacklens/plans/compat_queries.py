"""Queries over dependencies, compatibility rules, repository files, logs and environments."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.functions import versions as V
from stacklens.operators import conflicts as C
from stacklens.operators import dependencies as D
from stacklens.operators import features as FE
from stacklens.operators import logs as L
from stacklens.operators import repository as RP
from stacklens.operators import strategies as ST
from stacklens.plans.oracle_views import CLEAN, MM, NUM, contains_any, inlist, lst, q
from stacklens.plans.registry import query
from stacklens.rules import fixed as R
from stacklens.sources import tables as TB

JOIN = lambda c: F.array_join(c, "|").alias(c)
CONFLICT = "repo_id, package1, package2, version1, version2, severity, description, resolution, conflict_type"
ISSUE = "repo_id, type, severity, message, component, suggested_fix"

# -- dependencies -------------------------------------------------------------------------------------
query("q_dedup", "SELECT repo_id, name, version, ord, gpu_required, source, first_ord FROM v_dedup")(
    lambda c: c.deps.select("repo_id", "name", "version", "ord", "gpu_required", "source", "first_ord"))

query("q_duplicates", "SELECT repo_id, name, array_to_string(versions, '|') AS versions FROM v_dups")(
    lambda c: D.inconsistent_versions(c.v_deps).select("repo_id", "name", JOIN("versions")))

query("q_python_deps", "SELECT repo_id, name, version FROM v_dedup WHERE dep_type = 'python'")(
    lambda c: D.python_dependencies(c.deps).select("repo_id", "name", "version"))

# -- rule checks ----------------------------------------------------------------------------------------
query("q_conflicts", f"SELECT {CONFLICT} FROM v_pairwise")(lambda c: C.pairwise_conflicts(c.deps))
query("q_problem_versions", f"SELECT {CONFLICT} FROM v_bad")(lambda c: C.problem_versions(c.deps))
query("q_cuda_support", f"SELECT {CONFLICT} FROM v_cuda_conflicts")(
    lambda c: C.cuda_support_conflicts(c.deps, c.v_repo_systems))
query("q_prioritized", f"""
SELECT {CONFLICT}, row_number() OVER (PARTITION BY repo_id ORDER BY
         CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
         CASE conflict_type WHEN 'cuda' THEN 0 ELSE 1 END, package1, package2, description) AS priority
FROM v_all_conflicts""")(lambda c: C.prioritized_conflicts(c.deps, c.v_repo_systems))
query("q_closest_cuda_digits", "SELECT repo_id, name, version, near.known AS closest, array_to_string(near.cuda, '|') AS cuda FROM v_near_support")(
    lambda c: C.closest_version(c.deps, C.SUPPORT, "digits").select(
        "repo_id", "name", "version", F.col("nearest.version").alias("closest"), F.array_join("nearest.cuda", "|").alias("cuda")))
query("q_closest_cuda_weighted", "SELECT repo_id, name, version, near.known AS closest, near.lo AS min_cuda, near.hi AS max_cuda FROM v_near_range")(
    lambda c: C.closest_version(c.deps, C.RANGES, "weighted").select(
        "repo_id", "name", "version", F.col("nearest.version").alias("closest"), "nearest.min_cuda", "nearest.max_cuda"))
query("q_cuda_range", "SELECT repo_id, name, version, cuda_version, NOT bad AS compatible, message FROM v_range_check")(
    lambda c: C.cuda_range_check(c.deps, c.v_repo_systems))
query("q_cuda_recommended", "SELECT repo_id, array_to_string(recommended, '|') AS recommended, cuda_version_required FROM v_recommended")(
    lambda c: C.recommended_cuda(c.deps).select("repo_id", JOIN("recommended"), "cuda_version_required"))
query("q_cuda_multi", "SELECT repo_id, package1, package2, description FROM v_multi")(
    lambda c: C.multi_cuda_conflicts(c.deps))
query("q_runtime_families", """
WITH fam AS (SELECT DISTINCT repo_id, split_part(c, '.', 1) AS f FROM (SELECT repo_id, unnest(near.rec) AS c FROM v_near_range))
SELECT a.repo_id, r.a || '.x' AS family1, r.b || '.x' AS family2, r.m AS message
FROM (VALUES """ + ", ".join(f"({q(a)}, {q(b)}, {q(m)})" for a, b, m in R.RUNTIME_CONFLICTS) + """) r(a, b, m)
JOIN fam a ON a.f = r.a JOIN fam b ON b.f = r.b AND a.repo_id = b.repo_id""")(
    lambda c: C.runtime_conflicts(c.deps))
query("q_compute_capability", "SELECT system_id, cuda_version, CASE " + " ".join(
    f"WHEN {MM.format(v='cuda_version')} = {q(k)} THEN {q(v)}" for k, v in R.CUDA_COMPUTE_CAPABILITY.items())
    + " END AS compute_capability FROM v_systems")(
    lambda c: C.compute_capability(c.v_systems).select("system_id", "cuda_version", "compute_capability"))
_pym = ", ".join(f"({q({'pytorch': 'torch'}.get(p, p))}, {q(v)}, {i}, {lst(x)})" for i, (p, v, x) in enumerate(R.STORED_PYTHON_MATRIX))
query("q_python_support", f"""
WITH near AS (SELECT d.repo_id, d.name, d.version, arg_min({{'v': m.known, 'py': m.py}},
        (abs(CAST(split_part(d.version, '.', 1) AS BIGINT) - CAST(split_part(m.known, '.', 1) AS BIGINT)) * 10000
       + abs(CAST(split_part(d.version, '.', 2) AS BIGINT) - CAST(split_part(m.known, '.', 2) AS BIGINT)) * 100
       + abs(CAST(split_part(d.version, '.', 3) AS BIGINT) - CAST(split_part(m.known, '.', 3) AS BIGINT))) * 1000 + m.o) AS n
  FROM v_pinned d JOIN (VALUES {_pym}) m(package, known, o, py) ON d.name = m.package GROUP BY d.repo_id, d.name, d.version)
SELECT near.repo_id, near.name, near.version, near.n.v AS closest_version, {MM.format(v='s.python_version')} AS python,
       list_contains(near.n.py, {MM.format(v='s.python_version')}) AS supported
FROM near JOIN v_repo_systems s ON near.repo_id = s.repo_id""")(
    lambda c: C.python_support(c.deps, c.v_repo_systems))
query("q_issues", f"SELECT {ISSUE} FROM v_issues")(lambda c: c.issues)
query("q_critical_issues", f"SELECT {ISSUE} FROM v_issues WHERE severity = 'critical'")(
    lambda c: C.critical_issues(c.issues))
query("q_issue_counts", f"""
SELECT repo_id, count(*) AS issues_count, count(*) FILTER (severity = 'critical') AS critical_issues,
       count(*) FILTER (severity = 'warning') AS warning_issues,
       count(*) FILTER ({contains_any('lower(message)', ['gpu', 'cuda', 'nvidia', 'amd', 'rocm', 'opencl'])}) AS gpu_issues,
       count(*) FILTER ({contains_any('lower(message)', ['cuda', 'nvidia'])} AND contains(lower(message), 'version')) AS cuda_version_conflicts,
       count(*) FILTER ({contains_any('lower(message)', ['python', 'py'])} AND contains(lower(message), 'version')) AS python_version_conflicts
FROM v_issues GROUP BY 1""")(lambda c: C.issue_counts(c.issues))
query("q_issues_by_severity", "SELECT type, severity, count(*) AS issues, count(DISTINCT repo_id) AS repos FROM v_issues GROUP BY 1, 2")(
    lambda c: c.issues.groupBy("repo_id", "type", "severity").agg(F.count("*").alias("n"))
    .groupBy("type", "severity").agg(F.sum("n").alias("issues"), F.count("*").alias("repos")))
query("q_analysis_summary", """
WITH a AS (SELECT repo_id, count(*) AS n, bool_or(gpu_required) AS gpu, max(CASE WHEN gpu_required AND name IN ('torch', 'tensorflow') THEN 4.0 ELSE 0.0 END) AS mem,
    bool_or(contains(source, 'environment.yml')) AS env, bool_or(contains(source, 'requirements.txt')) AS req,
    bool_or(contains(source, 'setup.py')) AS setup, bool_or(contains(source, 'pyproject.toml')) AS proj FROM v_dedup GROUP BY 1)
SELECT a.repo_id, n AS dependencies_count, (gpu OR mem > 0) AS gpu_required, CAST(mem AS DOUBLE) AS min_gpu_memory_gb, env AS has_conda_env,
       req AS has_requirements, setup AS has_setup_py, proj AS has_pyproject_toml, coalesce(r.has_dockerfile, false) AS has_dockerfile,
       r.python_version_required,
       round(CAST(least(0.4 + CASE WHEN req THEN 0.2 ELSE 0 END + CASE WHEN setup OR proj THEN 0.2 ELSE 0 END
       + CASE WHEN coalesce(r.has_dockerfile, false) THEN 0.1 ELSE 0 END + CASE WHEN r.python_version_required IS NOT NULL THEN 0.1 ELSE 0 END, 1.0) AS DOUBLE), 6) AS confidence_score
FROM a LEFT JOIN v_repos r ON a.repo_id = r.repo_id""")(
    lambda c: C.analysis_summary(c.deps, c.v_repos.select("repo_id", "has_dockerfile", "python_version_required"))
    .withColumn("confidence_score", F.round("confidence_score", 6)))

# -- version functions -------------------------------------------------------------------------------------
_cmp = ", ".join(f"{f} AS {n}" for n, f in {
    "clean": CLEAN.format(v="spec"), "mm": MM.format(v="version"),
    "number": NUM.format(v="version"),
    "normal": "regexp_replace(regexp_replace('v' || version, '^[vV]', ''), '[._-]+', '.', 'g')",
    "vs_two": "CASE WHEN CAST(split_part(version, '.', 1) AS INT) * 1000000 + CAST(split_part(version, '.', 2) AS INT) * 1000 + CAST(split_part(version, '.', 3) AS INT) < 2000000 THEN -1 WHEN version = '2.0.0' THEN 0 ELSE 1 END"}.items())
query("q_versions", f"SELECT repo_id, ord, spec, {_cmp} FROM (SELECT repo_id, ord, version, op || version || ',<99' AS spec FROM v_deps WHERE version IS NOT NULL)")(
    lambda c: c.v_deps.where("version IS NOT NULL").withColumn("spec", F.concat("op", "version", F.lit(",<99"))).select(
        "repo_id", "ord", "spec", V.clean_version(F.col("spec")).alias("clean"), V.major_minor(F.col("version")).alias("mm"),
        V.version_number(F.col("version")).alias("number"),
        V.normalize_version(F.concat(F.lit("v"), "version")).alias("normal"),
        V.compare_versions(F.col("version"), F.lit("2")).alias("vs_two")))
query("q_categories", f"""
SELECT CASE WHEN lower(name) IN {inlist(R.ML_PACKAGES)} THEN 'ml' WHEN gpu_required THEN 'gpu' WHEN contains(lower(name), 'test') THEN 'test' WHEN contains(lower(name), 'dev') THEN 'dev' ELSE 'other' END AS category,
       (name IN {inlist(R.GPU_REQUIREMENT_PACKAGES)}) AS listed_gpu, count(*) AS n FROM v_deps GROUP BY 1, 2""")(
    lambda c: c.v_deps.groupBy(S.dependency_category(F.col("name"), F.col("gpu_required")).alias("category"),
                               S.flag_gpu(F.col("name")).alias("listed_gpu")).agg(F.count("*").alias("n")))

# -- repository files -----------------------------------------------------------------------------------------
_req_line = r"regexp_extract(body, '^([a-zA-Z0-9_-]+)\s*([><=!~]+)\s*([0-9.]+.*?)$', {g})"
query("q_parse_requirements", f"""
WITH raw AS (SELECT repo_id, ord AS file_ord, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM v_manifests),
body AS (SELECT *, trim(split_part(trim(line), '#', 1)) AS body FROM raw WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '-r '))
SELECT repo_id, 'req/' || CAST(file_ord AS VARCHAR) || '.txt' AS path, CAST(pos - 1 AS INTEGER) AS pos, lower(CASE WHEN {_req_line.format(g=1)} <> '' THEN {_req_line.format(g=1)} ELSE body END) AS name,
       nullif({_req_line.format(g=3)}, '') AS version, nullif({_req_line.format(g=2)}, '') AS op, 'requirements.txt:L' || pos AS source,
       lower(CASE WHEN {_req_line.format(g=1)} <> '' THEN {_req_line.format(g=1)} ELSE body END) IN {inlist(R.GPU_REQUIREMENT_PACKAGES)} AS gpu_required
FROM body WHERE {_req_line.format(g=1)} <> '' OR regexp_matches(body, '^[a-zA-Z0-9_-]+$')""")(
    lambda c: D.parse_requirements(c.v_manifests.withColumn("path", F.concat(F.lit("req/"), F.col("ord").cast("string"), F.lit(".txt")))).select(
        "repo_id", "ord.path", "ord.pos", "name", "version", "op", "source", "gpu_required"))
_setup_sql = f"""
WITH b AS (SELECT repo_id, content, regexp_extract(content, 'install_requires=\\[([^\\]]*)\\]', 1) AS block FROM v_setup_files),
s AS (SELECT repo_id, unnest(regexp_extract_all(block, '"([^"]+)"', 1)) AS body FROM b)
SELECT repo_id, lower(CASE WHEN {_req_line.format(g=1)} <> '' THEN {_req_line.format(g=1)} ELSE body END) AS name,
       nullif({_req_line.format(g=3)}, '') AS version, 'setup.py' AS source FROM s"""
query("q_setup_py", _setup_sql)(lambda c: D.parse_setup_py(c.v_setup_files).select("repo_id", "name", "version", "source"))
query("q_setup_py_exact", _setup_sql)(
    lambda c: D.parse_setup_py(c.v_setup_files, "exact").select("repo_id", "name", "version", "source"))
_pyproject_sql = f"""
WITH s AS (SELECT repo_id, unnest(regexp_extract_all(regexp_extract(content, 'dependencies = \\[([^\\]]*)\\]', 1), '"([^"]+)"', 1)) AS body FROM v_pyproject_files),
t AS (SELECT repo_id, unnest(string_split(split_part(split_part(content, '[tool.poetry.dependencies]', 2), chr(10) || '[', 1), chr(10))) AS line FROM v_pyproject_files)
SELECT repo_id, lower(CASE WHEN {_req_line.format(g=1)} <> '' THEN {_req_line.format(g=1)} ELSE body END) AS name,
       nullif({_req_line.format(g=3)}, '') AS version FROM s
UNION ALL SELECT repo_id, regexp_extract(line, '^([A-Za-z0-9_.-]+) =', 1),
       CASE WHEN contains(line, 'version') THEN regexp_extract(line, 'version = "([^"]*)"', 1) ELSE regexp_extract(line, '= "([^"]*)"', 1) END
FROM t WHERE regexp_matches(line, '^[A-Za-z0-9_.-]+ =') AND NOT starts_with(line, 'python ')"""
query("q_pyproject", _pyproject_sql)(lambda c: D.parse_pyproject(c.v_pyproject_files).select("repo_id", "name", "version"))
query("q_pyproject_exact", _pyproject_sql)(
    lambda c: D.parse_pyproject(c.v_pyproject_files, "exact").select("repo_id", "name", "version"))
_map = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.IMPORT_MAP.items())
_imports_sql = f"""
WITH l AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line FROM v_source_files),
m AS (SELECT repo_id, path, unnest(string_split(regexp_extract(line, '^\\s*import ([^#;]+)', 1), ',')) AS head FROM l
      UNION ALL SELECT repo_id, path, regexp_extract(line, '^\\s*from ([A-Za-z_][A-Za-z0-9_.]*) import', 1) FROM l),
t AS (SELECT DISTINCT repo_id, path, regexp_extract(head, '^\\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS top FROM m),
n AS (SELECT repo_id, path, CASE top {_map} ELSE top END AS name FROM t WHERE top <> '')
SELECT repo_id, name, 'imports:' || path AS source, name IN {inlist(R.GPU_IMPORT_PACKAGES)} AS gpu_required FROM n WHERE name NOT IN {inlist(R.IMPORT_SKIP)}"""
query("q_imports", _imports_sql)(
    lambda c: D.scan_imports(c.v_source_files).select("repo_id", "name", "source", "gpu_required"))
query("q_imports_exact", _imports_sql)(
    lambda c: D.scan_imports(c.v_source_files, "exact").select("repo_id", "name", "source", "gpu_required"))


def _all_sources(c):
    parsed = D.union_sources(D.parse_requirements(c.v_requirement_files), D.parse_setup_py(c.v_setup_files),
                             D.parse_pyproject(c.v_pyproject_files), D.scan_imports(c.v_source_files))
    return D.dedup_dependencies(parsed).select(
        "repo_id", "name", "version", "op", "source", "gpu_required", F.col("ord.path").alias("path"),
        F.concat_ws(":", *(F.col("first_ord")[x].cast("string") for x in ("rank", "path", "pos"))).alias("first_seen"))


_spec_cols = f"""lower(CASE WHEN {_req_line.format(g=1)} <> '' THEN {_req_line.format(g=1)} ELSE body END) AS name,
  nullif({_req_line.format(g=3)}, '') AS version, nullif({_req_line.format(g=2)}, '') AS op"""
_gpu = f"name IN {inlist(R.GPU_REQUIREMENT_PACKAGES)}"
# all four sources in the order of kind, path and position, folded by the replacement rule
query("q_union_sources", f"""
WITH rl AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS body, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM v_requirement_files),
req AS (SELECT repo_id, 0 AS rank, path, pos, {_spec_cols}, 'requirements.txt:L' || CAST(pos + 1 AS VARCHAR) AS source FROM rl WHERE body <> '' AND NOT starts_with(body, '#')),
sl AS (SELECT repo_id, path, regexp_extract_all(regexp_extract(content, 'install_requires=\\[([^\\]]*)\\]', 1), '"([^"]+)"', 1) AS l FROM v_setup_files),
setup AS (SELECT repo_id, 1 AS rank, path, pos, {_spec_cols}, 'setup.py' AS source FROM (SELECT repo_id, path, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS pos FROM sl)),
pl AS (SELECT repo_id, path, regexp_extract_all(regexp_extract(content, 'dependencies = \\[([^\\]]*)\\]', 1), '"([^"]+)"', 1) AS l,
  string_split(split_part(split_part(content, '[tool.poetry.dependencies]', 2), chr(10) || '[', 1), chr(10)) AS t FROM v_pyproject_files),
proj AS (SELECT repo_id, 2 AS rank, path, pos, {_spec_cols}, 'pyproject.toml' AS source FROM (SELECT repo_id, path, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS pos FROM pl)
 UNION ALL SELECT repo_id, 2, path, pos, regexp_extract(line, '^([A-Za-z0-9_.-]+) =', 1),
  CASE WHEN contains(line, 'version') THEN regexp_extract(line, 'version = "([^"]*)"', 1) ELSE regexp_extract(line, '= "([^"]*)"', 1) END, NULL, 'pyproject.toml'
 FROM (SELECT repo_id, path, unnest(t) AS line, len(l) + generate_subscripts(t, 1) - 1 AS pos FROM pl) WHERE regexp_matches(line, '^[A-Za-z0-9_.-]+ =') AND NOT starts_with(line, 'python ')),
i AS ({_imports_sql.strip()}),
imp AS (SELECT repo_id, 3 AS rank, substr(source, 9) AS path, row_number() OVER (PARTITION BY repo_id, source ORDER BY name) - 1 AS pos, name, NULL AS version, NULL AS op, source, gpu_required FROM i),
a AS (SELECT *, {_gpu} AS gpu_required FROM req UNION ALL SELECT *, {_gpu} FROM setup UNION ALL SELECT *, {_gpu} FROM proj UNION ALL SELECT * FROM imp),
f AS (SELECT repo_id, min({{'rank': rank, 'path': path, 'pos': pos}}) AS s, list_reduce(list({{'name': name, 'version': version, 'op': op, 'source': source, 'g': gpu_required, 'path': path}} ORDER BY rank, path, pos),
  lambda acc, x: CASE WHEN (x.version IS NOT NULL AND acc.version IS NULL) OR (x.g AND NOT acc.g) THEN x ELSE acc END) AS r FROM a GROUP BY repo_id, lower(name))
SELECT repo_id, r.name AS name, r.version AS version, r.op AS op, r.source AS source, r.g AS gpu_required, r.path AS path, s.rank || ':' || s.path || ':' || s.pos AS first_seen FROM f""")(_all_sources)

_m = lambda p, g=0: f"regexp_extract_all(lower(content), '{p}', {g})"
_pyv = ("coalesce(" + ", ".join(
    f"nullif(regexp_extract(lower(content), '{p}', {g}), '')" for p, g in R.README_PYTHON_PATTERNS) + ")")
query("q_readme", f"""
SELECT repo_id, {_pyv} AS python_version, {contains_any('lower(content)', R.README_CUDA_WORDS)} AS cuda_mentioned,
       ({' OR '.join(f"regexp_matches(lower(content), '{p}')" for p in R.README_GPU_PATTERNS)}) AS gpu_required,
       array_to_string({' || '.join(_m(p) for p in R.README_INSTALL_PATTERNS)}, '|') AS installation_commands,
       array_to_string({' || '.join(_m(p, 1) for p in R.README_REQUIREMENT_PATTERNS)}, '|') AS system_requirements FROM v_readmes""")(
    lambda c: RP.scan_readme(c.v_readmes).select("repo_id", "python_version", "cuda_mentioned", "gpu_required",
                                                 JOIN("installation_commands"), JOIN("system_requirements")))
query("q_dockerfiles", r"""
SELECT repo_id, path = 'Dockerfile' AS has_dockerfile, path <> 'Dockerfile' AS has_compose,
       CASE WHEN path = 'Dockerfile' THEN array_to_string(regexp_extract_all(content, '(?im)^FROM\s+([^\s]+)', 1), '|') ELSE '' END AS base_images
FROM v_dockerfiles""")(
    lambda c: RP.scan_dockerfiles(c.v_dockerfiles).select("repo_id", "has_dockerfile", "has_compose", JOIN("base_images")))
_cmds = " || ".join(f"regexp_extract_all(content, '{p}', 1)" for p in R.CI_TEST_PATTERNS)
query("q_ci", rf"""
SELECT repo_id, starts_with(path, '.github') AS has_github_actions, path = '.travis.yml' AS has_travis, path = '.circleci/config.yml' AS has_circleci,
       array_to_string(CASE WHEN starts_with(path, '.github') THEN list_sort(list_distinct(list_transform(string_split(regexp_extract(content, 'python-version:\s*\[([^\]]+)\]', 1), ','), lambda x: trim(trim(x), '"'''))))
            WHEN path = '.travis.yml' THEN list_sort(list_distinct(list_transform(regexp_extract_all(split_part(content, chr(10) || 'python:', 2), '-\s*([^\n]+)', 1), lambda x: trim(trim(x), '"''')))) ELSE [] END, '|') AS python_versions,
       CASE WHEN starts_with(path, '.github') THEN array_to_string(list_sort(list_distinct({_cmds})), '|') ELSE '' END AS test_commands
FROM v_ci_files""")(
    lambda c: RP.scan_ci(c.v_ci_files).select("repo_id", "has_github_actions", "has_travis", "has_circleci",
                                              JOIN("python_versions"), JOIN("test_commands")))
query("q_pick_files", """
WITH f AS (SELECT repo_id, path, content FROM v_readmes UNION ALL SELECT repo_id, path, content FROM v_ci_files UNION ALL SELECT repo_id, path, content FROM v_setup_files),
k AS (SELECT f.*, CASE path WHEN 'setup.py' THEN 1 WHEN '.travis.yml' THEN 2 WHEN 'README.md' THEN 3 END AS rank FROM f)
SELECT repo_id, arg_min(path, rank) AS path, min(rank)::BIGINT AS rank, length(arg_min(content, rank)) AS chars FROM k WHERE rank IS NOT NULL GROUP BY 1""")(
    lambda c: RP.pick_files(c.v_readmes.unionByName(c.v_ci_files).unionByName(c.v_setup_files),
                            ["setup.py", ".travis.yml", "README.md"])
    .select("repo_id", "path", F.col("rank").cast("bigint").alias("rank"), F.length("content").cast("bigint").alias("chars")))
query("q_pick_sources", """
SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rank FROM (
  SELECT doc_id % 50 AS repo_id, 'm' || CAST(doc_id AS VARCHAR) || '.py' AS path FROM documents WHERE n_chars < 50000)
QUALIFY rank <= 10""")(
    lambda c: RP.pick_source_files(c.table("documents").select(
        (F.col("doc_id") % 50).alias("repo_id"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("n_chars").alias("size")), limit=R.SOURCE_FILE_LIMIT, max_bytes=R.SOURCE_FILE_MAX_BYTES).select("repo_id", "path", F.col("rank").cast("bigint").alias("rank")))
query("q_urls", "SELECT repo_id, url, owner, name, owner || '/' || name AS repo_key FROM v_repos")(
    lambda c: RP.parse_repo_url(c.v_repos.select("repo_id", "url")).select("repo_id", "url", "owner", "name", "repo_key"))
query("q_page_urls", r"""
SELECT page_id, nullif(regexp_extract(url, '[/.]example\.[a-z]+[/:]([^/]+)/([^/\s]+?)(?:\.git)?(?:/.*)?$', 1), '') AS owner FROM pages""")(
    lambda c: c.table("pages").select("page_id", F.nullif(F.regexp_extract(
        "url", r"[/.]example\.[a-z]+[/:]([^/]+)/([^/\s]+?)(?:\.git)?(?:/.*)?$", 1), F.lit("")).alias("owner")))


def _merged(c):
    answers = L.response_answers(c.v_responses.where("role = 'assistant'").withColumnRenamed("conv_id", "repo_id"))
    return RP.merge_response_findings(RP.scan_readme(c.v_readmes), answers).select(
        "repo_id", "python_version", "cuda_mentioned", "gpu_required", JOIN("system_requirements"))


query("q_merge_findings", f"""
WITH j AS (SELECT conv_id AS repo_id, CASE WHEN bool_or((conv_id + turn) % 4 = 0) THEN 0 END AS kind FROM v_responses WHERE role = 'assistant' GROUP BY 1)
SELECT v_readmes.repo_id, coalesce({_pyv}, CASE WHEN j.kind = 0 THEN '3.9' END) AS python_version, {contains_any('lower(content)', R.README_CUDA_WORDS)} AS cuda_mentioned,
       ({' OR '.join(f"regexp_matches(lower(content), '{p}')" for p in R.README_GPU_PATTERNS)}) OR coalesce(j.kind = 0, false) AS gpu_required,
       array_to_string({' || '.join(_m(p, 1) for p in R.README_REQUIREMENT_PATTERNS)}, '|') AS system_requirements
FROM v_readmes LEFT JOIN j ON v_readmes.repo_id = j.repo_id""")(_merged)
query("q_needs_analysis", """
SELECT r.repo_id FROM v_repos r WHERE r.repo_id NOT IN (SELECT repo_id FROM v_outcomes WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)""")(
    lambda c: RP.needs_analysis(c.v_repos.select("repo_id"), c.v_outcomes, F.expr("timestamp_ntz'2024-01-31 00:00:00'")))

# -- logs and responses ------------------------------------------------------------------------------------------
_P = dict(R.PIP_PATTERNS)
_hit = lambda k: f"regexp_matches(line, {q(_P[k])})"
_g = lambda k, g: f"regexp_extract(line, {q(_P[k])}, {g})"
_by = lambda pkg: (rf"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)' || regexp_escape({pkg}) || '.*required by ([a-zA-Z0-9\-_]+)', 1) || "
                   rf"regexp_extract_all(text, '(?i)([a-zA-Z0-9\-_]+) requires ' || regexp_escape({pkg}), 1))), '|')")
_PIP_CTES = rf"""
ln AS (SELECT log_id, text, unnest(string_split(text, chr(10))) AS line FROM v_logs),
blk AS (SELECT log_id, list_filter(string_split(split_part(split_part(text, 'The conflict is caused by:', 2), chr(10) || chr(10), 1), chr(10)), lambda l: contains(l, ' depends on '))[1] AS dl FROM v_logs WHERE contains(text, 'The conflict is caused by:')),
det AS (SELECT log_id, regexp_extract(dl, '([a-zA-Z0-9\-_]+) ([0-9.]+) (?:depends on|requires) ([a-zA-Z0-9\-_]+)([><=!]+[0-9.]+)?', 3) AS package,
   regexp_extract(dl, '([a-zA-Z0-9\-_]+) ([0-9.]+) (?:depends on|requires) ([a-zA-Z0-9\-_]+)([><=!]+[0-9.]+)?', 1) AS who,
   nullif(regexp_extract(dl, '([a-zA-Z0-9\-_]+) ([0-9.]+) (?:depends on|requires) ([a-zA-Z0-9\-_]+)([><=!]+[0-9.]+)?', 4), '') AS required FROM blk),
typed AS (
 SELECT log_id, 'version_conflict' AS error_type, {_g('has_requirement', 1)} AS package, {_by(_g('has_requirement', 1))} AS required_by, {_g('has_requirement', 4)} AS current_version, {_g('has_requirement', 2)} AS required_version, {_g('has_requirement', 0)} AS error_message, 'Downgrade ' || {_g('has_requirement', 3)} || ' to ' || {_g('has_requirement', 2)} || ' or find compatible versions' AS suggested_resolution FROM ln WHERE {_hit('has_requirement')}
 UNION ALL SELECT ln.log_id, 'version_conflict', det.package, det.who, NULL, det.required, {_g('cannot_install', 0)}, 'Resolve version conflicts by finding mutually compatible versions' FROM ln JOIN det ON ln.log_id = det.log_id WHERE {_hit('cannot_install')}
 UNION ALL SELECT log_id, 'version_conflict', 'multiple', '', NULL, NULL, {_g('resolver_notice', 0)}, 'Use pip install --use-deprecated=legacy-resolver or resolve conflicts manually' FROM ln WHERE {_hit('resolver_notice')}
 UNION ALL SELECT log_id, 'missing_dependency', {_g('no_distribution', 1)}, {_by(_g('no_distribution', 1))}, NULL, NULL, {_g('no_distribution', 0)}, 'Check if ' || {_g('no_distribution', 1)} || ' exists on PyPI or use correct package name' FROM ln WHERE {_hit('no_distribution')}
 UNION ALL SELECT log_id, 'incompatible_version', trim(split_part({_g('unsatisfied', 1)}, '>=', 1)), '', NULL, {_g('unsatisfied', 1)}, {_g('unsatisfied', 0)}, 'No compatible version of ' || trim(split_part({_g('unsatisfied', 1)}, '>=', 1)) || ' found for requirement ' || {_g('unsatisfied', 1)} FROM ln WHERE {_hit('unsatisfied')}
 UNION ALL SELECT log_id, 'build_error', {_g('wheel_build', 1)}, '', NULL, NULL, {_g('wheel_build', 0)}, CASE WHEN contains(text, 'Microsoft Visual C++') THEN 'Install Microsoft Visual C++ Build Tools' WHEN contains(text, 'gcc') OR contains(text, 'g++') THEN 'Install gcc/g++ compiler' WHEN contains(text, 'Rust') THEN 'Install Rust compiler' ELSE 'Install build dependencies' END FROM ln WHERE {_hit('wheel_build')}
 UNION ALL SELECT log_id, 'build_error', 'unknown', '', NULL, NULL, {_g('compiler', 0)}, 'Install Microsoft Visual C++ Build Tools from https://visualstudio.microsoft.com/downloads/' FROM ln WHERE {_hit('compiler')}
 UNION ALL SELECT log_id, 'platform_mismatch', coalesce(nullif(regexp_extract(text, '([a-zA-Z0-9\-_]+)-[0-9.]+-.*\.whl', 1), ''), 'unknown'), '', NULL, NULL, {_g('platform', 0)}, 'Download correct wheel for your platform or build from source' FROM ln WHERE {_hit('platform')}),
found AS (SELECT * FROM typed
 UNION ALL SELECT log_id, 'version_conflict', 'multiple', '', NULL, NULL, 'Resolution impossible due to conflicting dependencies', 'Review all package versions and find compatible combinations' FROM v_logs WHERE contains(text, 'ResolutionImpossible') AND log_id NOT IN (SELECT log_id FROM typed)
 UNION ALL SELECT log_id, 'network_error', 'unknown', '', NULL, NULL, 'Network connectivity issue', 'Check internet connection and proxy settings' FROM v_logs WHERE (contains(text, 'Network') OR contains(text, 'Connection')) AND log_id NOT IN (SELECT log_id FROM typed))"""
query("q_pip_logs", f"WITH {_PIP_CTES} SELECT * FROM found")(
    lambda c: L.parse_pip_logs(c.v_logs).select("log_id", "error_type", "package", JOIN("required_by"), "current_version",
                                                "required_version", "error_message", "suggested_resolution"))
_tips = ", ".join(f"({q(k)}, {q(t)})" for k, v in R.PIP_RESOLUTION_TIPS.items() for t in v)
query("q_pip_suggestions", f"""WITH {_PIP_CTES}
SELECT DISTINCT log_id, suggestion FROM (
 SELECT log_id, t.tip AS suggestion FROM found JOIN (VALUES {_tips}) t(kind, tip) ON found.error_type = t.kind
 UNION ALL SELECT log_id, {q(R.PIP_ML_TIP)} FROM found WHERE package IN ('torch', 'tensorflow')
 UNION ALL SELECT log_id, {q(R.PIP_PIN_TIP)} FROM found WHERE error_type = 'version_conflict')""")(
    lambda c: L.suggest_resolutions(L.parse_pip_logs(c.v_logs)))
query("q_pip_details", f"WITH {_PIP_CTES} SELECT log_id, package, who AS required_by, required FROM det")(
    lambda c: c.v_logs.select("log_id", L.conflict_details(F.col("text")).alias("d")).where("d IS NOT NULL")
    .select("log_id", "d.package", F.array_join("d.required_by", "|").alias("required_by"), "d.required"))
query("q_pip_wheels", r"SELECT log_id, nullif(regexp_extract(text, '([a-zA-Z0-9\-_]+)-[0-9.]+-.*\.whl', 1), '') AS package FROM v_logs")(
    lambda c: c.v_logs.select("log_id", L.wheel_package(F.col("text")).alias("package")))
query("q_build_hints", """SELECT log_id, CASE WHEN contains(text, 'Microsoft Visual C++') THEN 'Install Microsoft Visual C++ Build Tools' WHEN contains(text, 'gcc') OR contains(text, 'g++') THEN 'Install gcc/g++ compiler' WHEN contains(text, 'Rust') THEN 'Install Rust compiler' ELSE 'Install build dependencies' END AS hint FROM v_logs""")(
    lambda c: c.v_logs.select("log_id", L.build_hint(F.col("text")).alias("hint")))
query("q_response_json", """
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '{"valid": true, "python_versions": ["3.9"], "gpu_requirements": "CUDA needed"}'
   WHEN 2 THEN '{"strategy": "docker", "options": {"gpu": true}}' END AS json_answer FROM v_responses""")(
    lambda c: L.response_answers(c.v_responses).select("conv_id", "turn", "json_answer"))
query("q_response_text", r"""
SELECT conv_id, turn, regexp_replace(CASE (conv_id + turn) % 4 WHEN 0 THEN '{"valid": true, "python_versions": ["3.9"], "gpu_requirements": "CUDA needed"}'
   WHEN 2 THEN '{"strategy": "docker", "options": {"gpu": true}}'
   WHEN 1 THEN split_part(content, '</think>', 2) ELSE split_part(content, '<thinking>', 1) END, '^\s+|\s+$', '', 'g') AS answer FROM v_responses""")(
    lambda c: L.response_answers(c.v_responses).select("conv_id", "turn", "answer"))

_VLOG = """SELECT event_id AS log_id, 'python_version: PASSED' || chr(10) || CASE WHEN event_type = 'error' THEN 'import_torch: FAILED (exit code ' || CAST(1 + event_id % 5 AS VARCHAR(10)) || ')' || chr(10) || 'Container logs: ' || props ELSE 'import_torch: PASSED' || chr(10) || 'gpu_nvidia_smi: PASSED' END || chr(10) AS text FROM events"""
query("q_validation_logs", f"""
WITH t AS ({_VLOG})
SELECT log_id, CAST(length(text) - length(replace(text, 'PASSED', 'PASSE')) AS BIGINT) AS passed, CAST(CASE WHEN contains(text, 'FAILED') THEN 1 ELSE 0 END AS BIGINT) AS failed,
       CASE WHEN contains(text, 'FAILED') THEN 'import_torch' END AS failing_test, rtrim(text, chr(10)) AS last_lines FROM t""")(
    lambda c: L.summarize_validation_logs(c.sql(_VLOG)))
query("q_validation_results", f"""
WITH t AS ({_VLOG}), l AS (SELECT log_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+): (?:PASSED|FAILED \\(exit code \\d+\\))', 0)) AS line FROM t)
SELECT log_id, split_part(line, ':', 1) AS test, CASE WHEN contains(line, 'PASSED') THEN 'PASSED' ELSE 'FAILED' END AS status,
       coalesce(TRY_CAST(regexp_extract(line, 'exit code (\\d+)', 1) AS BIGINT), 0) AS exit_code FROM l""")(
    lambda c: L.validation_results(c.sql(_VLOG)).select("log_id", "test", "status", "exit_code"))

# -- strategies and environments ---------------------------------------------------------------------------------
_FACTS = f"""f AS (SELECT repo_id, bool_or({contains_any('lower(name)', R.CONDA_CAPABLE_WORDS)}) AS ml, bool_or(gpu_required) AS gpu FROM v_dedup GROUP BY 1),
cap AS (SELECT f.repo_id, s.* FROM f JOIN v_strategies s ON s.strategy = 'docker' OR (s.strategy IN ('conda', 'micromamba') AND ml) OR (s.strategy = 'venv' AND NOT gpu))"""
query("q_capable", f"WITH {_FACTS} SELECT repo_id, strategy, priority, setup_seconds, size_mb FROM cap")(
    lambda c: ST.capable_strategies(c.facts))
query("q_select", f"""WITH {_FACTS} SELECT cap.repo_id, arg_max(strategy, CASE WHEN strategy = CASE cap.repo_id % 3 WHEN 0 THEN 'venv' WHEN 1 THEN 'conda' END THEN 100 ELSE priority END) AS strategy FROM cap GROUP BY 1""")(
    lambda c: ST.select_strategy(c.facts, F.when(F.col("repo_id") % 3 == 0, "venv").when(F.col("repo_id") % 3 == 1, "conda"))
    .select("repo_id", "strategy"))


def _advice(c):
    s = F.when(F.col("repo_id") % 2 == 0, "venv").otherwise("conda")
    a = c.v_repos.select("repo_id", s.alias("strategy"), F.lit(1).alias("rank"), F.lit(0.9).alias("success_probability"))
    b = c.v_repos.select("repo_id", F.lit("micromamba").alias("strategy"), F.lit(2).alias("rank"), F.lit(0.6).alias("success_probability"))
    return ST.select_strategy_by_advice(c.facts, a.unionByName(b))


query("q_select_advised", f"""WITH {_FACTS},
adv AS (SELECT repo_id, CASE WHEN repo_id % 2 = 0 THEN 'venv' ELSE 'conda' END AS strategy, 1 AS rank, 0.9 AS p FROM v_repos UNION ALL SELECT repo_id, 'micromamba', 2, 0.6 FROM v_repos),
hit AS (SELECT cap.repo_id, arg_min({{'s': cap.strategy, 'p': adv.p}}, adv.rank) AS h FROM cap JOIN adv ON cap.repo_id = adv.repo_id AND cap.strategy = adv.strategy GROUP BY 1),
best AS (SELECT repo_id, arg_max(strategy, priority) AS strategy FROM cap GROUP BY 1)
SELECT best.repo_id, coalesce(hit.h.s, best.strategy) AS strategy, CAST(hit.h.p AS DOUBLE) AS learning_confidence FROM best LEFT JOIN hit ON best.repo_id = hit.repo_id""")(_advice)
query("q_presets", "SELECT event_id, preset, " + ", ".join(
    "CASE preset " + " ".join(f"WHEN {q(p[0])} THEN {q(p[i]) if isinstance(p[i], str) else ('NULL' if p[i] is None else q(str(p[i]).lower()))}" for p in R.PRESETS) + f" END AS {n}"
    for i, n in enumerate(["strategy", "gpu_mode", "validation", "cache_enabled", "response_analysis", "learning_enabled"], 1))
    + ", CASE WHEN preset = 'other' THEN 'Preset ''other'' not found. Available presets: " + ", ".join(p[0] for p in R.PRESETS) + "' END AS error FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'production' WHEN 'view' THEN 'quick' WHEN 'signup' THEN 'ml-research' WHEN 'error' THEN 'other' ELSE 'ci-cd' END AS preset FROM events)")(
    lambda c: ST.apply_preset(c.sql("SELECT event_id, CASE event_type WHEN 'click' THEN 'production' WHEN 'view' THEN 'quick' WHEN 'signup' THEN 'ml-research' WHEN 'error' THEN 'other' ELSE 'ci-cd' END AS preset FROM events")).select(
        "event_id", "preset", "strategy", "gpu_mode", "error",
        *[F.col(n).cast("string").alias(n) for n in ("validation", "cache_enabled", "response_analysis", "learning_enabled")]))
_ROUTE = lambda cond: f"""SELECT repo_id, CASE WHEN {cond} THEN 'conda' ELSE 'pip' END AS channel, name,
   CASE WHEN version IS NULL THEN name WHEN {cond} THEN name || '=' || version ELSE name || '==' || version END AS spec FROM v_dedup"""
_EXTRA = f"""UNION ALL SELECT g.repo_id, 'conda', 'python', 'python=' || coalesce(r.python_version_required, '3.10') FROM (SELECT DISTINCT repo_id FROM v_dedup) g LEFT JOIN v_repos r ON g.repo_id = r.repo_id
UNION ALL SELECT repo_id, 'conda', p, p FROM (SELECT repo_id, unnest(['cudatoolkit', 'cudnn']) AS p FROM v_dedup GROUP BY repo_id HAVING bool_or(gpu_required))"""
_conda = f"lower(name) IN {inlist(R.CONDA_EXACT_PACKAGES)}"
_mamba = contains_any("lower(name)", R.MICROMAMBA_PACKAGE_WORDS)
query("q_route_conda", f"{_ROUTE(_conda)} {_EXTRA}")(lambda c: ST.route_packages(c.deps, "conda", c.v_repos))
query("q_route_micromamba", f"{_ROUTE(_mamba)} {_EXTRA}")(lambda c: ST.route_packages(c.deps, "micromamba", c.v_repos))
query("q_render", f"""SELECT repo_id, channel, array_to_string(list(spec ORDER BY spec), chr(10)) AS text, count(*) AS lines FROM ({_ROUTE('false')}) GROUP BY 1, 2""")(
    lambda c: ST.render_requirements(ST.route_packages(c.deps, "venv")))
query("q_base_image", f"""WITH {_FACTS} SELECT f.repo_id, f.gpu, CASE WHEN f.gpu THEN 'nvidia/cuda:' || coalesce(k.cuda_version_required, '11.8') || '-devel-ubuntu20.04' ELSE 'python:3.10-slim' END AS base_image
FROM f LEFT JOIN v_recommended k ON f.repo_id = k.repo_id""")(
    lambda c: ST.base_images(c.facts, C.recommended_cuda(c.deps)))
query("q_resources", f"""WITH {_FACTS}, best AS (SELECT repo_id, arg_max({{'s': strategy, 't': setup_seconds, 'm': size_mb}}, priority) AS b FROM cap GROUP BY 1)
SELECT b.s AS strategy, count(*) AS repos, CAST(sum(b.t) AS BIGINT) AS setup_seconds, CAST(sum(b.m) AS BIGINT) AS size_mb FROM best GROUP BY 1""")(
    lambda c: ST.resource_estimates(ST.select_strategy(c.facts)))
_vt = lambda t: f"{q(t[0])} AS test, {q(t[1])} AS command"
_FG = "(SELECT repo_id, bool_or(gpu_required) AS gpu, bool_or(name = 'torch') AS torch, bool_or(name IN ('tensorflow', 'tensorflow-gpu')) AS tf FROM v_dedup GROUP BY 1)"
query("q_validation_plan", " UNION ALL ".join(
    [f"SELECT DISTINCT repo_id, {_vt(t)} FROM v_dedup" for t in ST.VALIDATION_BASE]
    + [f"SELECT repo_id, {_vt(ST.VALIDATION_GPU)} FROM {_FG} WHERE gpu",
       f"SELECT repo_id, {_vt(ST.VALIDATION_TORCH_GPU)} FROM {_FG} WHERE gpu AND torch",
       f"SELECT repo_id, {_vt(ST.VALIDATION_TENSORFLOW_GPU)} FROM {_FG} WHERE gpu AND tf",
       """SELECT repo_id, 'import_' || name, 'python -c ''import ' || name || '; print(f"' || name || ' imported successfully")''' FROM (
          SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY first_ord) AS rn FROM v_dedup) WHERE rn <= 5 AND name IN ('torch', 'tensorflow', 'jax')"""]))(
    lambda c: ST.validation_plan(c.stored_deps, first=5))

# -- systems ------------------------------------------------------------------------------------------------------
_SCORE = "CAST(floor(least(least(cpu_cores * 2.0, 30) + least(memory_gb, 20) + gpu_count * least(gpu_memory * 2, 25), 100)) AS BIGINT)"
query("q_system_features", f"""
SELECT system_id, cpu_cores, memory_gb, gpu_count, gpu_count * gpu_memory AS gpu_memory_total, CASE WHEN gpu_count > 0 THEN gpu_memory ELSE 0 END AS gpu_memory_max,
       {NUM.format(v='cuda_version')} AS cuda_version, {NUM.format(v='python_version')} AS python_version, container_runtime, {_SCORE} AS compute_score,
       gpu_count > 0 AND contains(lower(gpu_name), 'nvidia') AS has_nvidia_gpu,
       gpu_count > 0 AND {contains_any('lower(gpu_name)', ['amd', 'radeon', 'rx', 'vega'])} AS has_amd_gpu FROM v_systems""")(
    lambda c: FE.system_features(c.systems))
query("q_system_capabilities", """
SELECT system_id, gpu_count > 0 AS has_gpu, cuda_version IS NOT NULL AS has_cuda, container_runtime IS NOT NULL AS can_run_containers, gpu_count * gpu_memory AS gpu_memory_gb, cpu_cores, python_version FROM v_systems""")(
    lambda c: FE.analysis_context(c.systems).select("system_id", "system_capabilities.*", "hardware.cpu_cores", "software.python_version"))
query("q_gpu_inventory", """
SELECT system_id, gpu_name AS name, gpu_memory AS memory_gb, '535.' || CAST(system_id % 9 AS VARCHAR) AS driver_version, CASE WHEN system_id % 2 = 0 THEN '8.6' END AS compute_capability FROM v_systems""")(
    lambda c: TB.parse_gpu_inventory(c.sql("""SELECT system_id, gpu_name || ', ' || CAST(CAST(gpu_memory * 1024 AS BIGINT) AS VARCHAR(10)) ||
        CASE system_id % 3 WHEN 0 THEN ' MiB' WHEN 1 THEN ' MB' ELSE '' END || ', 535.' || CAST(system_id % 9 AS VARCHAR(10)) || CASE WHEN system_id % 2 = 0 THEN ', 8.6' ELSE '' END AS line FROM v_systems""")))
query("q_tool_versions", r"""
SELECT system_id, CASE WHEN system_id % 2 = 0 THEN '4.' || CAST(system_id % 9 AS VARCHAR) || '.1' ELSE 'tool devel' END AS version,
       CASE WHEN cuda_version IS NOT NULL THEN cuda_version END AS toolkit FROM v_systems""")(
    lambda c: c.sql("""SELECT system_id, CASE WHEN system_id % 2 = 0 THEN 'tool 4.' || CAST(system_id % 9 AS VARCHAR(10)) || '.1 (x86)' ELSE 'tool devel' || chr(10) || 'built today' END AS out,
        'Compiler tools' || chr(10) || CASE WHEN cuda_version IS NULL THEN 'none' ELSE 'tools, release ' || cuda_version || ', V1' END AS banner FROM v_systems""")
    .select("system_id", S.tool_version(F.col("out")).alias("version"), S.toolkit_release(F.col("banner")).alias("toolkit")))
