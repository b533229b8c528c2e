"""Domain tables derived from the given test tables.

Each view is SQL text that means the same on Spark and on the checking engine, so that both sides
start from equal rows. Operators take DataFrames and know nothing of these bindings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stacklens.session import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Package vocabulary (fixed values): (index, name, version 0, version 1, version 2)
VOCAB = [
    (0, "torch", "2.0.0", "1.8.0", "2.4.1"), (1, "torchvision", "0.14.0", "0.15.0", "0.16.0"),
    (2, "transformers", "4.25.0", "4.30.0", "4.40.1"), (3, "tensorflow", "2.13.0", "2.17.0", "2.15.0"),
    (4, "numpy", "1.24.0", "1.20.0", "1.26.0"), (5, "scipy", "1.11.0", "1.10.0", "1.13.0"),
    (6, "torchaudio", "0.13.0", "2.0.0", "2.1.0"), (7, "xformers", "0.0.22", "0.0.20", "0.0.19"),
    (8, "accelerate", "0.21.0", "0.20.0", "0.30.0"), (9, "diffusers", "0.21.0", "0.20.1", "0.30.0"),
    (10, "datasets", "2.14.0", "2.19.0", "2.1.0"), (11, "pandas", "2.0.0", "2.1.0", "1.5.3"),
    (12, "ultralytics", "8.3.40", "8.3.41", "8.3.0"), (13, "jax", "0.4.20", "0.4.23", "0.4.25"),
    (14, "cupy", "13.0.0", "12.3.0", "11.6.0"), (15, "mxnet", "1.9.1", "1.9.0", "1.8.0"),
    (16, "scikit-learn", "1.3.0", "1.2.0", "1.4.0"), (17, "requests", "2.31.0", "2.30.0", "2.29.0"),
    (18, "pyyaml", "6.0.0", "6.0.1", "5.4.1"), (19, "pytest", "7.4.0", "7.3.0", "8.0.0"),
    (20, "tqdm", "4.66.0", "4.65.0", "4.64.0"), (21, "numba", "0.58.0", "0.57.0", "0.59.0"),
    (22, "keras", "2.13.0", "2.15.0", "3.0.0"), (23, "pillow", "9.0.0", "10.0.0", "9.5.0"),
]
_values = ", ".join(f"({i}, '{n}', '{a}', '{b}', '{c}')" for i, n, a, b, c in VOCAB)

# Error texts an outcome can carry (fixed values)
MESSAGES = ["CUDA out of range on device 0", "Permission denied: /usr/lib", "Network unreachable",
            "Killed: out of memory", "ImportError: dependency missing", "Build of wheel stopped",
            "exit status 1", ""]
_messages = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))

VIEWS: dict[str, str] = {}

VIEWS["vocab"] = f"SELECT * FROM (VALUES {_values}) AS t(idx, name, v0, v1, v2)"

VIEWS["v_deps"] = """
SELECT l.l_orderkey AS repo_id,
       CAST(l.l_linenumber AS BIGINT) * 10000000000000000 + l.l_partkey * 10000000 + l.l_suppkey AS ord,
       v.name AS name,
       CASE WHEN q % 7 = 0 THEN NULL WHEN q % 3 = 0 THEN v.v0 WHEN q % 3 = 1 THEN v.v1 ELSE v.v2 END AS version,
       CASE WHEN q % 7 = 0 THEN NULL WHEN l.l_returnflag = 'A' THEN '==' WHEN l.l_returnflag = 'N' THEN '>=' ELSE '~=' END AS op,
       'python' AS dep_type,
       CASE WHEN l.l_linestatus = 'O' THEN 'requirements.txt:L' || CAST(l.l_linenumber AS VARCHAR(10))
            WHEN l.l_suppkey % 3 = 0 THEN 'pyproject.toml' ELSE 'setup.py' END AS source,
       (v.name IN ('torch', 'tensorflow', 'cupy', 'numba', 'jax', 'mxnet') AND l.l_suppkey % 5 <> 0) AS gpu_required
FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem) l
JOIN vocab v ON l.l_partkey % 24 = v.idx
"""

VIEWS["v_systems"] = """
SELECT c_custkey AS system_id, 1 + c_custkey % 32 AS cpu_cores,
       CAST(2 + (c_custkey * 7) % 62 AS DOUBLE) AS memory_gb,
       CASE c_custkey % 6 WHEN 0 THEN 'arm64' WHEN 1 THEN 'sparc' ELSE 'x86_64' END AS architecture,
       c_custkey % 4 AS gpu_count, CAST(8 * (1 + c_custkey % 3) AS DOUBLE) AS gpu_memory,
       CASE c_custkey % 3 WHEN 0 THEN 'NVIDIA A100' WHEN 1 THEN 'AMD Radeon RX 6800' ELSE 'Arc A770' END AS gpu_name,
       CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '11.8' WHEN 2 THEN '12.1.105' WHEN 3 THEN '10.2' ELSE '12.4' END AS cuda_version,
       CASE c_custkey % 4 WHEN 0 THEN '3.8.10' WHEN 1 THEN '3.10.12' WHEN 2 THEN 'unknown' ELSE '3.11.4' END AS python_version,
       CASE c_custkey % 3 WHEN 0 THEN 'docker' WHEN 1 THEN 'podman' ELSE NULL END AS container_runtime
FROM customer
"""

VIEWS["v_repos"] = """
SELECT o.o_orderkey AS repo_id,
       'org' || CAST(o.o_custkey AS VARCHAR(20)) AS owner,
       'repo-' || CAST(o.o_orderkey AS VARCHAR(20)) AS name,
       CASE o.o_orderkey % 4
            WHEN 0 THEN 'https://github.com/org' || CAST(o.o_custkey AS VARCHAR(20)) || '/repo-' || CAST(o.o_orderkey AS VARCHAR(20))
            WHEN 1 THEN 'https://github.com/org' || CAST(o.o_custkey AS VARCHAR(20)) || '/repo-' || CAST(o.o_orderkey AS VARCHAR(20)) || '.git'
            WHEN 2 THEN 'git@github.com:org' || CAST(o.o_custkey AS VARCHAR(20)) || '/repo-' || CAST(o.o_orderkey AS VARCHAR(20)) || '.git'
            ELSE 'org' || CAST(o.o_custkey AS VARCHAR(20)) || '/repo-' || CAST(o.o_orderkey AS VARCHAR(20)) END AS url,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 'Code for a research paper' WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 'A toolkit' END AS description,
       CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS stars, o.o_orderpriority AS language,
       a.name AS topic1, b.name AS topic2, o.o_custkey AS system_id,
       (o.o_orderkey % 4 = 1) AS has_dockerfile, (o.o_orderkey % 3 = 0) AS cuda_mentioned,
       CASE o.o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '3.8' WHEN 2 THEN '3.10' WHEN 3 THEN '3.9.1' ELSE '3.11' END AS python_version_required,
       CAST(o.o_orderdate AS DATE) AS created
FROM orders o JOIN vocab a ON o.o_custkey % 24 = a.idx JOIN vocab b ON (o.o_orderkey * 7) % 24 = b.idx
"""

VIEWS["v_repo_systems"] = """
SELECT r.repo_id, s.* FROM v_repos r JOIN v_systems s ON r.system_id = s.system_id
"""

VIEWS["v_outcomes"] = f"""
SELECT event_id AS outcome_id, event_id - event_id % 3 AS repo_id, ts,
       CASE event_id % 4 WHEN 0 THEN 'docker' WHEN 1 THEN 'conda' WHEN 2 THEN 'micromamba' ELSE 'venv' END AS strategy,
       (event_type <> 'error') AS success, CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failed' END AS status,
       value AS duration, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS setup_time,
       CASE WHEN event_type = 'error' THEN CASE event_id % 8 {_messages} END END AS error_message
FROM events
"""

VIEWS["v_runs"] = """
SELECT event_id AS run_id, ts, value AS duration,
       CASE event_id % 4 WHEN 0 THEN 'profile_agent' WHEN 1 THEN 'analysis_agent' WHEN 2 THEN 'resolution_agent' ELSE 'cleanup_agent' END AS agent,
       CASE WHEN event_type = 'error' THEN 'unhealthy' WHEN user_id % 7 = 0 THEN 'degraded' ELSE 'healthy' END AS status
FROM events
"""

# models stored over time, with the accuracy each had when it was saved
VIEWS["v_models"] = """
SELECT CASE WHEN d % 3 = 0 THEN 'strategy_predictor' ELSE 'dependency_predictor' END AS name, saved_at, accuracy, CAST(30 + d AS BIGINT) AS feature_count
FROM (SELECT day(ts) AS d, max(ts) AS saved_at, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(1.0 AS DOUBLE) END) AS accuracy
      FROM events GROUP BY month(ts), day(ts)) WHERE d % 3 <> 1
"""

VIEWS["v_requests"] = """
SELECT event_id AS request_id, event_type || '/' || CAST(user_id AS VARCHAR(20)) AS cache_key, ts FROM events
"""

VIEWS["v_manifests"] = """
SELECT repo_id, ord, 'requirements.txt' AS path,
       '# pinned set' || chr(10) || chr(10) || name ||
       CASE WHEN version IS NULL THEN '' ELSE op || version END ||
       CASE WHEN ord % 3 = 0 THEN '  # keep' WHEN ord % 3 = 1 AND version IS NOT NULL THEN ',<99' ELSE '' END || chr(10) ||
       '-r dev.txt' || chr(10) || upper(substr(name, 1, 1)) || substr(name, 2) || '[extra]>=1.0' || chr(10) ||
       '  Extra-' || CAST(ord % 50 AS VARCHAR(10)) || ' >= 0.' || CAST(ord % 9 AS VARCHAR(10)) || chr(10) || 'git+https://example.org/x.git' AS content
FROM v_deps
"""

VIEWS["v_readmes"] = """
SELECT doc_id AS repo_id, 'README.md' AS path,
       text || chr(10) ||
       CASE doc_id % 5 WHEN 0 THEN 'Python >= 3.' || CAST(7 + doc_id % 6 AS VARCHAR(10))
            WHEN 1 THEN 'Needs Python 3.' || CAST(8 + doc_id % 4 AS VARCHAR(10)) || ' or higher'
            WHEN 2 THEN 'Runs on python 3.9+' ELSE 'No version given' END || chr(10) ||
       'pip install pkg' || CAST(doc_id % 10 AS VARCHAR(10)) || chr(10) ||
       CASE doc_id % 4 WHEN 0 THEN 'An NVIDIA GPU helps' WHEN 1 THEN 'Requires GPU' ELSE 'Any machine' END || chr(10) ||
       'Requirements: git, make' || chr(10) || 'conda install tool' || CAST(doc_id % 3 AS VARCHAR(10)) AS content
FROM documents
"""

VIEWS["v_dockerfiles"] = """
SELECT doc_id AS repo_id, CASE doc_id % 3 WHEN 0 THEN 'docker-compose.yml' ELSE 'Dockerfile' END AS path,
       '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || 'FROM python:3.' || CAST(8 + doc_id % 5 AS VARCHAR(10)) || '-slim AS base' || chr(10) ||
       'RUN pip install x' || chr(10) || 'from ubuntu:2' || CAST(doc_id % 3 AS VARCHAR(10)) || '.04' || chr(10) AS content
FROM documents
"""

VIEWS["v_ci_files"] = """
SELECT doc_id AS repo_id,
       CASE doc_id % 4 WHEN 0 THEN '.github/workflows/ci.yml' WHEN 1 THEN '.github/workflows/main.yml' WHEN 2 THEN '.travis.yml' ELSE '.circleci/config.yml' END AS path,
       '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) ||
       CASE doc_id % 4 WHEN 2 THEN 'language: python' || chr(10) || 'python:' || chr(10) || '  - "3.' || CAST(7 + doc_id % 4 AS VARCHAR(10)) || '"' || chr(10) || '  - 3.12' || chr(10)
            ELSE 'python-version: [3.8, "3.' || CAST(9 + doc_id % 4 AS VARCHAR(10)) || '"]' || chr(10) || 'run: pytest -q' || chr(10) || 'run: make test' || CAST(doc_id % 3 AS VARCHAR(10)) || chr(10) END AS content
FROM documents
"""

VIEWS["v_setup_files"] = """
SELECT d.doc_id AS repo_id, 'setup.py' AS path,
       'from setuptools import setup' || chr(10) || '# ' || replace(replace(d.text, chr(13), ' '), chr(10), chr(10) || '# ') || chr(10) ||
       'setup(name="x", install_requires=["' || a.name || '>=' || a.v0 || '", "' || b.name || '"],' || chr(10) || '  zip_safe=False)' || chr(10) AS content
FROM documents d JOIN vocab a ON d.doc_id % 24 = a.idx JOIN vocab b ON (d.doc_id * 5 + 7) % 24 = b.idx
"""

VIEWS["v_pyproject_files"] = """
SELECT d.doc_id AS repo_id, 'pyproject.toml' AS path,
       '[project]' || chr(10) || 'name = "p"' || chr(10) || 'dependencies = ["' || a.name || '>=' || a.v1 || '", "' || b.name || '"]' || chr(10) ||
       '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.10"' || chr(10) || a.name || ' = "^' || a.v2 || '"' || chr(10) ||
       b.name || ' = {version = "' || b.v0 || '", optional = true}' || chr(10) || '[tool.black]' || chr(10) || 'line-length = 99' || chr(10) AS content
FROM documents d JOIN vocab a ON d.doc_id % 24 = a.idx JOIN vocab b ON (d.doc_id * 5 + 7) % 24 = b.idx
"""

VIEWS["v_source_files"] = """
SELECT d.doc_id AS repo_id, 'src/m' || CAST(d.doc_id AS VARCHAR(20)) || '.py' AS path,
       '# ' || replace(replace(d.text, chr(13), ' '), chr(10), chr(10) || '# ') || chr(10) ||
       'import os, sys' || chr(10) || 'import numpy as np' || chr(10) || 'from sklearn.svm import SVC' || chr(10) ||
       'import cv2' || chr(10) || CASE WHEN d.doc_id % 2 = 0 THEN 'import torch.nn as nn, json' ELSE 'from PIL import Image' END || chr(10) ||
       'def f():' || chr(10) || '    import pandas' || chr(10) AS content
FROM documents d
UNION ALL
SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'src/z.py' ELSE 'src/a.py' END, 'import numpy' || chr(10) || 'import jax, tqdm' || chr(10)
FROM documents d
"""

VIEWS["v_requirement_files"] = """
SELECT d.doc_id AS repo_id, p.path,
       CASE WHEN p.path = 'requirements-dev.txt' THEN 'pytest>=7.0' || chr(10) || a.name || chr(10) || 'numba' || chr(10)
            ELSE '# pinned' || chr(10) || a.name || '==' || a.v1 || chr(10) || b.name || chr(10) || 'torch' || chr(10) || 'numpy>=' || b.v2 || chr(10) END AS content
FROM documents d JOIN vocab a ON (d.doc_id * 3 + 1) % 24 = a.idx JOIN vocab b ON (d.doc_id * 7 + 2) % 24 = b.idx,
     (VALUES ('requirements.txt'), ('requirements-dev.txt')) AS p(path)
"""

VIEWS["v_logs"] = """
SELECT e.event_id AS log_id,
       'Collecting ' || a.name || chr(10) ||
       CASE e.event_id % 9
         WHEN 0 THEN 'ERROR: ' || b.name || ' 1.0 has requirement ' || a.name || '==' || a.v0 || ', but you''ll have ' || a.name || ' ' || a.v1 || ' which is incompatible.' || chr(10) || a.name || ' required by ' || b.name || chr(10) || 'other requires ' || a.name
         WHEN 1 THEN 'ERROR: No matching distribution found for ' || a.name || chr(10) || a.name || ' is required by tool-' || b.name
         WHEN 2 THEN 'ERROR: Could not find a version that satisfies the requirement ' || a.name || '>=' || a.v2 || chr(10) || 'ERROR: No matching distribution found for ' || a.name
         WHEN 3 THEN 'ERROR: Failed building wheel for ' || a.name || chr(10) || CASE WHEN e.user_id % 2 = 0 THEN 'error: Microsoft Visual C++ 14.0 is required' ELSE 'gcc failed' END
         WHEN 4 THEN 'ERROR: ' || a.name || '-' || a.v0 || '-cp39-win32.whl is not a supported wheel on this platform.'
         WHEN 5 THEN 'ERROR: Cannot install x because these package versions have conflicting dependencies.' || chr(10) || chr(10) || 'The conflict is caused by:' || chr(10) || '    ' || a.name || ' ' || a.v0 || ' depends on ' || b.name || '>=' || b.v1 || chr(10) || '    other 1.0 depends on ' || b.name || chr(10) || chr(10) || 'To fix this'
         WHEN 6 THEN 'ResolutionImpossible: for help visit the page' || chr(10) || 'Connection reset'
         WHEN 7 THEN 'WARNING: Network is slow'
         ELSE 'ERROR: pip''s dependency resolver does not currently take into account all the packages that are installed.' END AS text
FROM events e JOIN vocab a ON e.event_id % 24 = a.idx JOIN vocab b ON (e.user_id * 5 + 1) % 24 = b.idx
WHERE e.event_type = 'error'
"""

VIEWS["v_responses"] = """
SELECT conv_id, turn, role,
       CASE (conv_id + turn) % 4
         WHEN 0 THEN text || chr(10) || '{"valid": false, "python_versions": ["3.8"]} then {"valid": true, "python_versions": ["3.9"], "gpu_requirements": "CUDA needed"}'
         WHEN 1 THEN '<think>' || text || '</think> Use conda with python 3.' || CAST(7 + turn % 5 AS VARCHAR(10))
         WHEN 2 THEN text || chr(10) || '{"strategy": "docker", "options": {"gpu": true}} and {broken'
         ELSE text || chr(10) || '<thinking> unfinished' END AS content
FROM conversations
"""

# views whose rows carry text that is costly to read through
_REF = re.compile(r"\b(vocab|v_[a-z_]+)\b")


def needed(sql: str, extra: dict[str, str] | None = None) -> list[str]:
    """Views a SQL text refers to, dependencies first."""
    pool = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name in pool and name not in order:
                visit(pool[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``sql`` with the views it uses as common table expressions (``sql`` may bring its own)."""
    pool = {**VIEWS, **(extra or {})}
    ctes = ",\n".join(f"{n} AS ({pool[n].strip()})" for n in needed(sql, extra))
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    head = "WITH RECURSIVE " if recursive or (m and m[1]) else "WITH "
    return f"{head}{ctes}\n{',' + body[m.end():] if m else body}"


class Bound:
    """The derived tables of one data folder as DataFrames: ``Bound(spark, dir).v_deps``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        ship(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # call-site capture costs a stack walk per column expression on the driver
        spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for t in TABLES:
            if re.search(rf"\b{t}\b", full):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
