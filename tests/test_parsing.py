import pytest
from conftest import rows
from pyspark.sql import functions as F

from stacklens.functions import text as X
from stacklens.operators import dependencies as D
from stacklens.operators import logs as L
from stacklens.operators import repository as RP


def files(spark, *contents, path="requirements.txt"):
    return spark.createDataFrame([(i, path, c) for i, c in enumerate(contents)], "repo_id bigint, path string, content string")


def parsed(df):
    return {r["name"]: (r["version"], r["gpu_required"], r["source"]) for r in df.collect()}


def test_requirements_golden(spark):
    text = ("# ML\n\nnumpy>=1.20.0\npandas==1.3.0\n\n# more\ntorch\ntensorflow-gpu>=2.0.0\n"
            "scikit-learn~=1.0.0\n-r dev.txt\nnumba>=0.5  # fast\ninvalid-format-here!!!\n"
            "git+https://example.org/x.git\npkg[x]>=1\nWheel >= 0.1,<2; python_version<'3.8'\n")
    got = parsed(D.parse_requirements(files(spark, text)))
    assert got["numpy"] == ("1.20.0", False, "requirements.txt:L3")
    assert got["torch"] == (None, True, "requirements.txt:L7")
    assert got["tensorflow-gpu"][:2] == ("2.0.0", True)
    assert got["scikit-learn"][0] == "1.0.0"
    assert got["numba"] == ("0.5", True, "requirements.txt:L11")
    assert got["wheel"][0] == "0.1,<2; python_version<'3.8'"
    assert set(got) == {"numpy", "pandas", "torch", "tensorflow-gpu", "scikit-learn", "numba", "wheel"}


@pytest.mark.parametrize("text", ["", "# Just a comment\n\n", "\n"])
def test_requirements_empty(spark, text):
    assert D.parse_requirements(files(spark, text)).count() == 0


SETUP = "from setuptools import setup\nsetup(name='x', install_requires=[\n 'numpy>=1.0', \"torch\",\n], requires=['six'])\n"


@pytest.mark.parametrize("mode", ["native", "exact"])
def test_setup_py(spark, mode):
    got = parsed(D.parse_setup_py(files(spark, SETUP), mode))
    assert got == {"numpy": ("1.0", False, "setup.py"), "torch": (None, True, "setup.py"), "six": (None, False, "setup.py")}


def test_setup_py_exact_edge_cases(spark):
    extras = "setup(install_requires=['a[b]>=1', 'c>=2'])"
    broken = "setup(install_requires=['numpy>=1'\n] oops ("
    df = D.parse_setup_py(files(spark, extras, broken), "exact")
    assert sorted((r["repo_id"], r["name"]) for r in df.collect()) == [(0, "c"), (1, "numpy")]


PYPROJECT = """[project]
dependencies = ["numpy>=1.20", "torch"]
[tool.poetry.dependencies]
python = "^3.9"
jax = "^0.4"
pandas = {version = "1.5", optional = true}
local = {path = "../x"}
[tool.black]
line-length = 99
"""


@pytest.mark.parametrize("mode", ["native", "exact"])
def test_pyproject(spark, mode):
    got = parsed(D.parse_pyproject(files(spark, PYPROJECT), mode))
    assert {k: v[:2] for k, v in got.items()} == {
        "numpy": ("1.20", False), "torch": (None, True), "jax": ("^0.4", True), "pandas": ("1.5", False), "local": (None, False)}


def test_pyproject_fallback(spark):
    got = parsed(D.parse_pyproject(files(spark, "dependencies = [\"numpy>=1\", \"flask\"]\nbroken = = 1"), "exact"))
    assert set(got) == {"numpy"}


@pytest.mark.parametrize("mode", ["native", "exact"])
def test_imports(spark, mode):
    code = "import os, sys\nimport numpy as np, torch.nn\nfrom PIL import Image\nfrom .local import x\nfrom sklearn import svm\nimport cv2\n"
    got = D.scan_imports(files(spark, code, path="a.py"), mode)
    assert sorted(r["name"] for r in got.collect()) == ["local", "numpy", "opencv-python", "pillow", "scikit-learn", "torch"]


def test_imports_syntax_error_is_skipped(spark):
    assert D.scan_imports(files(spark, "import numpy\ndef (:\n", path="a.py"), "exact").count() == 0


def test_repo_urls(spark):
    forms = ["https://github.com/o/n", "http://github.com/o/n.git", "git@github.com:o/n.git", "o/n",
             "https://github.com/o/n/tree/main", "not a url"]
    df = spark.createDataFrame([(u,) for u in forms], "url string")
    assert [r["repo_key"] for r in RP.parse_repo_url(df).collect()] == ["o/n"] * 5 + [None]


def test_readme(spark):
    text = "Python >= 3.8 needed.\nNVIDIA GPU recommended\npip install foo\nRequirements: git\n"
    r = RP.scan_readme(files(spark, text, path="README.md")).first()
    assert (r["python_version"], r["cuda_mentioned"], r["gpu_required"]) == ("3.8", True, True)
    assert r["installation_commands"] == ["pip install foo"] and r["system_requirements"] == [" git"]


def test_readme_first_candidate_wins(spark):
    df = files(spark, "python 3.9+").unionByName(files(spark, "x")).withColumn("path", F.lit("README.rst")) \
        .unionByName(files(spark, "python 3.7+", path="README.md"))
    assert RP.scan_readme(df).where("repo_id = 0").first()["python_version"] == "3.7"


def test_ci_compat_keeps_last_character(spark):
    text = "python-version: '3.9'\nrun: pytest\n"
    df = files(spark, text, path=".github/workflows/ci.yml")
    assert RP.scan_ci(df).first()["python_versions"] == ["3.9"]
    assert RP.scan_ci(df, compat=True).first()["python_versions"] == ["9"]


def logs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "log_id bigint, text string")


def test_pip_logs(spark):
    df = L.parse_pip_logs(logs(
        spark,
        "ERROR: No matching distribution found for nonexistent-package",
        "ERROR: Failed building wheel for cryptography\nerror: Microsoft Visual C++ 14.0 is required",
        "ERROR: tf-2.0-cp38-win32.whl is not a supported wheel on this platform.",
        "ERROR: a 1.0 has requirement package2==1.0.0, but you'll have package2 2.0.0 which is incompatible.\npackage2 required by zed",
        "ResolutionImpossible\nConnection broken", "all fine"))
    got = {(r["log_id"], r["error_type"], r["package"]) for r in df.collect()}
    assert got == {(0, "missing_dependency", "nonexistent-package"), (1, "build_error", "cryptography"),
                   (1, "build_error", "unknown"), (2, "platform_mismatch", "tf"), (3, "version_conflict", "package2"),
                   (4, "version_conflict", "multiple"), (4, "network_error", "unknown")}
    assert df.where("log_id = 1 and package = 'cryptography'").first()["suggested_resolution"].startswith("Install Microsoft")
    assert df.where("log_id = 3").first()["required_by"] == ["zed"]


def test_pip_suggestions(spark):
    rows_ = spark.createDataFrame([(1, "version_conflict", "torch"), (1, "build_error", "x")],
                                  "log_id bigint, error_type string, package string")
    tips = {r["suggestion"] for r in L.suggest_resolutions(rows_).collect()}
    assert "Create a fresh virtual environment" in tips and any("conda" in t for t in tips)


@pytest.mark.parametrize("text,want", [
    ('x {"valid": false} y {"valid": true, "a": {"b": 1}} z {"c": 2}', '{"valid": true, "a": {"b": 1}}'),
    ('{"a": 1} and {"b": 2}', '{"b": 2}'), ("<think>x</think> answer", "answer"),
    ("lead <think> cut", "lead"), ("plain", "plain"), ("{broken", "{broken")])
def test_response_answer(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.response_answer(F.col("t"))).first()[0] == want


def test_lists_with_extras_keep_their_other_entries(spark):
    from stacklens.operators import dependencies as D
    setup = 'setup(install_requires=["uvicorn[standard]>=0.2", "torch>=2.0", # ]\n "numpy"])'
    project = '[project]\ndependencies = ["uvicorn[standard]", "torch>=2.0", \'numpy\']\n'
    files = lambda text, path: spark.createDataFrame([(1, path, text)], "repo_id long, path string, content string")
    for parse, text, path in ((D.parse_setup_py, setup, "setup.py"), (D.parse_pyproject, project, "pyproject.toml")):
        for mode in ("native", "exact"):
            assert {"torch", "numpy"} <= {r.name for r in parse(files(text, path), mode).collect()}


def test_two_files_of_a_repository_keep_their_order(spark):
    df = spark.createDataFrame([(1, "b.txt", "torch\nnumpy==1.0\nflask"), (1, "a.txt", "flask==2.0\nnumpy"), (2, "a.txt", "numpy")],
                               "repo_id bigint, path string, content string")
    rows_ = D.parse_requirements(df)
    assert rows_.select("repo_id", "ord").distinct().count() == rows_.count() == 6
    got = {(r.repo_id, r.name): (r.version, r.ord.path, tuple(r.first_ord)) for r in D.dedup_dependencies(rows_).collect()}
    assert got == {(1, "flask"): ("2.0", "a.txt", (0, "a.txt", 0)), (1, "numpy"): ("1.0", "b.txt", (0, "a.txt", 1)),
                   (1, "torch"): (None, "b.txt", (0, "b.txt", 0)), (2, "numpy"): (None, "a.txt", (0, "a.txt", 0))}
    code = df.selectExpr("repo_id", "concat(path, '.py') as path", "'import torch, numpy' as content")
    both = D.union_sources(rows_, D.scan_imports(code))
    assert both.select("repo_id", "ord").distinct().count() == both.count() == 12
    # the GPU flag of a source file's import replaces a row that had none
    assert D.dedup_dependencies(both).where("repo_id = 2 AND name = 'torch'").first().ord.path == "a.txt.py"


def test_only_the_project_table_lists_dependencies(spark):
    text = '[project]\nname = "x"\ndependencies = ["numpy>=1"]\n[tool.hatch.envs.test]\ndependencies = ["pytest"]\n'
    assert sorted(parsed(D.parse_pyproject(files(spark, text)))) == sorted(parsed(D.parse_pyproject(files(spark, text), "exact"))) == ["numpy"]
    other = '[tool.hatch.envs.test]\ndependencies = [\n  "pytest",\n]\n[project]\ndependencies = [\n  "flask>=2",\n]\n'
    assert sorted(parsed(D.parse_pyproject(files(spark, other)))) == ["flask"]


def test_urls_of_other_hosts_and_with_queries(spark):
    df = spark.createDataFrame([("https://notgithub.com/o/n",), ("https://github.com/o/n?tab=readme",), ("https://github.com/o/n.git#main",),
                                ("ssh://git@github.com/o/n.git",), ("https://www.github.com/o/n/tree/main",)], "url string")
    assert [r["repo_key"] for r in RP.parse_repo_url(df).collect()] == [None] + ["o/n"] * 4


def test_dedup_equals_the_fold(spark):
    import random
    rnd = random.Random(4)
    data = [(rnd.randint(1, 3), i, rnd.choice("ab"), rnd.choice([None, "1", ""]), rnd.choice([True, False, False])) for i in range(300)]
    data += [(10 + i, j, "p", *((None, "1")[k % 2], (False, True)[k // 2])) for i in range(64) for j, k in enumerate((i % 4, i // 4 % 4, i // 16))
             for k in [k]]
    data = [(r, o, n, v, bool(g)) for r, o, n, v, g in data]
    want = {}
    for r, o, n, v, g in sorted(data, key=lambda x: x[1]):
        old = want.get((r, n))
        if old is None or (v and not old[1]) or (g and not old[2]):
            want[r, n] = (o, v, g)
    df = spark.createDataFrame(data, "repo_id bigint, ord bigint, name string, version string, gpu_required boolean")
    got = {(x.repo_id, x.name): (x.ord, x.version, x.gpu_required) for x in D.dedup_dependencies(df).collect()}
    assert got == want


def test_all_responses_of_a_repository_are_merged(spark):
    readme = spark.createDataFrame([(1, None, False, False, [], ["git"]), (2, "3.8", False, False, [], [])],
                                   "repo_id bigint, python_version string, cuda_mentioned boolean, gpu_required boolean, installation_commands array<string>, system_requirements array<string>")
    said = spark.createDataFrame([(1, 3, '{"python_versions": ["3.11"], "system_requirements": ["make"]}'), (1, 2, '{"python_versions": ["3.9"]}'),
                                  (1, 1, '{"gpu_requirements": "CUDA", "system_requirements": ["gcc"]}'), (1, 4, "not json"), (2, 1, '{"python_versions": ["3.12"]}')],
                                 "repo_id bigint, turn int, json_answer string")
    got = {r.repo_id: (r.python_version, r.gpu_required, r.system_requirements) for r in RP.merge_response_findings(readme, said).collect()}
    assert got == {1: ("3.9", True, ["git", "gcc", "make"]), 2: ("3.8", False, [])}


def test_dedup_reads_and_shuffles_its_rows_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "torch", "1.0", False, "python", "s"), (1, 2, "torch", None, True, "python", "s"), (1, 3, "Torch", "2.0", False, "python", "s")],
                               "repo_id bigint, ord bigint, name string, version string, gpu_required boolean, dep_type string, source string")
    df.write.parquet(str(tmp_path / "deps"))
    got = D.dedup_dependencies(spark.read.parquet(str(tmp_path / "deps")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [(r.ord, r.first_ord) for r in got.collect()] == [(3, 1)]
