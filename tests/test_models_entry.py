import importlib.util
import os
import re
import shutil
import subprocess
import sys

import __spark_entry__ as E
from conftest import SF, rows
from pyspark.sql import functions as F

from stacklens.learning import models as M


def test_entry_points():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 120 and set(sql) <= set(qs)
    there = bool(importlib.util.find_spec("stacklens.llm")) and os.path.exists(os.path.join(os.path.dirname(E.__file__), "corpus_pipeline.py"))
    assert bool([n for n in qs if re.match(r"op\d|pipeline", n)]) == there


def test_entry_points_without_the_training_data_package(tmp_path):
    root, copy = os.path.dirname(os.path.abspath(E.__file__)), str(tmp_path / "copy")
    shutil.copytree(os.path.join(root, "stacklens"), os.path.join(copy, "stacklens"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), copy)
    says = "import __spark_entry__ as E; q = E.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(E.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", says], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, check=True)
    assert out.stdout.split() == [str(len([n for n in E.queries() if not re.match(r"op\d|pipeline$", n)])), "0", "True"]


def test_flagship(spark, ctx):
    out = E.queries()["q_issues_by_severity"](spark, SF)
    assert out.columns == ["type", "severity", "issues", "repos"] and out.count() > 4


def test_model_learns_saves_and_loads(spark, tmp_path):
    rep = "struct<gpu_dependencies:bigint,ml_dependencies:bigint,total_dependencies:bigint>"
    data = [(i, (i % 2, i % 5, i % 9), (i % 3,), ("docker" if i % 2 else "venv",), (i % 2 == 1,)) for i in range(200)]
    df = spark.createDataFrame(data, f"record_id bigint, repository_features {rep}, system_features struct<gpu_count:bigint>,"
                                     "resolution_features struct<strategy_type:string>, outcome struct<success:boolean>")
    t = M.train_strategy_model(df, trees=5, folds=2)
    assert t.metrics["test_accuracy"] > 0.95 and t.metrics["cv_mean"] > 0.9
    M.save_model(t, str(tmp_path), "strategy")
    back = M.load_model(spark, str(tmp_path), "strategy")
    cases = df.withColumnRenamed("record_id", "repo_id")
    a, b = M.score_strategies(cases, t), M.score_strategies(cases, back)
    assert sorted(rows(a)) == sorted(rows(b)) and a.where("rank = 1").count() == 200
    assert M.feature_importance(spark, t).count() == len(t.columns)


def test_scores_without_model_are_even(spark, ctx):
    from stacklens.plans.model_queries import _cases
    got = M.score_strategies(_cases(ctx), None)
    assert got.where(F.col("success_probability") != 0.5).count() == 0


def test_too_few_rows(spark):
    import pytest
    df = spark.createDataFrame([(1, (1, 1, 1), (1,), ("venv",), (True,))],
                               "record_id bigint, repository_features struct<gpu_dependencies:bigint,ml_dependencies:bigint,total_dependencies:bigint>,"
                               "system_features struct<gpu_count:bigint>, resolution_features struct<strategy_type:string>, outcome struct<success:boolean>")
    with pytest.raises(ValueError, match="insufficient"):
        M.train_strategy_model(df)


def test_only_metrics_train_the_folds(spark, monkeypatch):
    fits, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, *a, **b: fits.append(1) or fit(self, *a, **b))
    data = [(i, (i % 2, i % 5, i % 9), (i % 3,), ("docker" if i % 2 else "venv",), (i % 2 == 1,)) for i in range(100)]
    df = spark.createDataFrame(data, "record_id bigint, repository_features struct<gpu_dependencies:bigint,ml_dependencies:bigint,total_dependencies:bigint>,"
                                     "system_features struct<gpu_count:bigint>, resolution_features struct<strategy_type:string>, outcome struct<success:boolean>")
    t = M.train_strategy_model(df, trees=3, folds=2)
    assert M.confusion_matrix(t).agg(F.sum("n")).first()[0] == 20 and len(fits) == 1
    assert 0 <= t.metrics["cv_mean"] <= 1 and t.metrics["test_accuracy"] > 0.9 and len(fits) == 3


def test_records_and_cases_read_the_features_once_computed(ctx, monkeypatch):
    from stacklens.operators import features as FE
    from stacklens.plans.context import Context
    from stacklens.plans.model_queries import _cases
    made, make = [], FE.repository_features
    monkeypatch.setattr(FE, "repository_features", lambda *a: made.append(1) or make(*a))
    c = Context(ctx.spark, SF)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (c.stored_records, _cases(c))]
    assert len(made) == 1 and not any("lineitem" in p or "l_quantity" in p for p in plans)


def test_conflict_model_reads_copies_as_one_row(spark, monkeypatch):
    data = [(i, "torch" if i % 2 else "flask", None if i % 3 else "1.0", i % 4 == 1) for i in range(1200)]
    deps = spark.createDataFrame(data, "repo_id bigint, name string, version string, gpu_required boolean")
    issues = spark.createDataFrame([(i, "version") for i in range(1200) if i % 2 and i % 3 == 0], "repo_id bigint, type string")
    seen, fit = [], M.GBTClassifier._fit
    monkeypatch.setattr(M.GBTClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    t = M.train_conflict_model(deps, issues, rounds=4)
    stage = t.model.stages[-1]
    rows_of = M.conflict_training_data(deps, issues)
    plain = M.Pipeline(stages=[*M._prepare(M.CONFLICT_FEATURES), M.GBTClassifier(maxIter=4, maxDepth=6, stepSize=0.1, seed=M.SEED, labelCol="label")]).fit(
        M.split(rows_of, "repo_id", folds=1).where("train"))
    p = lambda model: {r["repo_id"]: round(r["probability"][1], 9) for r in model.transform(rows_of).collect()}
    assert seen[0] <= 8 and seen[1] == 960 and stage.getNumTrees == 4 and p(t.model) == p(plain)


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """Every level sought each row's node from the root of every tree; the forest must stay the same without that."""
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(3000).selectExpr("double(id % 17) a", "double(id * 7 % 23) b", "double(id * id % 29) c", "1.0 weight",
                                        "double((id % 17 > 8) != (id * 7 % 23 > 11) or id % 29 = 3) label")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    forest = M.strategy_forest(5)
    kept = forest.fit(data)
    sought = forest.copy({forest.cacheNodeIds: False}).fit(data)
    parts = lambda m: m.toDebugString.split("\n", 1)[1]
    assert forest.getCacheNodeIds() and parts(kept) == parts(sought) and kept.totalNumNodes > 50
