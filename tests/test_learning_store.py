"""Stores that change: retention by partitions, versioned matrices; patterns of all kinds and their conditions."""
import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stacklens.operators import patterns as P
from stacklens.session import shared_dir
from stacklens.sources import tables as TB

T0 = datetime(2024, 1, 1)


def _store(spark, n=40):
    path = shared_dir(spark)
    df = spark.createDataFrame([(i, T0 + timedelta(hours=12 * i)) for i in range(n)], "record_id bigint, ts timestamp")
    TB.append_training_records(df, path)
    return path


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_retention_touches_only_days_with_expired_rows(spark):
    path = _store(spark)
    before = _files(path)
    cutoff = F.lit(T0 + timedelta(hours=12 * 9)).cast("timestamp")  # noon of the fifth day
    assert TB.expire_stored(spark, path, cutoff) == 9
    assert sorted(r.record_id for r in spark.read.parquet(path).collect()) == list(range(9, 40))
    after = _files(path)
    kept = {f: t for f, t in before.items() if "day=2024-01-0" not in f or f.split("day=")[1][:10] > "2024-01-05"}
    assert kept and all(after[f] == t for f, t in kept.items())
    assert not any("day=2024-01-04" in f for f in after) and any("day=2024-01-05" in f for f in after)
    # once more, as after a run that broke off: nothing is left to do and nothing changes
    assert TB.expire_stored(spark, path, cutoff) == 0 and _files(path) == after
    # rows without a time have no age and stay
    TB.append_training_records(spark.createDataFrame([(99, None)], "record_id bigint, ts timestamp"), path)
    assert TB.expire_stored(spark, path, F.lit(T0 + timedelta(days=90)).cast("timestamp")) == 31
    assert [r.record_id for r in spark.read.parquet(path).collect()] == [99]


def test_matrix_versions(spark):
    path = shared_dir(spark)
    with pytest.raises(ValueError):
        TB.read_matrix(spark, path)
    m = TB.load_matrix(spark, "cuda")
    assert TB.update_matrix(m, path) == 1
    assert TB.update_matrix(m.limit(1), path) == 2 and TB.read_matrix(spark, path).count() == 1
    assert sorted(rows(TB.read_matrix(spark, path, 1).select("package", "version"))) == sorted(rows(m.select("package", "version")))
    # a write that broke off has no mark of success: readers stay with the last whole version, writers go past it
    m.write.parquet(f"{path}/version=3")
    os.remove(f"{path}/version=3/_SUCCESS")
    assert TB.read_matrix(spark, path).count() == 1 and TB.update_matrix(m, path) == 4
    assert TB.read_matrix(spark, path).count() == m.count()


RECORD = ("record_id bigint, repo_id bigint, ts timestamp, repository_features struct<ml_dependencies:bigint,gpu_dependencies:bigint,total_dependencies:bigint,is_ml_repo:boolean>, "
          "system_features struct<gpu_count:bigint,memory_gb:double,cpu_cores:bigint,has_nvidia_gpu:boolean>, resolution_features struct<strategy_type:string,has_gpu_support:boolean>, "
          "outcome struct<success:boolean,error_type:string>")


def _records(spark, n=400):
    rnd = random.Random(6)
    data = []
    for i in range(n):
        ml, gpu = rnd.randint(0, 4), rnd.randint(0, 2)
        ok = rnd.choice([True, True, False, None])
        data.append((i, i % 50, T0, (ml, gpu, ml + rnd.randint(0, 30), ml >= 2), (rnd.randint(0, 2), float(rnd.choice([4, 16, 64])), rnd.randint(1, 16), rnd.random() < 0.5),
                     ("docker" if gpu and rnd.random() < 0.9 else rnd.choice(["venv", "conda", None]), rnd.random() < 0.5), (ok, None if ok else rnd.choice(["cuda_error", "timeout", None]))))
    return spark.createDataFrame(data, RECORD)


def _key(df):
    return sorted(((r.pattern_id, r.pattern_type, r.support, round(r.confidence, 9), tuple(sorted(r.conditions.items())), tuple(r.recommendations))
                   for r in df.where("pattern_id IS NOT NULL").collect()), key=repr)


def test_all_kinds_in_one_pass_equal_the_four_kinds(spark):
    records = _records(spark)
    one = P.discover_patterns(records, 0.3)
    four = P.strategy_patterns(records).unionByName(P.dependency_patterns(records, 0.3)).unionByName(P.system_patterns(records, 0.3)).unionByName(P.error_patterns(records))
    assert _key(one) == _key(four) and {r.pattern_type for r in one.collect()} == {"strategy_success", "dependency_strategy", "system_strategy", "error_pattern"}


def test_each_kind_of_condition_decides(spark):
    case = lambda i, rep=(3, 1, 10, True), sys=(1, 32.0, 8, True), res=("docker", True): (i, i, T0, rep, sys, res, (True, None))
    cases = spark.createDataFrame([
        case(1), case(2, rep=(3, 1, 99, True)), case(3, rep=(3, 0, 10, True)), case(4, sys=(0, 32.0, 8, True)), case(5, sys=(1, 32.0, 8, False)),
        case(6, res=("venv", False)), case(7, res=(None, None)), case(8, rep=(None, 1, 10, True))], RECORD)
    pats = {"range": {"total_dependencies_range": "5-20"}, "range_of_doubles": {"memory_gb_range": "16.0-64.0", "ml_dependencies_range": "0-3"},
            "flag": {"requires_gpu": "true"}, "system_flag": {"has_nvidia_gpu": "true"}, "support": {"has_gpu_support": "true"},
            "strategy": {"strategy_type": "docker"}, "bucket": {"dependency_type": "complex_ml_gpu", "strategy": "docker"},
            "system": {"system_type": "high_end_gpu", "strategy": "docker"}, "both": {"dependency_type": "complex_ml_gpu", "system_type": "high_end_gpu"},
            "nothing": {}, "unknown": {"phase_of_moon": "full"}}
    df = spark.createDataFrame([(k, k, c, ["do"], 0.9) for k, c in pats.items()] + [("unsure", "unsure", {}, [], 0.5)],
                               "pattern_id string, description string, conditions map<string,string>, recommendations array<string>, confidence double")
    got = {}
    for r in P.match_patterns(cases, df).collect():
        got.setdefault(r.pattern_id, set()).add(r.repo_id)
    every = set(range(1, 9))
    assert got == {"range": every - {2}, "range_of_doubles": every - {8}, "flag": every - {3}, "system_flag": every - {5}, "support": every - {6},
                   "strategy": every - {6}, "bucket": every - {3, 6, 8}, "system": every - {4, 6}, "both": every - {3, 4, 8}, "nothing": every}
    assert P.match_patterns(cases, df.limit(0)).count() == 0
