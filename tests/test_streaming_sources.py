import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stacklens.operators import outcomes as O
from stacklens.session import shared_dir
from stacklens.sources import tables as TB
from stacklens.streaming import jobs as J

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Requests in five files whose times overlap: rows arrive up to 20 hours out of order."""
    folder = str(tmp_path_factory.mktemp("events"))
    rnd = random.Random(2)
    data = [(i, "k%d" % rnd.randint(0, 4), T0 + timedelta(minutes=600 * (i % 5) + rnd.randint(0, 1199)), rnd.choice("ab"),
             rnd.random() < 0.7, float(rnd.randint(1, 99))) for i in range(400)]
    schema = "request_id bigint, cache_key string, ts timestamp, strategy string, success boolean, setup_time double"
    for n in range(5):
        spark.createDataFrame(data[n::5], schema).coalesce(1).write.parquet(f"{folder}/part{n}")
    return folder, spark.createDataFrame(data, schema), schema


def stream(spark, events):
    folder, _, schema = events
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_success_stream_equals_batch(spark, events):
    got = J.stream_success_patterns(stream(spark, events))
    want = events[1].groupBy("strategy").agg(F.count_if("success").alias("count"), F.count_if(~F.col("success")).alias("failures"))
    assert sorted(rows(got.select("strategy", "count", "failures"))) == sorted(rows(want))


def test_windows_stream_equals_batch(spark, events):
    seen = {}
    got = J.stream_outcome_windows(stream(spark, events), "1 day", lateness="5 days", progress=seen)
    assert seen == {"batches": 5, "rows": 400, "late": 0}
    want = events[1].groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert sorted(rows(got.select("window_start", "runs"))) == sorted(rows(want))


def test_late_rows_are_dropped_and_counted(spark, events):
    """Files in falling order of time: each later file is older than the watermark allows."""
    folder = shared_dir(spark)
    for day in (9, 8, 7, 1):
        spark.createDataFrame([(i, T0 + timedelta(days=day, hours=i), True) for i in range(10)], "outcome_id bigint, ts timestamp, success boolean") \
            .coalesce(1).write.parquet(f"{folder}/{9 - day}")
    df = spark.readStream.schema("outcome_id bigint, ts timestamp, success boolean").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(folder)
    seen = {}
    got = {r.window_start.day: r.runs for r in J.stream_outcome_windows(df, lateness="2 days", progress=seen).collect()}
    assert got == {10: 10, 9: 10, 8: 10} and seen["batches"] == 4 and seen["rows"] == 40
    # one dropped row of the window aggregate stands for all rows of a window and task
    assert seen["late"] >= 1


def test_arrivals_are_late_within_their_bound(spark, events):
    df = events[1]
    folder, files = J.file_batches(df, 4, 45, "request_id")
    seen = [spark.read.parquet(f"{folder}/arrival={n}") for n in range(4)]
    assert files == 1 and sum(b.count() for b in seen) == 400 and all(b.count() for b in seen)
    spans = [b.agg(F.min("ts"), F.max("ts")).first() for b in seen]
    assert any(b[0] < a[1] for a, b in zip(spans, spans[1:]))  # out of order
    assert all(b[0] >= a[1] - timedelta(minutes=45) for a, b in zip(spans, spans[1:]))


def test_ingest_keeps_bad_records_apart_and_settings_stay(spark, events):
    rep = "struct<gpu_dependencies:bigint>"
    data = [(i, T0, (i % 3,), None if i % 5 == 0 else (1,), ("venv", i % 3 > 0), (True,)) for i in range(60)]
    df = spark.createDataFrame(data, f"record_id bigint, ts timestamp, repository_features {rep}, system_features struct<gpu_count:bigint>, "
                                     "resolution_features struct<strategy_type:string,has_gpu_support:boolean>, outcome struct<success:boolean>")
    path = shared_dir(spark)
    for n in range(3):
        df.where(F.col("record_id") % 3 == n).coalesce(1).write.parquet(f"{path}/{n}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    stored, held = J.stream_training_ingest(src)
    assert sorted(r.record_id for r in held.collect()) == list(range(0, 60, 5))
    assert stored.count() == 48 and stored.where(F.col("record_id") % 5 == 0).count() == 0
    assert {i.issue_type for r in held.collect() for i in r.issues} >= {"missing_required_field"}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    J.stream_ttl_cache(stream(spark, events), 3600, "21 hours").count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_ttl_stream_is_right_for_out_of_order_files(spark, events):
    got = J.stream_ttl_cache(stream(spark, events), 3600, "21 hours").where("fetched")
    mark = events[1].agg(F.max("ts")).first()[0] - timedelta(hours=21)
    want = O.cache_stores(events[1].where(F.col("ts") <= F.lit(mark)), 3600)
    assert sorted(rows(got.select("cache_key", "t").distinct())) == sorted(rows(want))


def test_ttl_stream_waits_at_the_watermark_and_carries_stores(spark):
    """A row at the watermark itself still waits, as in SQL; a store of an earlier batch serves a later one."""
    at = lambda i, key, minutes: (i, key, T0 + timedelta(minutes=minutes))
    path, schema = shared_dir(spark), "request_id bigint, cache_key string, ts timestamp"
    for n, data in enumerate([[at(1, "a", 0), at(2, "a", 10), at(3, "b", 70)], [at(4, "a", 65), at(5, "a", 12), at(6, "b", 75), at(7, "a", 5)], [at(8, "b", 135)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{n}")
        got = J.stream_ttl_cache(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path))
        # 7 comes behind the watermark
        assert sorted(rows(got.select("request_id", "fetched"))) == [
            [(1, True)], [(1, True), (2, False), (5, False)], [(1, True), (2, False), (3, True), (4, True), (5, False)]][n]


def test_ewma_stream_single_batch_equals_batch(spark, events):
    df = events[1].withColumnRenamed("request_id", "outcome_id")
    path = shared_dir(spark)
    df.coalesce(1).write.parquet(path)
    got = J.stream_ewma(spark.readStream.schema(df.schema).parquet(path))
    a = {r["strategy"]: (r["count"], round(r["avg_setup_time"], 9)) for r in got.collect()}
    b = {r["strategy"]: (r["count"], round(r["avg_setup_time"], 9)) for r in O.success_patterns_ewma(df).collect()}
    assert a == b


def test_ewma_stream_of_shuffled_batches_equals_batch(spark, events):
    df = events[1].withColumnRenamed("request_id", "outcome_id")
    got = J.stream_ewma(stream(spark, events).withColumnRenamed("request_id", "outcome_id"))
    a, b = ({r["strategy"]: (r["count"], round(r["avg_setup_time"], 9)) for r in x.collect()} for x in (got, O.success_patterns_ewma(df)))
    assert a == b and len(a) == 2


def test_retrain_trigger(spark, events):
    got = J.stream_retrain_trigger(stream(spark, events)).orderBy("samples").collect()
    assert [r["samples"] for r in got] == [80, 160, 240, 320, 400]
    assert got[0]["retrain"] and all(r["rediscover"] for r in got)


def test_repo_files_from_a_folder_tree(spark, tmp_path):
    d = tmp_path / "own" / "repo" / "sub"
    d.mkdir(parents=True)
    (d / "a.py").write_text("import x\n")
    r = TB.read_repo_files(spark, str(tmp_path), "text").first()
    assert (r["repo_id"], r["path"], r["content"], r["size"]) == ("own/repo", "sub/a.py", "import x\n", 9)


def test_gpu_inventory(spark):
    df = spark.createDataFrame([("RTX, 24576 MiB, 535.1",), ("A, 1024, 5, 8.0",), ("bad",)], "line string")
    assert rows(TB.parse_gpu_inventory(df)) == [("RTX", 24.0, "535.1", None), ("A", 1.0, "5", "8.0")]


def test_outcome_upsert_keeps_latest(spark):
    df = spark.createDataFrame([(1, 1, True, "docker", "u", T0), (2, 1, True, "docker", "u", T0 + timedelta(1)), (3, 1, False, "docker", "u", T0)],
                               "outcome_id bigint, repo_id bigint, success boolean, strategy string, url string, ts timestamp")
    assert sorted(rows(TB.current_outcomes(TB.with_solution_id(df)).select("outcome_id"))) == [(2,), (3,)]


def test_ingest_computes_features_once(ctx, monkeypatch):
    from stacklens.plans import stream_queries as SQ
    seen = []

    def caught(outcomes, features, systems):
        seen.extend(f for df in (features, systems) for f in df.inputFiles())
        raise StopIteration
    monkeypatch.setattr(SQ.FE, "training_records", caught)
    try:
        SQ._ingest(ctx)
    except StopIteration:
        pass
    assert seen and not any(t in f for f in seen for t in ("lineitem", "orders", "customer"))
