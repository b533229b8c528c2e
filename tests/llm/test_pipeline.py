"""The pipeline's stages against their operators' brute-force meanings, each on its own input."""
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from stacklens.session import materialize
from tests.llm.test_line_dedup import _brute as lines_that_go
from tests.llm.test_native import brute as base_spans
from tests.llm.test_packing import _check

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_in_turn(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()}
    assert all(truth.get(d, 1) == 1 for d in gone)
    before, after = seen["line_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    go = lines_that_go(rows)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in go.get(d, [])) for d, t in rows}
    assert {r.doc_id: r.text for r in after.collect()} == {d: t for d, t in want.items() if t.split() or d not in go}
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0
    before, after = seen["near_dedup"]
    assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()} and after.count() > 0
    before, after = seen["pii"]
    assert before.count() == after.count() and not any(base_spans(r.text) for r in after.collect())
    _check(seen["packing"][1].collect(), [(r.doc_id, r.text) for r in seen["packing"][0].collect()])


def test_odd_rows_and_no_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 0), (7, 1)], "doc_id long, toxic int")
    d = odd.withColumn("row", F.lit(1)).withColumn("copy", F.lit("x")).withColumn("digest", F.lit(2.0))
    for k, (df, least) in enumerate(((d, 5), (d.limit(0), 0))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert C.run(spark, f"{tmp_path}/{k}").count() >= least
