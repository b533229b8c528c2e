"""Toxicity: held-out accuracy, the grammar's classes, and odd input."""
import os
import zlib

import pytest

from stacklens.llm import toxicity as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in T.op1_toxicity(docs, labels).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in test)
    caught = [r.predicted for r in test if truth[r.doc_id]]
    false = sum(r.predicted for r in test if not truth[r.doc_id])
    print(len(test), right / len(test), sum(caught) / len(caught), false)
    assert right / len(test) > 0.95 and sum(caught) / len(caught) > 0.6 and false <= 0.01 * len(test)


def test_classes_of_the_grammar():
    g = T.Grammar({"idiot": 2.0, "vequ*": 3.0})
    used = lambda s: {c for c, x in zip(T.CLASSES, g.features(s), strict=True) if x}
    assert used("What an idiot.") == {"plain"} and used("some vequaire here") == {"plain"}
    assert used("you idiot") == {"targeted"} == used("idiot that you are")
    assert used("he is not an idiot") == {"negated"} and used("Not bad. An idiot") == {"plain"}
    assert used("She said idiot") == {"reported"} and used("I will kill you") == {"threat"}
    assert used("kill the process") == set() == used("") == used("clean words only")


def test_odd_rows_and_no_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.op1_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id == 1} == {0} and T.op1_toxicity(odd.limit(0), labels).count() == 0
    some = spark.createDataFrame([(1, 1), (None, 1), (2, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert T.op1_toxicity(odd, some).count() == odd.count()
