"""Packing: whole pieces, gapless sequences, checksums of the library's ids, and closeness to the bound."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stacklens.llm import packing as P


def _check(rows, texts, size=1024):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(rs):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= size and (k == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq), -(-sum(r.length for r in rows) // size)


def test_packs_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, bound = _check(P.op7_packing(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    print("sequences", used, "bound", bound)
    assert used <= bound * 1.03 + 1


def test_odd_rows(spark, odd):
    rows = P.op7_packing(odd).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.doc_id == 4 for r in rows) == 2
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1} and P.op7_packing(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(65, np.int64)
    np.add.at(h, rng.integers(1, 65, rng.integers(0, 400)) if seed % 2 else np.minimum(64, rng.geometric(0.1, 500)), 1)
    plan = P.plan(h)
    back = np.zeros_like(h)
    for lengths, n in plan.patterns:
        assert sum(lengths) <= 64 and n > 0
        for v in lengths:
            back[v] += n
    assert (back == h).all() and plan.sequences <= -(-int((h * np.arange(65)).sum()) // 64) * 1.1 + 2


def test_long_runs_of_blanks(spark):
    texts = [(1, " " * 1_000_000 + "x"), (2, "a" + "\n" * 900_000), (3, "plain"), (4, "\t " * 500_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    used, bound = _check(P.op7_packing(df).collect(), texts)
    assert used <= bound + 1
