"""Line deduplication against brute force over all pairs of lines."""
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stacklens.llm import line_dedup
from stacklens.llm.words import hashed_bits, hashed_counts, in_bits, slot_of


def _brute(rows):
    lines = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for i, line in enumerate((t or "").split("\n")):
            if words := frozenset(line.encode().split()):
                lines.append((d, i, words))
    out, seen = {}, []
    for d, i, w in lines:
        if any(len(w & v) * 9 >= 4 * (len(w) + len(v)) for v in seen):
            out.setdefault(d, []).append(i)
        seen.append(w)
    return out


def _got(df):
    return {r.doc_id: list(map(int, r.removed_lines.split(","))) for r in line_dedup.op2_line_dedup(df).collect() if r.n_removed}


def test_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert _got(docs) == _brute(rows)


def test_near_lines(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))] for _ in range(25)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _brute(rows)
    assert _got(df) == want and sum(map(len, want.values())) > 100
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert all(kept[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, [])) for d, t in rows)


def test_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "removed_lines"] or set(odd.columns) < set(out.columns)
    rows = out.collect()
    assert len(rows) == odd.count() and {r.text for r in rows if r.doc_id == 1} == {None}
    assert {r.text for r in rows if r.doc_id == 4} == {"same words here for all to see"} and {r.text for r in rows if r.doc_id == 5} == {""}
    assert line_dedup.op2_line_dedup(odd.limit(0)).count() == 0
    clash = odd.withColumn("tie", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(2))
    assert line_dedup.dedup_lines(clash).where("n_lines = 'x'").count() == odd.count()


def _met(rows, size):
    """What a step gives for rows in batches of some size: pairs, and rows of tokens with many with their first entry."""
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k:k + size], strict=True)], ["token", "doc", "at", "size", "sig"])
               for k in range(0, len(rows), size)]
    out = [r for b in line_dedup._meet(iter(batches)) for r in b.to_pylist()]
    return ({(r["doc"], r["y_doc"]) for r in out if r["token"] is None},
            {(r["token"], r["doc"]): r["y_doc"] for r in out if r["token"] is not None})


def test_tokens_with_few_and_with_many_entries(monkeypatch):
    """One row a token and entry went through two windows, and rows of tokens with many were dealt out three times more."""
    rng = random.Random(3)
    rows, doc = [], 0
    for token, c in enumerate([1, 2, 5, 300, 40, 3, 2000, 7, 1]):
        for _ in range(c):
            doc += 1
            sig = -rng.getrandbits(63) if token == 4 else rng.choice([0, 1, 3, -1])
            rows.append((token, doc, 0, (rng.choice([10, 11, 30]) << 32) + rng.randrange(2), sig))
    monkeypatch.setattr(line_dedup, "ROWS", 500)
    fits = lambda x, y: bool(line_dedup._fit_arrays(np.array([x[3], y[3]]), np.array([x[4], y[4]]), np.array([0]), np.array([1]))[0])
    for size in (1, 64, 5000):
        pairs, many = _met(rows, size)
        by = {t: [r for r in rows if r[0] == t] for t in range(9)}
        # all entries of a token with many are there, each with the first one if it fits
        of_many = {t for t, _ in many}
        assert {3, 6} <= of_many and 4 not in of_many
        assert many == {(t, r[1]): by[t][0][1] if r is not by[t][0] and fits(r, by[t][0]) else None for t in of_many for r in by[t]}
        assert pairs == {(x[1], y[1]) for t in range(9) if t not in of_many for k, x in enumerate(by[t]) for y in by[t][:k] if fits(x, y)}
        assert len(pairs) <= sum(len(by[t]) for t in range(9) if t not in of_many) * (line_dedup.DENSE + line_dedup.FEW // 2)


def test_rows_of_a_token_in_any_order(monkeypatch):
    rng = random.Random(9)
    rows = [(t, rng.randrange(-50, 50) if t else d, d, (10 << 32) + 1, 0) for t, c in enumerate([700, 12, 90, 5]) for d in range(c)]
    want = _met(sorted(rows), 64)
    mixed = sorted(rows, key=lambda r: (r[0], rng.random()))
    assert _met(mixed, 64) == want
    monkeypatch.setattr(line_dedup, "ROWS", 100)
    _, many = _met(mixed, 20)
    assert len([1 for t, _ in many if t == 0]) == 700 and all(y is None or y < d for (t, d), y in many.items() if t == 0)


def test_long_lines_that_share_a_word_do_not_meet():
    """64 bits let every pair of lines of 150 words or more through."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.append(rng.integers(0, 1 << 50, 150), 7)) for _ in range(60)]
    sigs = np.stack(line_dedup._signatures(np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets])))
    i, j = np.triu_indices(60, 1)
    size = np.array([(len(s) << 32) for s in sets])
    assert line_dedup._fit_arrays(size, sigs, i, j).mean() < 0.01
    assert line_dedup._fit_arrays(size, sigs, i, i).all()


def test_folded_signatures_lose_no_match():
    """Sets on both sides of the length up to which signatures are folded."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 50, 90)
    sets = [np.unique(base[:n] if k else np.append(base[:n - 3], rng.integers(0, 1 << 50, 3))) for n in range(55, 75) for k in (0, 1)]
    n = np.array([len(s) for s in sets])
    sigs = np.stack(line_dedup._signatures(np.concatenate(sets).astype(np.uint64), n))
    i, j = np.triu_indices(len(sets), 1)
    match = np.array([len(np.intersect1d(sets[a], sets[b])) * 9 >= 4 * (n[a] + n[b]) for a, b in zip(i, j, strict=True)])
    assert line_dedup._near(n[i], n[j], sigs, i, j)[match].all() and match.any() and (sigs[1] == 0).sum() == (n <= line_dedup.SHORT).sum()


def test_entries_of_a_frequent_word_meet_set_by_set(spark, monkeypatch):
    """All unsettled entries of a token came out paired with all earlier ones that the signatures let through."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.sample(vocabulary, 24) for _ in range(8)]
    rows = [(0, " ".join(vocabulary * 700))]
    for d in range(1, 601):
        line = list(base[d % 8])
        for _ in range(rng.randrange(0, 5)):
            line[rng.randrange(24)] = rng.choice(vocabulary)
        rows.append((d, " ".join([*line, "rare"])))
    made = []
    plain = line_dedup._unsettled

    def counted(many, *more):
        out = plain(many, *more)
        made.append((many.count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "_unsettled", counted)
    monkeypatch.setattr(line_dedup, "CELL", 1 << 12)  # several blocks on both sides
    want = _brute(rows)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want and 300 < len(want) < 600
    (many, out), = made
    assert 400 < many and 50 < out <= many


def test_matched_equals_brute_force():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(14), rng.randrange(5, 12))) for _ in range(120)]
    rows = [(late, d, -1 if d % 2 else 1, d % 3, s) for d, s in enumerate(sets) for late in ((False, True) if d % 4 else (False,))]
    rng.shuffle(rows)
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    cell = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["late", "doc", "tie", "line", "tokens"])
    near = lambda a, b: len({*a} & {*b}) * 9 >= 4 * (len(a) + len(b))
    got = line_dedup._matched(cell)
    assert sorted(got["doc"].to_pylist()) == [d for d in range(120) if d % 4 and any(near(sets[d], sets[e]) for e in range(d))]
    assert line_dedup._matched(cell.filter(cell["late"])).num_rows == 0


class _Local:
    """As much of a table as counting uses."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self

    groupBy = applyInArrow = lambda self, *_: self

    def collect(self):
        return [{"part": b.column(0)[0].as_py(), "n": zlib.decompress(b.column(1)[0].as_py())} for b in self.run(iter(self.batches))]


def test_counting_takes_little_memory_beside_its_table():
    rng = np.random.default_rng(1)
    h = [rng.integers(0, 5000, 10_000).astype(np.uint64) for _ in range(80)]
    tracemalloc.start()
    got = hashed_counts(_Local(h), lambda b: [b], 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.bincount(slot_of(np.concatenate(h), 1 << 20), minlength=1 << 20)
    assert (got[0] == want).all() and peak < 12 << 20


def test_many_sparse_entries_of_a_token_come_out_as_pairs():
    """Rows of every token with more than 256 entries came out, to be dealt out with their sets once more."""
    rng = random.Random(12)
    rows = []
    for d in range(900):
        n = rng.choice([20, 22, 40, 60, 63, 66, 70, 75, 150])
        sigs = [rng.getrandbits(63), 0] if n <= line_dedup.SHORT else [rng.getrandbits(63), rng.getrandbits(63)]
        rows.append((7, d, 0, (n << 32) + rng.randrange(3), *sigs))
        if d % 9 == 0:  # a near one, some beyond the length up to which signatures are folded
            m = n + rng.randrange(-2, 4)
            if m <= line_dedup.SHORT:
                near = [sigs[0] ^ sigs[1] ^ 3, 0]
            else:
                near = [sigs[0] ^ 3, sigs[1]] if n > line_dedup.SHORT else [sigs[0] ^ 5, 0]
            rows.append((7, d, 1, (m << 32) + rng.randrange(3), *near))
    names = ["token", "doc", "at", "size", *line_dedup.SIGS]
    shuffled = rng.sample(rows, len(rows))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*shuffled, strict=True)], names)
    out = [r for b in line_dedup._meet(iter([batch])) for r in b.to_pylist()]
    table = np.array(sorted(rows), np.int64).T
    i, j = np.tril_indices(len(rows), -1)
    fit = line_dedup._fit_arrays(table[3], table[4:], i, j)
    assert all(r["token"] is None for r in out) and 90 < fit.sum() < 400
    at = [(int(d), int(a)) for d, a in table[1:3].T]
    assert sorted(((r["doc"], r["at"]), (r["y_doc"], r["y_at"])) for r in out) == sorted((at[x], at[y]) for x, y in zip(i[fit], j[fit], strict=True))


def test_repeated_lines_are_sent_without_tokens(spark):
    """Every copy of a line was sent and stored with its tokens; rows that stand twice must not lose their lines."""
    same = "one common line of some seven words"
    rows = [(d, f"{same}\nown words of text number {d} x{d} y{d}\n{same}") for d in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = spark.sparkContext.broadcast(np.full((1, 64), 9, "<u2"))
    docs = df.select(F.col("doc_id").alias("doc"), F.lit(0).alias("tie"), "text")
    sent = line_dedup._entries(docs, counted).where("size(tokens) > 0 AND n = 7").count()
    assert 0 < sent <= 3
    assert _got(df) == {d: [0, 2] if d else [2] for d in range(60)}


def test_bits_of_met_places_hold_few_others():
    """4 million slots were half full with the places of 6 GB, and half of all lines' tokens were sent."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    bits = hashed_bits(_Local([h[:50_000], h[50_000:]]), lambda b: [b], 1 << 22)
    assert in_bits(bits, h).all() and in_bits(bits, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.06
    assert bits.nbytes == (1 << 22) // 8 and line_dedup.MET_SLOTS // 8 <= 8 << 20


def test_written_intermediates_leave_no_shuffle_files(spark, tmp_path):
    """All shuffles of a query stayed on disk until its end."""
    from stacklens.session import CLEANUP, materialize

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    spark.sparkContext._jvm.System.gc()
    held = lambda: sum(b.toString().startswith("shuffle_") for b in _all(tracker))
    before = held()
    out = materialize(spark.range(1000).repartition(4, "id"))
    assert held() <= before and out.count() == 1000 and spark.conf.get(CLEANUP) == "false"


def _all(manager):
    disk = manager.diskBlockManager().getAllBlocks().iterator()
    while disk.hasNext():
        yield disk.next()
