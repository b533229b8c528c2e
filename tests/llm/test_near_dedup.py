"""Near duplicates: the alignment and the sketches against brute force, classes against all pairs."""
import random

from stacklens.llm import near_dedup as N


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _edited(rng, words, rate, vocabulary):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 2:
            out.append(rng.choice(vocabulary))
        elif r < rate * 3 / 4:
            continue
        elif r < rate:
            out += [w, rng.choice(vocabulary)]
        else:
            out.append(w)
    return out


def test_alignment_equals_dynamic_programming():
    rng = random.Random(1)
    yes = 0
    for _ in range(1500):
        v = [f"w{i}" for i in range(rng.choice([2, 5, 60]))]
        a = [rng.choice(v) for _ in range(rng.randrange(0, 50))]
        b = _edited(rng, a, rng.random() * 0.5, v)
        longer = max(len(a), len(b))
        want = longer == 0 or _lcs(a, b) * 5 >= longer * 4
        assert N.aligned(a, b) == want
        yes += want
    assert 300 < yes < 1400


def _shingles(w):
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_classes_hold_all_pairs_above_the_threshold(spark, docs):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for f in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 300))]
        rows += [(10_000 + 100 * f + i, " ".join(_edited(rng, base, rng.choice([0, 0.005, 0.02]), vocabulary))) for i in range(rng.choice([2, 3, 30]))]
    shared = [rng.choice(vocabulary) for _ in range(60)]  # a passage that unrelated texts share
    rows += [(50_000 + i, " ".join([rng.choice(vocabulary) for _ in range(90)] + shared)) for i in range(120)]
    got = {r.doc_id: r.class_id for r in N.op6_near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[50_000 + i] == 50_000 + i for i in range(120))
    sets = [(d, _shingles(t.split()), t.split()) for d, t in rows if d < 50_000]
    missed = 0
    for i, (a, x, p) in enumerate(sets):
        for b, y, q in sets[:i]:
            if len(x & y) * 9 >= 4 * (len(x) + len(y)) and _lcs(p, q) * 5 >= 4 * max(len(p), len(q)):
                missed += got[a] != got[b]
            elif not x & y and abs(len(p) - len(q)) < 0.2 * len(p) and a > 10_000 and b > 10_000:
                assert got[a] != got[b]
    assert missed == 0


def test_an_outlier_that_matches_only_the_centre_of_a_star_is_linked(spark):
    rng = random.Random(5)
    centre = [f"c{i}" for i in range(100)]
    rows = [(0, " ".join(centre))]
    outlier = centre + [f"x{i}" for i in range(24)]
    for i in range(1, 1001):
        copy = list(centre)
        at = rng.randrange(94)
        copy[at:at + 6] = [f"y{i}_{j}" for j in range(6)]
        rows.append((i, " ".join(copy)))
        assert not N.aligned(copy, outlier)
    rows.append((5000, " ".join(outlier)))
    assert N.aligned(centre, outlier)
    got = N.op6_near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 1002)}


def test_odd_rows(spark, odd):
    got = N.op6_near_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert (by[4].class_id, by[5].class_id, by[5].class_size) == (4, 4, 3) and by[1].class_id == 1 and by[2].class_size == 1
    kept = N.first_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", "1", "2", "3", "4", "6", "7", "8", "9"]) and kept[0].__fields__ == odd.columns
    assert N.op6_near_dedup(odd.limit(0)).count() == 0 == N.first_of_each(odd.limit(0)).count()


def test_classes_of_a_bucket_meet_only_where_their_words_allow_a_match(spark):
    """Texts around one centre that are no copies of each other shared a bucket and all met; now none of them do."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    centre = [rng.choice(vocabulary) for _ in range(200)]
    star = [centre + [rng.choice(vocabulary) for _ in range(90)] for _ in range(60)]
    close = [_edited(rng, centre, rng.random() * 0.4, vocabulary) for _ in range(60)] + [["again"] * 700 + centre, ["again"] * 700 + centre[:150]]
    texts = {f"{i:016d}".encode(): w for i, w in enumerate(star + close)}
    copies = list(texts)
    held = spark.createDataFrame([(bytearray(c), " ".join(w)) for c, w in texts.items()], "copy binary, text string")
    rows = spark.createDataFrame([(1, bytearray(c), len(w)) for c, w in texts.items()], "key long, copy binary, n int")
    labels = spark.createDataFrame([(bytearray(copies[60]), bytearray(copies[60])), (bytearray(copies[61]), bytearray(copies[60]))], "node binary, label binary")
    tried = spark.createDataFrame([(bytearray(copies[70]), bytearray(copies[80]))], "copy binary, leader binary")
    for block in (1024, 16):
        whole, N.BUCKET_BLOCK = N.BUCKET_BLOCK, block
        try:
            met = {tuple(sorted((bytes(r.copy), bytes(r.leader)))) for r in N._across(rows, labels, tried, held).collect()}
        finally:
            N.BUCKET_BLOCK = whole
        skipped = {(copies[60], copies[61]), (copies[70], copies[80])}
        want = {(a, b) for i, a in enumerate(copies) for b in copies[i + 1:] if N.aligned(texts[a], texts[b])} - skipped
        assert want <= met and not met & skipped and len(want) > 100
        assert not any(a in copies[:60] and b in copies[:60] for a, b in met)


def test_components_read_each_link_a_few_times_only(spark, monkeypatch):
    """A long chain beside a dense group: all links were read in every turn until the chain was done."""
    links = [(i, i + 1) for i in range(1000, 1200)] + [(i, j) for i in range(60) for j in range(i + 1, 60)] + [(7000, 7000), (7002, 7001)]
    written = []

    def count(df):
        written.append(df := whole(df))
        return df
    whole = N.materialize
    monkeypatch.setattr(N, "materialize", count)
    got = {r.node: r.label for r in N.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 1000 for i in range(1000, 1201)} | {i: 0 for i in range(60)} | {7000: 7000, 7001: 7001, 7002: 7001}
    assert got == want
    edges = [df.count() for df in written if df.columns == ["u", "v"]]
    assert edges[0] == len(links) and sum(edges[1:]) < len(links)
