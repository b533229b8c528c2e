"""Near-duplicate documents by order MinHash, verified by banded alignment.

Sketch: the k-mers are runs of five words, labelled with how often they stood before in the text, so each is
unique. Each of ``SKETCHES`` hash functions picks the ``PICKED`` smallest, and their k-mers in text order make
one bucket key. Texts with few edits between them share keys; the same words in another order do not.

Candidates: texts that are equal are one entry. In a bucket all entries meet a leader (the smallest by a hash
of its own); those that match it, and the leader, are done there, and where two or more remain, these meet 16
further leaders: a group of n near copies costs n comparisons in a bucket and not n squared. Bucket keys of different
hash functions have different leaders. Matching is not transitive, so at the end all entries of a bucket are held
against those that these links leave in different classes and that have not met yet; entries of one class need not.
They are compared in blocks by how often words occur in them, in ``BAG`` hashed counts, which no match fails, and only
those that pass are joined. So the classes are those of all matches between entries that share a bucket.

Verification: the longest common subsequence of the two texts' words, within the band that a match can use,
over the longer text's words, must be ``SIMILAR`` or more. It reads the whole texts. Classes are the connected
components of the matches, found by contracting the links turn by turn, as tables.

Words are runs of bytes without ASCII white space. A text of fewer than five words is one k-mer. Defined
results: null, empty and blank texts are each a class of their own; repeated rows fall in one class; null ids
keep their rows and name no class unless it has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize, texts, unused
from stacklens.llm.words import chunks, count_of, hashed_counts, mix, words

K, SKETCHES, PICKED, SIMILAR = 5, 24, 4, (4, 5)
LEADERS = (1, 16)
#: Rows of a bucket, on each side, that meet in one group when classes are compared.
BUCKET_BLOCK = 1024
#: Hashed counts of a text's words.
BAG = 1024
SLOTS = 1 << 22


def _labelled(doc: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """K-mer hashes with their occurrence number mixed in; only texts that repeat one are sorted in full."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
    again = key[1:][key[1:] == key[:-1]] >> np.uint64(44)
    out = grams.copy()
    if len(again):
        at = np.flatnonzero(np.isin(doc, np.unique(again).astype(np.int64)))
        order = at[np.lexsort((at, grams[at], doc[at]))]
        new = np.concatenate([[True], (grams[order][1:] != grams[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        out[order] += (np.arange(len(order)) - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(out, 3)


def sketch(column: pa.Array):
    """Rows, their numbers of words, and their bucket keys (an array of SKETCHES columns) for parts of a column."""
    for row0, last, data, starts in chunks(column):
        at, h = words(data, starts)
        doc = np.searchsorted(starts, at, side="right") - 1
        n = np.bincount(doc, minlength=last - row0)
        with np.errstate(over="ignore"):
            grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(h) >= K:
                same = doc[:len(h) - K + 1] == doc[K - 1:]
                g = sum(h[j:len(h) - K + 1 + j] * np.uint64(2 * j + 3) * np.uint64(0x9FB21C651E98DF25) for j in range(K))
                grams, owner = mix(g[same], 1), doc[:len(h) - K + 1][same]
            short = np.flatnonzero((n > 0) & (n < K))
            if len(short):
                begin = np.searchsorted(doc, short)
                mine = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, n[short], strict=True)])
                where = np.concatenate([np.arange(c) for c in n[short]]).astype(np.uint64)
                whole = np.add.reduceat(h[mine] * (where * np.uint64(2) + np.uint64(3)), np.concatenate([[0], np.cumsum(n[short])[:-1]]))
                grams, owner = np.concatenate([grams, mix(whole, 2)]), np.concatenate([owner, short])
                order = np.argsort(owner, kind="stable")
                grams, owner = grams[order], owner[order]
        rows = np.flatnonzero(n)
        if not len(rows):
            yield row0 + np.arange(last - row0), n, None, rows
            continue
        labelled = _labelled(owner, grams)
        begin = np.searchsorted(owner, rows)
        count = np.diff(np.concatenate([begin, [len(owner)]]))
        keys = np.zeros((len(rows), SKETCHES), np.uint64)
        top = np.uint64(2 ** 64 - 1)
        for s in range(SKETCHES):
            v = mix(labelled, 10 + s)
            picks = []
            for _ in range(PICKED):
                least = np.minimum.reduceat(v, begin)
                hit = np.flatnonzero(v == np.repeat(least, count))
                # one place per row; where a row has fewer k-mers than picks, an old place is taken again
                place = np.full(len(rows), -1)
                segment = np.searchsorted(begin, hit, side="right") - 1
                place[segment[::-1]] = hit[::-1]
                picks.append(np.where(least == top, np.iinfo(np.int64).max, place))
                v[hit] = top
            key = np.full(len(rows), s, np.uint64)
            for p in np.sort(np.array(picks), axis=0):
                have = p < len(grams)
                key = np.where(have, mix(key ^ grams[np.where(have, p, 0)], 4), key)
            keys[:, s] = mix(key, 40 + s)
        yield row0 + np.arange(last - row0), n, keys, rows


def aligned(a: list, b: list) -> bool:
    """Whether the longest common subsequence is SIMILAR of the longer list or more, by a banded alignment."""
    num, den = SIMILAR
    if len(a) < len(b):
        a, b = b, a
    need = -(-len(a) * num // den)
    if len(b) < need:
        return False
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head + tail >= need:
        return True
    a, b, rest = a[head:len(a) - tail], b[head:len(b) - tail], need - head - tail
    if sum((Counter(a) & Counter(b)).values()) < rest:
        return False
    # a place of b can only match within the band, or too many words of the longer text are left over
    band = len(a) - rest
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j, w in enumerate(b):
        m = places.get(w, 0)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count() >= rest


def _held(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The texts (copy, text) of the entries that share a bucket, once each."""
    need = materialize(need)
    number = F.xxhash64("copy").alias("h")
    slots = docs.sparkSession.sparkContext.broadcast(  # of fixed size
        hashed_counts(need.select(number), lambda b: [b.column(0).to_numpy().astype(np.uint64)], SLOTS))

    def some(batches):
        for b in batches:
            keep = count_of(slots.value, b.column(2).to_numpy().astype(np.uint64)) > 0
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], ["copy", "text"])

    return materialize(docs.select("copy", "text", number).mapInArrow(some, "copy binary, text string")
                       .join(need, "copy", "left_semi").dropDuplicates(["copy"]))


def _verified(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the (copy, leader) pairs whose texts align."""

    def check(batches):
        for b in batches:
            keep = [aligned(x.encode().split(), y.encode().split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["copy", "leader"])

    both = (pairs.join(held, "copy").join(held.select(F.col("copy").alias("leader"), F.col("text").alias("other")), "leader")
            .select("copy", "leader", "text", "other"))
    return both.mapInArrow(check, "copy binary, leader binary")


def _close(n: str, m: str):
    num, den = SIMILAR
    return (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)


def _bags(held: DataFrame) -> DataFrame:
    """(copy, bag): how many words of each text fall into each of BAG slots, up to 255 a slot."""

    def run(batches):
        for b in batches:
            for row0, last, data, starts in chunks(b.column(1)):
                at, h = words(data, starts)
                doc = np.searchsorted(starts, at, side="right") - 1
                slot = (mix(h, 5) % np.uint64(BAG)).astype(np.int64)
                for first in range(0, last - row0, 1024):
                    few = min(1024, last - row0 - first)
                    own = slice(*np.searchsorted(doc, [first, first + few]))
                    n = np.bincount((doc[own] - first) * BAG + slot[own], minlength=few * BAG)
                    bags = np.minimum(n, 255).astype(np.uint8).reshape(few, BAG)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(row0 + first, few), pa.array([x.tobytes() for x in bags], pa.binary())],
                                                     ["copy", "bag"])

    return held.mapInArrow(run, "copy binary, bag binary")


def _may_match(t: pa.Table) -> pa.Table:
    """Pairs of a bucket's block, in different classes, whose lengths and words still allow a match: two texts have at
    most as many words in common as the lesser of their counts in each slot, and of what the slots do not hold."""
    num, den = SIMILAR
    column = lambda c: t[c].combine_chunks()
    n, few = column("n").to_numpy().astype(np.int64), column("few").to_numpy(zero_copy_only=False)
    bags = np.frombuffer(b"".join(column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
    over = n - bags.sum(axis=1, dtype=np.int64)
    both = column("label").to_pylist() + column("main").to_pylist()[:1]
    ranks = np.unique(np.array(both, "S16"), return_inverse=True)[1]  # of 16 bytes each
    label, main = ranks[:-1], ranks[-1]
    every = np.flatnonzero(~few)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(few):
        other = label[every]
        j = every[(other != label[i]) & ((other == main) | (label[i] < other)) & (n[i] * den >= n[every] * num) & (n[every] * den >= n[i] * num)]
        most = np.minimum(bags[i], bags[j]).sum(axis=1, dtype=np.int64) + np.minimum(over[i], over[j])
        j = j[most * den >= np.maximum(n[i], n[j]) * num]
        left.append(np.full(len(j), i))
        right.append(j)
    take = lambda at: column("copy").take(pa.array(np.concatenate(at)))
    return pa.table({"copy": take(left), "leader": take(right)})


def _across(rows: DataFrame, labels: DataFrame, tried: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (copy, leader) of ``rows`` (key, copy, n) that share a key, are in different classes by the labels,
    may match and are not among those tried."""
    rows = materialize(rows.join(labels.withColumnRenamed("node", "copy"), "copy", "left").withColumn("label", F.coalesce("label", "copy")))
    # in a bucket, the largest class meets the others and not itself
    mixed = (rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
             .agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("c"))
             .where("labels > 1").select("key", "main", F.ceil(F.col("c") / BUCKET_BLOCK).cast("int").alias("blocks")))
    rows = materialize(rows.join(mixed, "key"))
    bags = _bags(held.join(rows.select("copy").distinct(), "copy", "left_semi"))
    own = F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    few = rows.where(F.col("label") != F.col("main")).select("*", own.alias("a"), each.alias("b"), F.lit(True).alias("few"))
    every = rows.select("*", each.alias("a"), own.alias("b"), F.lit(False).alias("few"))
    met = (few.unionByName(every).join(bags, "copy").groupBy("key", "a", "b")
           .applyInArrow(_may_match, "copy binary, leader binary"))
    one_way = [F.least("copy", "leader").alias("copy"), F.greatest("copy", "leader").alias("leader")]
    return met.select(*one_way).distinct().join(tried.select(*one_way).distinct(), ["copy", "leader"], "left_anti")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, label) of the labels' links and of these (copy, leader) together."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    ends = (links.join(of("copy"), "copy", "left").join(of("leader"), "leader", "left")
            .select(F.coalesce("copy_label", "copy").alias("u"), F.coalesce("leader_label", "leader").alias("v")))
    more = components(ends, "u", "v")
    new = more.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return (labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
            .unionByName(more.join(labels, "node", "left_anti")))


def classes(docs: DataFrame) -> DataFrame:
    """(node, label) of the different texts that have a match: the text and the least of its class; ``docs``: copy, text."""

    def run(batches):
        for b in batches:
            for row, n, keys, with_keys in sketch(b.column(1)):
                if keys is not None:
                    ends = np.arange(len(with_keys) + 1, dtype=np.int32) * SKETCHES
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row[with_keys])), pa.array(n[with_keys], pa.int32()),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().astype(np.int64)))], ["copy", "n", "keys"])

    entries = materialize(docs.select("copy", "text").mapInArrow(run, "copy binary, n int, keys array<long>").dropDuplicates(["copy"]))
    rows = entries.select("copy", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    in_buckets = left = materialize(rows.join(shared, "key", "left_semi"))
    found, tried = None, None
    held = _held(docs, left.select("copy").distinct())
    for turn, leaders in enumerate(LEADERS):
        if left.isEmpty():
            break
        picked = [F.min(F.struct(F.xxhash64("key", "copy", F.lit(turn * 100 + j)).alias("h"), "copy", "n")).alias(f"l{j}") for j in range(leaders)]
        lead = (left.groupBy("key").agg(F.count("*").alias("c"), *picked).where("c > 1")
                .select("key", F.explode(F.array_distinct(F.transform(
                    F.array(*(f"l{j}" for j in range(len(picked)))), lambda x: F.struct(x["copy"].alias("leader"), x["n"].alias("m"))))).alias("l"))
                .select("key", "l.leader", "l.m"))
        met = materialize(left.join(lead, "key").where(_close("n", "m")).withColumn("own", F.col("copy") == F.col("leader")))
        pairs = met.where(~F.col("own")).select("copy", "leader").distinct()
        ok = materialize(_verified(held, pairs))
        found = ok if found is None else found.unionByName(ok)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if turn + 1 < len(LEADERS):
            done = met.where("own").select("key", "copy").unionByName(met.join(ok, ["copy", "leader"]).select("key", "copy")).distinct()
            # a bucket without leaders had one entry left; its rows are done as well
            open_keys = lead.select("key").distinct()
            left = materialize(left.join(open_keys, "key", "left_semi").join(done, ["key", "copy"], "left_anti"))
    if found is None:
        return entries.select(F.col("copy").alias("node"), F.col("copy").alias("label")).limit(0)
    labels = components(found, "copy", "leader")
    late = materialize(_verified(held, _across(in_buckets, labels, tried, held)))
    return labels if late.isEmpty() else _merged(labels, late)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes that have a link.

    In each turn a node goes over to the first of itself and its neighbours in a random order of the turn's own, and
    the links between the nodes gone over to are the next turn's; at most three quarters of the nodes stay on average.
    """
    one_way = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).select(*one_way).distinct())
    turns: list[DataFrame] = []
    while not turns or not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(turns)), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
        turns.append(materialize(ends.groupBy("node").agg(F.min(place("near")).alias("first"))
                                 .select("node", F.least(F.col("first"), place("node"))["to"].alias("to"))))
        over = lambda c: turns[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        edges = materialize(edges.join(over("u"), "u").join(over("v"), "v").where("u_to != v_to")
                            .select(F.col("u_to").alias("u"), F.col("v_to").alias("v")).select(*one_way).distinct())
    nodes = turns[0].select("node", F.col("to").alias("at"))
    for turn in turns[1:]:
        nodes = nodes.join(turn.select(F.col("node").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    nodes = materialize(nodes)
    return materialize(nodes.join(nodes.groupBy("at").agg(F.min("node").alias("label")), "at").select("node", "label"))


HAS_WORD = r"[^ \t\n\x0B\f\r]"


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (a digest of the text), class_id (the smallest id of the class), class_size, and ``first``
    (whether id and text are those of the class's first row) of every row."""
    d = texts(docs, id_col, text_col).withColumn("copy", F.unhex(F.md5("text")))
    links = classes(d).withColumnRenamed("node", "copy")
    member = d.select("doc_id", "copy", F.col("text").rlike(HAS_WORD).alias("some")).join(links, "copy", "left")
    member = member.withColumn("label", F.coalesce("label", "copy"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy"))
    sizes = member.where("some").groupBy("label").agg(least.alias("f"), F.count("*").alias("class_size"))
    out = member.join(sizes, "label", "left")
    is_first = F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.copy") == F.col("copy"))
    return out.select("doc_id", "copy", F.when(F.col("some"), F.col("f.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(F.col("some"), F.col("class_size")).otherwise(1).alias("class_size"),
                      F.when(F.col("some"), is_first).otherwise(True).alias("first"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without later members of a class: the row of the smallest id stays, once."""
    doc, copy, at = unused(docs, "doc", "copy", "at")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-2 ** 63))
    text = F.coalesce(text_col, F.lit(""))
    stay = near_classes(docs, id_col, text_col).where("first").select(number("doc_id").alias(doc), F.col("copy").alias(copy)).distinct()
    again = F.row_number().over(Window.partitionBy(doc, copy).orderBy(F.lit(0)))
    return (docs.withColumns({doc: number(id_col), copy: F.unhex(F.md5(text))}).join(stay, [doc, copy], "left_semi")
            .withColumn(at, again).where((F.col(at) == 1) | ~F.col(text_col).rlike(HAS_WORD) | F.col(text_col).isNull())
            .select(*docs.columns))


def op6_near_dedup(docs: DataFrame) -> DataFrame:
    return near_classes(docs).select("doc_id", "class_id", "class_size")
