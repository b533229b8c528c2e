"""Ranked lexical search with bit-sliced Bloom signatures.

Index: every text is cut into terms. Texts of similar size share blocks; a block has one bitmap over its texts
for each bit of their signatures (a slice), and a text sets ``PROBES`` bits for each of its terms and for each
level of ``LEVELS`` that the term's number of occurrences reaches. Signatures have 12 to 24 bits for each of a
text's entries, so a term that a text does not hold seems present once in a few hundred cases.

Search: a term's slices, combined by AND, give the texts that may hold it, and a superset of those that hold it
so often. The score of the highest level that a text may reach, times the term's weight, summed over the item's
terms, is never below the text's score. First the ``k`` texts of the highest such bounds are scored exactly;
the k-th of these scores is a bound from below. Then every text whose bound reaches it is scored exactly on its
whole text, so nothing is lost and false presence only costs work. Items are taken in blocks of ``ENTRIES``
terms, each against the whole index.

Equal texts are scored once. Scores are 64-bit integers by the formula of ``score``; the counts behind weights
are of all rows. Signatures hash terms; counts of documents and scores compare the terms themselves.

Defined results: null, empty and term-free texts count nowhere and are never found; repeated rows each count
and are each ranked; a row with a null id counts and ranks before other ids of its score; rows of one item id
(null is one) are one item with the terms of all of them; an item without terms, or whose terms no document
holds, has no rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize, shared_dir, texts
from stacklens.llm.words import chunks, mix, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs that stand between terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Occurrences from which a term sets further bits; between two levels the bound takes the most that is possible.
LEVELS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 1024, 4096]
PROBES, BITS = 5, 12
#: Texts of a block, and bits of a block (a longer text has a block of its own).
BLOCK, BLOCK_BITS = 2048, 1 << 24
#: Terms times texts whose bounds are computed at once.
CELLS = 1 << 21
#: Terms of the items that are searched at once; an item with more is searched alone.
ENTRIES = 1 << 16
#: Texts to score that are broadcast; more are joined by a shuffle.
FEW = 100_000
INDEX = "width long, n array<long>, copies binary, slices binary, docs long, terms long"

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = str.maketrans(UPPER, LOWER)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda t: t != "")


def term_list(text: str) -> list[str]:
    return TERM.findall(text.translate(_FOLD))


def score(tf, m):
    """A term's part of a text's score without its weight, for numbers or arrays."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n, n_docs: int, n_terms: int):
    return 100 - 25 + (25 * n * n_docs) // n_terms


def term_hashes(column: list[str]) -> np.ndarray:
    """The hashes that the index has for these terms, one word each."""
    out = []
    for _, _, data, starts in chunks(pa.array(column, pa.string())):
        out.append(words(_LOWER[data], starts, _BETWEEN)[1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def places(h: np.ndarray, level: int, width) -> np.ndarray:
    """The bits of each hash at a level, PROBES columns, in signatures of ``width`` bits (powers of two)."""
    h = mix(h, 50 + level)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(width, np.int64).astype(np.uint64) - np.uint64(1)
    return np.stack([((a + b * np.uint64(i)) & mask).astype(np.int64) for i in range(PROBES)], axis=1)


class _Blocks:
    """Texts of one signature width until they fill a block."""

    def __init__(self, width: int):
        self.width, self.room = width, max(1, min(BLOCK, BLOCK_BITS // width))
        self.n: list[int] = []
        self.copies: list[bytes] = []
        self.bits: list[np.ndarray] = []
        self.seen: dict[bytes, int] = {}
        self.docs = self.terms = 0

    def add(self, copy: bytes, n: int, bits: np.ndarray) -> bool:
        self.docs, self.terms = self.docs + 1, self.terms + n
        if copy not in self.seen:
            self.seen[copy] = len(self.n)
            self.n.append(n), self.copies.append(copy), self.bits.append(bits)
        return len(self.n) >= self.room

    def row(self) -> pa.RecordBatch:
        plane = np.zeros((self.width, -(-len(self.n) // 8) * 8), bool)
        for r, bits in enumerate(self.bits):
            plane[bits, r] = True
        values = [self.width, self.n, b"".join(self.copies), np.packbits(plane, axis=1).tobytes(), self.docs, self.terms]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
            ["width", "n", "copies", "slices", "docs", "terms"])


def _index(batches):
    """Blocks of bit slices from batches of (copy, text)."""
    held: dict[int, _Blocks] = {}
    for b in batches:
        copies = b.column(0).to_pylist()
        for row0, last, data, starts in chunks(b.column(1)):
            at, h = words(_LOWER[data], starts, _BETWEEN)
            doc = np.searchsorted(starts, at, side="right") - 1
            n = np.bincount(doc, minlength=last - row0)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            first = np.flatnonzero(new)
            tf = np.diff(np.concatenate([first, [len(h)]]))
            doc, h = doc[first], h[first]
            reached = np.searchsorted(LEVELS, tf, side="right")
            entries = np.bincount(doc, reached, last - row0).astype(np.int64)
            widths = np.array([1 << max(6, int(BITS * e - 1).bit_length()) for e in entries.tolist()], np.int64)
            bits, owner = [], []
            for level in range(int(reached.max(initial=0))):
                at = np.flatnonzero(reached > level)
                bits.append(places(h[at], level, widths[doc[at]]))
                owner.append(doc[at])
            if not bits:
                continue
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            begin = np.searchsorted(owner[order], np.arange(last - row0 + 1))
            bits = np.concatenate(bits)[order].astype(np.int32 if widths.max() < 2 ** 31 else np.int64)
            for i in np.flatnonzero(n).tolist():
                width = int(widths[i])
                block = held.setdefault(width, _Blocks(width))
                if block.add(copies[row0 + i], int(n[i]), bits[begin[i]:begin[i + 1]].ravel()):
                    yield held.pop(width).row()
    for block in held.values():
        yield block.row()


def _bounds(width: int, n: np.ndarray, slices: np.ndarray, query: dict, stats: tuple[int, int]):
    """For each item of ``query``: the upper bounds of the block's texts, from some texts (the first's place is given) at a time."""
    step = max(8, CELLS // max(1, len(query["h"])) // 8 * 8)
    for at in range(0, len(n), step):
        for i, bounds in _some_bounds(width, n[at:at + step], slices[:, at // 8:(at + step) // 8], query, stats):
            yield i, at, bounds


def _some_bounds(width: int, n: np.ndarray, slices: np.ndarray, query: dict, stats: tuple[int, int]):
    size = len(n)
    h = query["h"]
    level = np.zeros((len(h), size), np.int16)
    alive = np.arange(len(h))
    for j in range(len(LEVELS)):
        hit = np.bitwise_and.reduce(slices[places(h[alive], j, width)], axis=1)
        some = hit.any(axis=1)
        alive, hit = alive[some], hit[some]
        here = np.unpackbits(hit, axis=1, count=size).astype(bool) & (level[alive] == j)
        some = here.any(axis=1)
        alive = alive[some]
        if not len(alive):
            break
        level[alive] += here[some]
    m = length_norm(n, *stats)
    most = np.array([x - 1 for x in LEVELS[1:]], np.int64)
    part = np.zeros((len(LEVELS) + 1, size))
    part[1:-1] = score(most[:, None], m[None, :])
    part[-1] = 1_000_000  # of however many occurrences
    value = np.take_along_axis(part, level.astype(np.int64), axis=0)
    for i, (at, weight) in enumerate(query["items"]):
        yield i, weight @ value[at]


def _blocks_of(batches):
    for b in batches:
        for width, n, copies, slices in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = np.array(n, np.int64)
            yield width, n, np.frombuffer(copies, "S16"), np.frombuffer(slices, np.uint8).reshape(width, -1)


def _hits(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    items, copies = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(copies, pa.binary())], ["item", "copy"])


def _score_texts(docs: DataFrame, hits: DataFrame, entries: list[dict[str, tuple]], stats: tuple[int, int]) -> DataFrame:
    """(item, copy, score) of the (item, copy) pairs in ``hits``, on the whole texts; entries: term -> (item, weight) lists."""
    wanted = materialize(hits.groupBy("copy").agg(F.collect_set("item").alias("items")))  # no more items than a block has
    few = wanted.count() <= FEW
    rows = docs.join(F.broadcast(wanted) if few else wanted, "copy").select("copy", "text", "items")

    def run(batches):
        done: set[bytes] = set()
        for b in batches:
            out = []
            for copy, text, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if copy in done:
                    continue
                if len(done) < FEW:
                    done.add(copy)
                found = term_list(text)
                m, tf = length_norm(len(found), *stats), Counter(found)
                for i in items:
                    s = sum(w * score(tf[t], m) for t, w in entries[i].items() if t in tf)
                    if s > 0:
                        out.append((i, copy, s))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64()), strict=True)],
                                             ["item", "copy", "score"])

    return materialize(rows.mapInArrow(run, "item int, copy binary, score long").distinct())


def _query_blocks(items: DataFrame, item_col: str, text_col: str):
    """Lists of (item id, {term: occurrences}) of ENTRIES terms or of one item; a block at a time on the driver."""
    rows = (items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("term"))
            .groupBy("item_id", "term").count().orderBy("item_id", "term"))
    block: list[tuple] = []
    held = 0
    for r in rows.toLocalIterator():
        if not block or block[-1][0] != r["item_id"]:
            if held >= ENTRIES:
                yield block
                block, held = [], 0
            block.append((r["item_id"], {}))
        block[-1][1][r["term"]] = r["count"]
        held += 1
    if block:
        yield block


def _search_block(docs: DataFrame, index: DataFrame, block: list, stats: tuple[int, int], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    names = sorted({t for _, tf in block for t in tf})
    asked = F.broadcast(spark.createDataFrame([(t,) for t in names], "term string"))  # of the block's terms
    weight = F.floor(1000 * F.log((2 * F.lit(stats[0]) + 2).cast("double") / (2 * F.col("df") + 1)))
    found = (docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(asked, "term")
             .groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")))
    w = {r["term"]: r["w"] for r in found.collect() if r["w"] > 0}
    if not w:
        return None
    names = sorted(w)
    number = {t: i for i, t in enumerate(names)}
    entries = [{t: c * w[t] for t, c in tf.items() if t in w} for _, tf in block]
    sums = [(np.array([number[t] for t in e], np.int64), np.array(list(e.values()), np.float64)) for e in entries]
    query = {"h": term_hashes(names), "items": sums}

    def best(batches):
        """The k highest bounds of each item in a task."""
        top: list[list] = [[] for _ in block]
        for width, n, copies, slices in _blocks_of(batches):
            for i, first, ub in _bounds(width, n, slices, query, stats):
                at = np.argpartition(-ub, k)[:k] if len(ub) > k else np.arange(len(ub))
                least = top[i][-1][0] if len(top[i]) == k else 0
                new = [(float(ub[j]), copies[first + j].ljust(16, b"\0")) for j in at[ub[at] > least].tolist()]
                if new:
                    top[i] = sorted({*top[i], *new}, reverse=True)[:k]
        out = [(i, c, u) for i, t in enumerate(top) for u, c in t]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.float64()), strict=True)],
                                         ["item", "copy", "bound"])

    blocks = index.select("width", "n", "copies", "slices")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "copy")
    first = (blocks.mapInArrow(best, "item int, copy binary, bound double").distinct()
             .withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("item", "copy"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "copy")
    kth = {r["item"]: r["score"] for r in _score_texts(docs, first, entries, stats).withColumn("at", F.row_number().over(by_score))
           .where(F.col("at") == k).select("item", "score").collect()}
    least = [kth.get(i, 1) for i in range(len(block))]

    def reach(batches):
        """All texts that are not excluded by their bound."""
        for width, n, copies, slices in _blocks_of(batches):
            yield _hits([(i, copies[first + j].ljust(16, b"\0")) for i, first, ub in _bounds(width, n, slices, query, stats)
                         for j in np.flatnonzero(ub >= least[i]).tolist()])

    scored = _score_texts(docs, blocks.mapInArrow(reach, "item int, copy binary"), entries, stats)
    # copies add further documents and never push out a text of the k best or one that ties with the k-th
    best_texts = scored.withColumn("at", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("at") <= k).drop("at")
    owners = docs.select("doc_id", "copy").join(best_texts.select("copy").distinct(), "copy", "left_semi")
    owners = owners.withColumn("at", F.row_number().over(Window.partitionBy("copy").orderBy("doc_id"))).where(F.col("at") <= k)
    final = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best_texts.join(owners, "copy").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    rows = texts(docs, id_col, text_col).withColumn("copy", F.unhex(F.md5("text")))
    index = materialize(rows.select("copy", "text").mapInArrow(_index, INDEX))
    total = index.agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    if not total["n"]:
        return spark.createDataFrame([], schema)
    stats = (total["n"], total["l"])
    path, wrote = shared_dir(spark), False
    for block in _query_blocks(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).alias("text")), "item_id", "text"):
        part = _search_block(rows, index, block, stats, k)
        if part is not None:
            part.write.mode("append").parquet(path)
            wrote = True
    return spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)


def op11_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items, k=20)


#: The same, by scoring every document for every item.
OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM.pattern}') AS t FROM documents
), d AS (
  SELECT r, doc_id, t, len(t) AS n FROM t WHERE len(t) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM.pattern}')) AS term FROM benchmark
  ) GROUP BY item_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total GROUP BY term, nd
), s AS (
  SELECT q.item_id, d.doc_id, d.r,
    CAST(sum(qtf * w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * d.n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY q.item_id, d.doc_id, d.r
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
