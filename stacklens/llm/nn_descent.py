"""Near-duplicate vectors by NN-descent.

Entries are the distinct vectors with their counts. Start: ``TREES`` times, entries are dealt to leaves by the
signs of projections (directions and cuts near the middle come from a bounded sample, the leaves hold every entry, and a
leaf above ``LEAF`` is split by a hash); each entry lists its ``k`` best of its leaves. Refinement: an entry's
neighbours and those that list it meet each other, if one of them is new, and better ones enter the lists,
until few lists that still have room gain a link. An entry that very many list is split into groups of ``REVERSE``, and its own neighbours
meet each, so no group grows. These steps use unit vectors in half precision, whose error is below ``SLACK``.

Links are the list entries whose cosine, in double precision on the original vectors, reaches the threshold.
A list is saturated when all it holds may be links. Then there may be more of them, so it is enlarged to its
whole component: the members of a component with a saturated list are cut into cells by their angle to one of
them (linked vectors lie in the same or neighbouring cells), cells into blocks of ``BLOCK``, and blocks are
multiplied; only each member's number of links leaves a block, never its pairs.

Audit: a sample of ``AUDIT`` entries (bounded) is compared with every entry. While less than ``recall`` of its
links are found, further leaves are dealt and refined, ``TRIES`` times at most; the last measure is returned
as ``audit_recall`` (1 where the sample has no links).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do those of another length than the most common one (the longest on ties); they keep their row. Repeated
rows, and rows that repeat an id, are vectors of their own and count as links of each other. Null ids name no
component unless all ids in it are null; ``kept`` compares null-safe. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize
from stacklens.llm.near_dedup import components
from stacklens.llm.vectors import finite, join_back, matrix, usual_length

TREES, LEAF, REVERSE, BLOCK = 3, 256, 16, 2048
SAMPLE, AUDIT, TRIES, ROUNDS = 8192, 2048, 4, 8
#: Of the links in lists with room; when a round brings fewer new ones, refinement ends.
FEW_CHANGES = 0.005
#: Above what half precision can change in the product of two unit vectors (2**-10).
SLACK = 0.002


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the magnitude of their numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _halves(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, d).astype(np.float32)


def _table(u, v, s) -> dict:
    return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float32())}


def best_pairs(ids: np.ndarray, s: np.ndarray, k: int):
    """(u, v, s) of each row's k highest products above -1; pairs that may not be taken are -2."""
    if s.shape[1] > k:
        s = np.where(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1:k], s, -2)
    a, b = np.nonzero(s > -2)
    return ids[a], ids[b], s[a, b]


def _k_best(pairs: DataFrame, k: int) -> DataFrame:
    """u, v, s, fresh: each u's k best of the pairs; what stood before isn't fresh."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return (pairs.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
            .withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at"))


def _leaves(nodes: DataFrame, x: np.ndarray, n: int, d: int, k: int, seed: int) -> DataFrame:
    """Pairs of entries that share a leaf; ``x`` is the sample."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    rng = np.random.default_rng(seed)
    ends = rng.integers(0, len(x), (2, TREES * bits))
    directions = (x[ends[0]] - x[ends[1]]).T.astype(np.float32) if bits else np.zeros((d, 0), np.float32)
    # off the median, and each elsewhere: else all trees cut data of few dimensions at one place, and nothing links across it
    along = x.astype(np.float32) @ directions
    middle = np.array([np.quantile(along[:, j], q) for j, q in enumerate(rng.uniform(0.3, 0.7, TREES * bits))])

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            side = (_halves(b.column(1), d) @ directions > middle).reshape(b.num_rows, TREES, bits)
            code = (side.astype(np.int64) << np.arange(bits)).sum(axis=2)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, t, np.int32)), pa.array(code[:, t])],
                                                 ["e", "f", "tree", "code"])

    dealt = materialize(nodes.select("e", "f").mapInArrow(deal, "e long, f binary, tree int, code long"))
    size = dealt.groupBy("tree", "code").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("e", "tree", F.lit(seed)), F.col("blocks"))

    def meet(t: pa.Table) -> pa.Table:
        ids, f = t["e"].to_numpy(), _halves(t["f"].combine_chunks(), d)
        s = f @ f.T
        np.fill_diagonal(s, -2)
        return pa.table(_table(*best_pairs(ids, s, k)))

    return (dealt.join(size, ["tree", "code"]).withColumn("block", block).select("tree", "code", "block", "e", "f")
            .groupBy("tree", "code", "block").applyInArrow(meet, "u long, v long, s float"))


def _neighbours_of_neighbours(nodes: DataFrame, graph: DataFrame, d: int, k: int) -> DataFrame:
    """Pairs of entries that share a neighbour, at least one of them new, and that better one of the two's lists."""
    listed_by = graph.groupBy("v").agg(F.ceil(F.count("*") / REVERSE).cast("int").alias("groups")).withColumnRenamed("v", "w")
    own = (graph.select(F.col("u").alias("w"), F.col("v").alias("m"), "fresh").join(listed_by, "w", "left")
           .withColumn("g", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))))
    back = (graph.select(F.col("v").alias("w"), F.col("u").alias("m"), "fresh").join(listed_by, "w")
            .withColumn("g", F.pmod(F.hash("m"), F.col("groups"))))
    groups = (own.select("w", "g", "m", "fresh").unionByName(back.select("w", "g", "m", "fresh"))
              .groupBy("w", "g").agg(F.collect_list(F.struct("m", "fresh")).alias("members"))
              .where(F.exists("members", lambda x: x["fresh"]) & (F.size("members") > 1))
              .select("w", "g", F.inline("members")))
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-1.5).cast("float").alias("worst"))
    known = nodes.select(F.col("e").alias("m"), "f").join(worst.withColumnRenamed("u", "m"), "m", "left")
    groups = (groups.groupBy("w", "g", "m").agg(F.max("fresh").alias("fresh")).join(known, "m").groupBy("w", "g")
              .agg(F.collect_list(F.struct("m", "fresh", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"), "f")).alias("members")))

    def meet(batches):
        for b in batches:
            lists = b.column(0)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(int)
            flat = lists.flatten()
            ids, fresh, worst_, f = (flat.field(i) for i in range(4))
            ids, fresh, worst_ = ids.to_numpy(), fresh.to_numpy(zero_copy_only=False), worst_.to_numpy()
            f, out = _halves(f, d), []
            for i, j in zip(at[:-1], at[1:], strict=True):
                s = f[i:j] @ f[i:j].T
                new = fresh[i:j]
                s[~(new[:, None] | new[None, :]) | (s <= worst_[i:j, None])] = -2
                np.fill_diagonal(s, -2)
                out.append(best_pairs(ids[i:j], s, k))
            if out:
                yield pa.RecordBatch.from_pydict(_table(*(np.concatenate(c) for c in zip(*out, strict=True))))

    return groups.select("members").mapInArrow(meet, "u long, v long, s float")


def _refined(nodes: DataFrame, graph: DataFrame, d: int, k: int, threshold: float) -> DataFrame:
    for _ in range(ROUNDS):
        better = _neighbours_of_neighbours(nodes, graph, d, k).withColumn("fresh", F.lit(True))
        graph = materialize(_k_best(graph.withColumn("fresh", F.lit(False)).unionByName(better), k))
        link = F.col("s") >= threshold - SLACK
        lists = graph.groupBy("u").agg(F.count_if(link).alias("links"), F.count_if(link & F.col("fresh")).alias("new"))
        change = lists.where(F.col("links") < k).agg(F.sum("links").alias("links"), F.sum("new").alias("new")).first()
        if (change["new"] or 0) <= FEW_CHANGES * (change["links"] or 0):
            break
    return graph


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (unit(a) * unit(b)).sum(axis=1)


def _links(entries: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) of the listed pairs that reach the threshold in double precision."""
    near = graph.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = (near.join(entries.select(F.col("e").alias("a"), F.col("v").alias("x")), "a")
            .join(entries.select(F.col("e").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y"))

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(_cosines(matrix(batch.column(2)), matrix(batch.column(3))) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    return materialize(both.mapInArrow(check, "a long, b long"))


def _dense_counts(members: DataFrame, threshold: float) -> DataFrame:
    """e, links of the members (e, c, v, label) of some components: all that they link with in their component."""
    angle = math.acos(threshold) * (1 + 1e-6)
    pivot = members.groupBy("label").agg(F.min_by("v", "e").alias("p"))

    def turn(batches):
        for b in batches:
            if b.num_rows:
                a = np.arccos(np.clip(_cosines(matrix(b.column(2)), matrix(b.column(4))), -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((a / angle).astype(np.int32))], ["e", "c", "v", "label", "cell"])

    members = materialize(members.join(pivot, "label").select("e", "c", "v", "label", "p")
                          .mapInArrow(turn, "e long, c long, v array<double>, label long, cell int"))
    sizes = members.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.hash("e"), F.col("blocks"))).drop("blocks")
    other = sizes.select("label", F.col("cell").alias("to"), "blocks")
    meets = (placed.withColumn("to", F.explode(F.array(*(F.col("cell") + i for i in (-1, 0, 1))))).join(other, ["label", "to"])
             .withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    left = meets.select("label", "cell", "block", "to", "to_block", "e", "v")
    right = meets.select(*(F.col(a).alias(b) for a, b in zip(
        ("label", "to", "to_block", "cell", "block", "e", "c", "v"), ("label_", "cell_", "block_", "to_", "to_block_", "e_", "c_", "v_"), strict=True)))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        out = np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            near = unit(matrix(a["v"].combine_chunks())) @ unit(matrix(b["v_"].combine_chunks())).T >= threshold
            near &= a["e"].to_numpy()[:, None] != b["e_"].to_numpy()[None, :]
            out = near @ b["c_"].to_numpy()
        return pa.table({"e": a["e"], "links": pa.array(out, pa.int64())})

    key = ["label", "cell", "block", "to", "to_block"]
    met = left.groupBy(*key).cogroup(right.groupBy(*(f"{x}_" for x in key)))
    return met.applyInArrow(count, "e long, links long").groupBy("e").agg(F.sum("links").alias("links"))


def _linked(entries: DataFrame, graph: DataFrame, threshold: float, k: int) -> DataFrame:
    """e, links, label of the entries that link with others; links count the rows of the other entries."""
    found = _links(entries, graph, threshold)
    labels = materialize(components(found, "a", "b").select(F.col("node").alias("e"), "label"))
    full = (graph.where(F.col("s") >= threshold - SLACK).groupBy("u").count().where(F.col("count") >= k)
            .select(F.col("u").alias("e")).join(labels, "e").select("label").distinct())
    dense = labels.join(full, "label", "left_semi")
    sparse = labels.join(full, "label", "left_anti")
    ways = found.select(F.col("a").alias("e"), F.col("b").alias("o")).unionByName(found.select(F.col("b").alias("e"), F.col("a").alias("o")))
    few = (ways.join(sparse.select("e"), "e", "left_semi").join(entries.select(F.col("e").alias("o"), "c"), "o")
           .groupBy("e").agg(F.sum("c").alias("links")))
    many = _dense_counts(dense.join(entries.select("e", "c", "v"), "e").select("e", "c", "v", "label"), threshold)
    return materialize(few.unionByName(many).join(labels, "e"))


def _audit(entries: DataFrame, linked: DataFrame, threshold: float) -> float:
    """The found part of the links that a sample of entries has with all rows."""
    asked = (entries.orderBy(F.xxhash64("e", F.lit("audit"))).limit(AUDIT).select("e", "v")
             .join(linked.select("e", "links"), "e", "left")
             .select("e", "v", F.coalesce("links", F.lit(0)).alias("links")).toArrow())
    ids, x = asked["e"].to_numpy(), unit(matrix(asked["v"].combine_chunks()))

    def count(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                s = (unit(matrix(b.column(2))) @ x.T >= threshold) & (b.column(0).to_numpy()[:, None] != ids[None, :])
                total += int(b.column(1).to_numpy() @ s.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    true = entries.select("e", "c", "v").mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    return float(asked["links"].to_numpy().sum() / true) if true else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 8, recall: float = 0.99,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    some = F.coalesce(finite(F.col("v")) & F.exists("v", lambda c: c != 0), F.lit(False))
    d = usual_length(rows.where(some))
    unlinked = [F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if d is None:
        return rows.select(*unlinked, F.lit(1.0).alias("audit_recall"))
    takes_part = some & (F.size("v") == F.lit(d))
    entries = materialize(rows.where(takes_part).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("c"))
                          .withColumn("e", F.monotonically_increasing_id()))  # fixed by writing it

    def halve(batches):
        for b in batches:
            if b.num_rows:
                f = unit(matrix(b.column(1))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in f], pa.binary())], ["e", "f"])

    nodes = materialize(entries.select("e", "v").mapInArrow(halve, "e long, f binary"))
    n = nodes.count()
    sample = _halves(nodes.orderBy(F.xxhash64("e")).limit(SAMPLE).select("f").toArrow()["f"].combine_chunks(), d)
    graph, measured = None, 0.0
    for turn in range(TRIES):
        pairs = _leaves(nodes, sample, n, d, k, turn).withColumn("fresh", F.lit(True))
        pairs = pairs if graph is None else graph.withColumn("fresh", F.lit(False)).unionByName(pairs)
        graph = _refined(nodes, materialize(_k_best(pairs, k)), d, k, threshold)
        linked = _linked(entries, graph, threshold, k)
        measured = _audit(entries, linked, threshold)
        if measured >= recall:
            break
    first = linked.join(entries.select("e", "id"), "e").groupBy("label").agg(F.min("id").alias("component"))
    known = (entries.join(linked.join(first, "label"), "e", "left")
             .select("v", "c", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    joined = join_back(rows.where(takes_part), known, "v", "c").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.unionByName(rows.where(~takes_part).select(*unlinked)).withColumn("audit_recall", F.lit(measured))


def op12_near_vectors(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors, threshold=0.95)


#: The same by all pairs and the closure of their links. The search is approximate; where the audit finds all, it gives this.
OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT vec_id, row_number() OVER () AS r, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS (
  SELECT vec_id, r, v, sqrt(list_inner_product(v, v)) AS norm FROM t WHERE ok
), link AS (
  SELECT a.r AS a, b.r AS b, b.vec_id FROM u a JOIN u b ON a.r <> b.r AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(t.vec_id) AS id FROM reach JOIN t ON t.r = reach.b GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.id, vec_id)) AS component_id,
  vec_id <= coalesce(least.id, vec_id) AS kept, CAST(1 AS DOUBLE) AS audit_recall
FROM t LEFT JOIN n ON n.a = r LEFT JOIN least ON least.a = r
"""
