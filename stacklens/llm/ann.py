"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: link each sampled vector to its ``graph_k`` best by inner product, cut that graph
into balanced parts of few cut links (recursive bisection: split at the median of the main direction, then
swap the pairs of nodes that gain most), and train a small network to tell from a vector how its own and
its neighbours' parts are distributed. Index: every distinct vector goes to its most probable part. Search:
a query visits its most probable parts until they hold ``mass`` of the probability (which is what the
network learned of where neighbours are, so clustered data need few parts and data without structure many),
and every vector there is scored on the original values.

Skew: equal vectors are one index entry with its k + 1 smallest different ids, each as often as it stands but
k times at most, which is exact, since no query can return more of them; a large part is split into blocks by a hash of the vector, and so are the queries.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part, nor
those of another length than the most common one (the longest on ties), nor rows with a null id; rows that
share the query's id are its own; repeated rows of another id count each; a query row that is repeated counts
once, and an id with several vectors asks with each, its answers ranked together; an empty table gives an empty
result; further columns are ignored. A query whose parts hold too few rows visits more of them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize
from stacklens.llm.vectors import matrix, salted, usable

#: Rows of an index block and of a query block that meet in one group.
INDEX_BLOCK, QUERY_BLOCK = 4096, 4096
RESULT = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of each row's k best other rows by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each row: balanced recursive bisection of the neighbour graph, ``parts`` a power of two."""
    label = np.zeros(len(x), np.int64)
    heads, tails = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for level in range(int(math.log2(parts))):
        new = label * 2
        for p in range(2 ** level):
            own = np.flatnonzero(label == p)
            if len(own) < 2:
                continue
            y = x[own] - x[own].mean(0)
            direction = np.ones(y.shape[1])
            for _ in range(20):
                direction = y.T @ (y @ direction)
                direction /= np.linalg.norm(direction) or 1.0
            order = np.argsort(y @ direction, kind="stable")
            side = np.zeros(len(own), np.int64)
            side[order[len(own) // 2:]] = 1
            where = np.full(len(x), -1)
            where[own] = np.arange(len(own))
            inside = (where[heads] >= 0) & (where[tails] >= 0)
            a, b = where[heads[inside]], where[tails[inside]]
            for _ in range(rounds):
                cut = np.where(side[a] != side[b], 1.0, -1.0)
                gain = np.bincount(a, cut, len(own)) + np.bincount(b, cut, len(own))
                zero, one = (np.flatnonzero(side == s) for s in (0, 1))
                zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
                n = min(len(zero), len(one))
                swap = np.flatnonzero(gain[zero[:n]] + gain[one[:n]] > 0)
                if not len(swap):
                    break
                swap = swap[:max(1, len(swap) // 2)]
                side[zero[swap]], side[one[swap]] = 1, 0
            new[own] += side
        label = new
    return label


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 150, seed: int = 7) -> dict[str, np.ndarray]:
    """A network of one hidden layer for the distribution over parts."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt((x ** 2).mean()) or 1.0
    z = x / scale
    w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / math.sqrt(hidden), (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, steps + 1):
        h = np.maximum(z @ w[0] + w[1], 0)
        logits = h @ w[2] + w[3]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) / len(z)
        dh = (d @ w[2].T) * (h > 0)
        grads = [z.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]
        for i, g in enumerate(grads):
            g = g + (1e-4 * w[i] if w[i].ndim == 2 else 0)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return {"scale": np.array(scale), "w0": w[0], "b0": w[1], "w1": w[2], "b1": w[3]}


def route(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x / model["scale"] @ model["w0"] + model["b0"], 0) @ model["w1"] + model["b1"]


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int):
    """Each query's k best of the entries, as (query row, id, score): found by a product of matrices, then
    scored by the same sum of products whatever the block, so equal vectors have equal scores."""
    norms = np.sqrt((x ** 2).sum(1))
    alone = Counter(e[0] for e in ids if e[0] == e[-1])
    for at in range(0, len(q), 256):
        s = q[at:at + 256] @ x.T
        for i, row in enumerate(s, at):
            n = min(k + alone[qid[i]], len(row))  # entries that hold the query's own id only give no answer
            kth = np.partition(row, len(row) - n)[len(row) - n]
            slack = 1e-9 * float(norms.max()) * float(np.sqrt((q[i] ** 2).sum()))
            near = np.flatnonzero(row >= kth - slack)
            score = (x[near] * q[i]).sum(1)
            found = sorted((-sc, v) for sc, e in zip(score.tolist(), near.tolist(), strict=True) for v in ids[e] if v != qid[i])
            yield from ((int(qid[i]), v, -sc) for sc, v in found[:k])


def search(vectors: DataFrame, is_query, k: int = 20, sample_rows: int = 8192, graph_k: int = 20,
           parts: int = 64, mass: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` takes the id column; the sample is the first by a hash."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    first = Window.partitionBy("v").orderBy("vec_id")
    often = F.transform("ids", lambda i: F.array_repeat(i["vec_id"], F.least(i["c"], F.lit(k)).cast("int")))
    index = materialize(rows.groupBy("v", "vec_id").agg(F.count("*").alias("c"))
                        .withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
                        .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "c"))).alias("ids"))
                        .withColumn("ids", F.flatten(often))
                        .withColumn("h", F.xxhash64("v")))
    sample = index.orderBy("h").limit(sample_rows).select("v").toArrow()
    x = matrix(sample.column(0).combine_chunks())
    while parts > max(1, len(x) // 8):
        parts //= 2
    if len(x) > 1 and parts > 1:
        graph = neighbour_graph(x, graph_k)
        label = balanced_parts(x, graph, parts)
        target = (np.eye(parts)[label] + np.eye(parts)[label[graph]].sum(1)) / (1 + graph.shape[1])
        model = train_router(x, target)
    else:
        model = {"scale": np.array(1.0), "w0": np.zeros((x.shape[1], 1)), "b0": np.zeros(1), "w1": np.zeros((1, 1)), "b1": np.zeros(1)}

    def assign(batches):
        for b in batches:
            if b.num_rows:
                part = route(model, matrix(b.column(0))).argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["v", "ids", "part"])

    placed = materialize(index.select("v", "ids").mapInArrow(assign, "v array<double>, ids array<long>, part int"))
    held = {r["part"]: (r["e"], r["n"]) for r in placed.groupBy("part").agg(
        F.count("*").alias("e"), F.sum(F.size(F.array_distinct("ids"))).alias("n")).collect()}
    room = np.array([held.get(p, (0, 0))[1] for p in range(parts)])
    queries = (rows.where(is_query(F.col("vec_id"))).select("vec_id", "v").dropDuplicates(["vec_id", "v"])
               .withColumn("own", F.count("*").over(Window.partitionBy("vec_id"))))
    n_queries = queries.count()

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p = route(model, matrix(b.column(1)))
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")
            before = lambda x: np.cumsum(x, axis=1) - x
            take = (before(np.take_along_axis(p, order, 1)) < mass) | (before(room[order]) < k + b.column(2).to_numpy()[:, None])
            lists = [o[t].tolist() for o, t in zip(order, take, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

    blocks = max(1, math.ceil(max([e for e, _ in held.values()], default=1) / INDEX_BLOCK))
    q_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    left = (queries.select("vec_id", "v", "own").mapInArrow(probe, "vec_id long, v array<double>, parts array<int>")
            .withColumn("q_block", salted(F.col("vec_id"), q_blocks))
            .select("vec_id", "v", "q_block", F.explode("parts").alias("part"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (placed.withColumn("block", salted(F.col("v"), blocks))
             .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def meet(q: pa.Table, e: pa.Table) -> pa.Table:
        out: list = []
        if q.num_rows and e.num_rows:
            out = list(best(matrix(q["v"].combine_chunks()), q["vec_id"].to_numpy(), matrix(e["v"].combine_chunks()),
                            e["ids"].to_pylist(), k))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    keys = ("part", "block", "q_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_ann(vectors: DataFrame) -> DataFrame:
    return search(vectors, lambda i: i % 20 == 0)
