"""Exact top-k search by distributed histogram selection.

Everything is scored in blocks of candidates and queries. A pass counts, for each query, how many scores
fall into each of ``BINS`` equal bins of the query's current range; the counts of all blocks are added up,
and the bin that holds the k-th highest score is the next, narrower range. When a bin is one score wide,
that score is the k-th value. A last pass keeps what scores higher, and of what scores the same the smallest
ids. A block counts only its own k highest bins from above: scores below its own k-th cannot be the k-th.

Components are floor(256 * x) as integers, and sums are exact (doubles while they stay below 2**53, else
64-bit integers, which scores are taken to fit).

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor those
of another length than the most common one (the longest on ties), nor rows with a null id; rows that share
the query's id are its own; a query row that is repeated asks once, and an id with several vectors asks with each,
its answers ranked together; repeated rows of another id count each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.llm.common import materialize
from stacklens.llm.vectors import salted, usable

BINS = 512
BLOCK, QUERY_BLOCK = 4096, 4096


def _ints(table: pa.Table) -> np.ndarray:
    col = table["v"].combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _scored(q: pa.Table, x: pa.Table, size: int = 256):
    """Query row, its scores, and the candidates' ids without its own."""
    if q.num_rows and x.num_rows:
        a, b, qid, ids = _ints(q), _ints(x), q["query_id"].to_numpy(), x["vec_id"].to_numpy()
        for at in range(0, len(a), size):
            for i, row in enumerate(scores(a[at:at + size], b), at):
                own = ids != qid[i]
                yield i, row[own], ids[own]


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest scores; ``is_query`` takes the id column."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, zero=True)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == sizes["d"]).select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # each vector of each id that asks has a number of its own, fixed by writing it
    queries = materialize(rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v", norm.alias("norm"))
                          .dropDuplicates(["query_id", "v"]).withColumn("q", F.monotonically_increasing_id()))
    longest, n_queries = rows.agg(F.max(norm)).first()[0], queries.count()
    blocks, q_blocks = max(1, math.ceil(sizes["count"] / BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    right = (rows.withColumn("block", salted(F.col("vec_id"), blocks))
             .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def meet(state: DataFrame, work, schema: str) -> DataFrame:
        left = (state.withColumn("q_block", salted(F.col("query_id"), q_blocks))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
        return left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(work, schema)

    def count(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows:
            qid, low, width, span = (q[c].to_numpy() for c in ("q", "low", "width", "span"))
            for i, s, _ in _scored(q, x):
                inside = (s >= low[i]) & (s < low[i] + span[i])
                n = np.bincount((s[inside] - low[i]) // width[i], minlength=BINS)[::-1]
                used = np.flatnonzero(n)
                used = used[: int(np.searchsorted(np.cumsum(n[used]), k)) + 1]
                out += [(int(qid[i]), BINS - 1 - int(j), int(n[j])) for j in used]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("q", "bin", "n"), cols, strict=True)})

    # the range of the first pass holds every score a query can have
    reach = F.ceil(F.col("norm") * longest + 1).cast("long")
    state = materialize(queries.select("q", "query_id", "v", (-reach).alias("low"), F.lit(k).cast("long").alias("need"),
                                       (F.floor(2 * reach / BINS) + 1).cast("long").alias("width"))
                        .withColumn("span", F.col("width") * BINS))
    width = (state.agg(F.max("width")).first()[0] or 1) if n_queries else 0
    done = False
    while n_queries and not done:
        counts = meet(state, count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        above = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumn("total", above)
        at = (found.join(state.select("q", "need"), "q").where(F.col("total") >= F.col("need"))
              .groupBy("q").agg(F.max_by(F.struct("bin", (F.col("total") - F.col("n")).alias("over")), "bin").alias("b")))
        # a query with fewer candidates than k keeps its lowest bound
        low = F.when(F.col("b").isNull(), F.col("low")).otherwise(F.col("low") + F.col("b")["bin"] * F.col("width"))
        need = F.when(F.col("b").isNull(), F.col("need")).otherwise(F.col("need") - F.col("b")["over"])
        state = materialize(state.join(at, "q", "left").select(
            "q", "query_id", "v", low.alias("low"), need.alias("need"),
            F.when(F.col("width") > 1, F.floor((F.col("width") - 1) / BINS) + 1).otherwise(1).cast("long").alias("width"),
            F.col("width").alias("span")))
        done, width = width == 1, (width - 1) // BINS + 1

    def keep(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows:
            qid, low = q["query_id"].to_numpy(), q["low"].to_numpy()
            for i, s, ids in _scored(q, x):
                for v, z in ((ids[s > low[i]], s[s > low[i]]), (np.sort(ids[s == low[i]])[:k], None)):
                    out += [(int(qid[i]), int(a), int(low[i] if z is None else z[j])) for j, a in enumerate(v)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (meet(state, keep, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_topk(vectors: DataFrame) -> DataFrame:
    return search(vectors, lambda i: i % 50 == 0)


#: The same, by scoring all pairs of a query and a row.
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
