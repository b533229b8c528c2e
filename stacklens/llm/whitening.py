"""Embedding whitening by weighted multiplicity covariance.

Equal vectors of integers x = floor(``scale`` * c) become one row with its count. The fit takes each distinct
x with a weight, its count or one: exact sums give the mean, a weighted product of centred matrices gives the
covariance (each task adds up its own rows and sends one matrix), and its eigenvectors are found on the driver,
as the matrix has a fixed size. Each distinct x is whitened once and joined back to its rows; x that more than
a thousandth of the rows share are joined by a broadcast, so no task holds all rows of a common vector.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those
of another length than the most common one (the longest on ties). Null ids, repeated rows and repeated ids keep
their rows. A component without variance (an eigenvalue not above 1e-12 of the trace) has a null ``whitened``
and takes no part in ``identity_error``; without any variance ``explained`` is null. ``deviation`` is null where
it does not fit into 64 bits. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklens.llm.common import materialize
from stacklens.llm.vectors import finite, join_back, matrix, usual_length

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Of the trace; a smaller eigenvalue counts as none.
NO_VARIANCE = 1e-12


def _centred_products(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of weight * (x - mean) (x - mean)' over the rows (x, weight) of ``fit``."""
    d = len(mean)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y = matrix(b.column(0)) - mean
                total += (y * b.column(1).to_numpy(zero_copy_only=False)[:, None]).T @ y
        at = np.arange(d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, d)), pa.array(np.tile(at, d)), pa.array(total.ravel())], ["i", "j", "s"])

    out = np.zeros((d, d))
    for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    most = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[most, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, weights: str = "count",
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row.

    ``weights``: "count" fits each distinct vector as often as it stands, "one" once. ``n`` is the sum of weights.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(finite(F.col("v")))
    d = usual_length(rows)
    if d is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    weight = {"count": F.col("c"), "one": F.lit(1).cast("long")}[weights]
    fit = materialize(rows.groupBy("x").agg(F.count("*").alias("c")).withColumn("weight", weight))
    sums = fit.agg(F.sum("weight").alias("n"), F.array(*(F.try_sum(F.try_multiply("weight", F.col("x")[i])) for i in range(d))).alias("s"),
                   F.array(*(F.sum(F.col("weight") * F.col("x")[i].cast("double")) for i in range(d))).alias("f")).first()
    n = sums["n"]
    mean = np.array([f / n if s is None else s / n for s, f in zip(sums["s"], sums["f"], strict=True)])
    covariance = _centred_products(fit.select("x", "weight"), mean) / n
    trace = float(np.trace(covariance))
    values, vectors_ = axes(covariance, components)
    some = values > NO_VARIANCE * trace
    k = len(values)

    def project(batches):
        for b in batches:
            w = (matrix(b.column(0)) - mean) @ vectors_ / np.sqrt(np.where(some, values, 1.0))
            out = pa.array([[x if s else None for x, s in zip(r, some.tolist(), strict=True)] for r in w.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], ["x", "c", "weight", "w"])

    total = F.array(*(F.lit(s) if s is not None else F.lit(None).cast("long") for s in sums["s"]))
    gap = lambda x, s: F.try_subtract(F.try_multiply(F.lit(n), x), s)
    deviation = F.aggregate(F.zip_with("x", total, gap), F.lit(0).cast("long"), lambda a, g: F.try_add(a, F.try_multiply(g, g)))
    white = materialize(fit.mapInArrow(project, "x array<bigint>, c bigint, weight bigint, w array<double>").withColumn("deviation", deviation))

    kept = [i for i in range(k) if some[i]]
    means = white.agg(F.lit(0.0), *(F.sum(F.col("weight") * F.col("w")[i]) / n for i in kept)).first()[1:]
    centred = {i: F.col("w")[i] - m for i, m in zip(kept, means, strict=True)}
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    products = white.agg(F.lit(0.0), *(F.sum(F.col("weight") * centred[i] * centred[j]) / n for i, j in pairs)).first()[1:]
    error = max((abs(p - (i == j)) for p, (i, j) in zip(products, pairs, strict=True)), default=0.0)

    explained = F.array(*(F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values))
    return (join_back(rows, white.select("x", "c", "w", "deviation"), "x", "c")
            .select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error")))


def op13_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors, components=4, scale=256, weights="one")
