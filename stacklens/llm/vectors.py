"""Reading vectors into numpy blocks, and top-k lists that do not depend on how work is split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = False) -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows whose vector has finite components only; zero vectors if asked for."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)
    if not zero:
        ok = ok & F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & ok))


def finite(v: Column) -> Column:
    """Whether a vector is there, holds something, and holds finite components only."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def usual_length(rows: DataFrame, col: str = "v") -> int | None:
    """The most common length of the vectors (the longest on ties); None without rows."""
    found = rows.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if found is None else found["d"]


#: A key that more than one in so many rows have is joined by a broadcast; there are fewer such keys than this.
HOT = 1000


def join_back(rows: DataFrame, distinct: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``distinct``, which has one row and the number of ``rows`` for each key.

    Keys of many rows, of which there are fewer than HOT by their share, never meet in one task.
    """
    total = distinct.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    often = distinct.where(hot)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(distinct.where(~hot), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def packed(column: pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def salted(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
