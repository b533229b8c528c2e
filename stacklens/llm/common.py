"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklens.session import materialize, shared_dir, ship

__all__ = ["materialize", "shared_dir", "table", "texts", "unused"]

#: A character that none of the patterns used here can match; it marks places in a text.
MARK = "\u0001"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of every row; other columns, whatever their names, go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unmarked(text: Column) -> Column:
    """The text with MARK replaced by another character outside every pattern, so that places stay."""
    return F.translate(text, MARK, "\u0002")
