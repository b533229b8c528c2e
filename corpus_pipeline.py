"""A training-data pipeline over documents.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's
docs. All stages but the last return the columns of documents; ``n_chars`` follows the text.

1. toxicity: documents that the grammar rejects go (labels and documents of ``sf_dir`` teach it).
2. line dedup: lines that an earlier line matches go; a document that loses all its lines goes with them.
3. near dedup: of each class of near duplicates the document of the smallest id stays.
4. pii: personal data and the terms that disclose them are replaced.
5. packing: the texts' tokens are packed into sequences; one row per piece.

Rows with null ids or texts, empty texts and repeated rows pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklens.llm import line_dedup, near_dedup, packing, pii, toxicity
from stacklens.llm.common import materialize, table, unused


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The rows with another text, its length, and the columns in their order."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), taught_by=table(spark, sf_dir, "documents"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (removed,) = unused(docs, "removed_lines")
    out = line_dedup.dedup_lines(docs)
    lost = F.col(removed).isNotNull() & ~F.col("text").rlike(near_dedup.HAS_WORD)
    return _with_text(out.where(~lost).select(*docs.columns), F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(pii.sanitise(docs), F.col("text")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
          ("pii", sanitise), ("packing", pack)]
#: Learning, alignment and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if k < len(STAGES) - 1 else docs
    return docs
