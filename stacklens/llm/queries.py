"""The registered queries of this subpackage, each over its whole table, and their SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stacklens.llm import ann, bpe, chat, lexical, licenses, line_dedup, near_dedup, nn_descent, packing, pii, topk, toxicity, whitening
from stacklens.llm.common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda spark, sf_dir: toxicity.op1_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op2_line_dedup": _over("documents", line_dedup.op2_line_dedup),
    "op3_bpe": _over("documents", bpe.op3_bpe),
    "op4_ann": _over("embeddings", ann.op4_ann),
    "op5_topk": _over("embeddings", topk.op5_topk),
    "op6_near_dedup": _over("documents", near_dedup.op6_near_dedup),
    "op7_packing": _over("documents", packing.op7_packing),
    "op8_pii": _over("documents", pii.op8_pii),
    "op9_chat_formatting": _over("conversations", chat.op9_chat_formatting),
    "op10_license_scan": _over("documents", licenses.op10_license_scan),
    "op11_lexical": lambda spark, sf_dir: lexical.op11_lexical(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_near_vectors": _over("embeddings", nn_descent.op12_near_vectors),
    "op13_whitening": _over("embeddings", whitening.op13_whitening),
}
SQL: dict[str, str] = {
    "op5_topk": topk.OP5_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_near_vectors": nn_descent.OP12_SQL,
}
