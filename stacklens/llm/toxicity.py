"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause from left to right. Insult and threat words open a match and
give it a weight; target words (persons addressed), negations and reported speech change what a match
counts as. Their composition is one small automaton whose state is (words left in which a negation holds,
words left in which a target holds, whether speech is reported); a match is emitted with the class its
state gives: plain, targeted, negated, reported, or threat. A clause ends at ``. ! ? ;`` or a line break,
so nothing reaches over it. A document's features are the log of one plus the summed weights by class.

Learned from labelled rows outside the held-out fold alone: which words and word beginnings (``abcd*``) are
insults with which weight, from a bounded sample of ``sample_rows`` labelled rows of either label, and what
each class counts, by logistic regression that a prior (``PRIOR``) holds where labels say little. A term
must pass a likelihood-ratio test (``min_evidence``), which asks for the same certainty at every size.

Defined results: null and empty texts get the score of a text without a match; without labels the fixed
seed words and the prior score alone; null or repeated ids keep their rows, one score each; of repeated
label rows the larger label counts; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklens.llm.common import texts

# Public everyday words of four languages.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "loser", "disgusting",
         "dummkopf", "abschaum", "imbécile", "connard", "imbécil", "estúpido", "basura")
THREATS = frozenset(("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "töte", "töten", "schlage", "umbringen",
                     "tuer", "frapper", "détruire", "matar", "golpear", "destruir"))
TARGETS = frozenset(("you", "your", "yours", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "dein", "ihr",
                     "euch", "tu", "toi", "te", "vous", "ton", "ta", "tú", "ti", "usted", "ustedes", "vosotros"))
NEGATIONS = frozenset(("not", "never", "no", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca"))
REPORTED = frozenset(("said", "says", "wrote", "quoted", "reported", "claimed", "sagte", "schrieb", "behauptete",
                      "dit", "écrit", "dijo", "escribió"))
CLASSES = ("plain", "targeted", "negated", "reported", "threat")
#: Bias, then what each class counts, before labels say more.
PRIOR = (-3.0, 2.0, 2.5, 0.5, 0.7, 2.5)
STEMS = (4, 5, 6)
NEGATION_REACH, TARGET_REACH = 3, 4
CLAUSE, WORD = re.compile(r"[.!?;\n]+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


class Grammar:
    """The composed automaton with a lexicon of insult words and beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.words = frozenset(w for w in weights if w[-1] != "*")
        self.stems = {n: frozenset(w[:-1] for w in weights if len(w) == n + 1 and w[-1] == "*") for n in STEMS}

    def insult(self, word: str) -> float:
        keys = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]
        return max(self.weights.get(k, 0.0) for k in keys)

    def marked(self, text: str) -> set[str]:
        """Words of a text that open a match."""
        words = set(WORD.findall(text.lower()))
        return (words & self.words) | (words & THREATS) | {w for n, s in self.stems.items() if s for w in words if w[:n] in s}

    def clause(self, words: list[str], marked: set[str], out: list[float]) -> None:
        negated = targeted = 0
        reported = False
        open_at: list[tuple[int, str, float]] = []  # matches that a later target can still change
        emitted: list[list] = []
        for i, w in enumerate(words):
            if w in NEGATIONS:
                negated = NEGATION_REACH + 1
            elif w in REPORTED:
                reported = True
            elif w in TARGETS:
                targeted = TARGET_REACH + 1
                for at, _, _ in open_at:
                    if i - at <= TARGET_REACH and emitted[-1][2] == at and emitted[-1][0] in ("plain", "aimless"):
                        emitted[-1][0] = "targeted" if emitted[-1][0] == "plain" else "threat"
            if w in marked:
                if w in THREATS and not (weight := self.insult(w)):
                    kind, weight = "threat" if targeted else "aimless", 3.0
                else:
                    weight = self.insult(w)
                    kind = "targeted" if targeted else "plain"
                if reported:
                    kind = "reported"
                if negated:
                    kind = "negated"
                emitted.append([kind, weight, i])
                open_at = [(i, kind, weight)]
            negated, targeted = max(0, negated - 1), max(0, targeted - 1)
        for kind, weight, _ in emitted:
            if kind != "aimless":  # a threat word that aims at nobody
                out[CLASSES.index(kind)] += weight

    def features(self, text: str) -> list[float]:
        out = [0.0] * len(CLASSES)
        if marked := self.marked(text):
            for part in CLAUSE.split(text.lower()):
                words = WORD.findall(part)
                if not marked.isdisjoint(words):
                    self.clause(words, marked, out)
        return [math.log1p(x) for x in out]


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(toxic, text) of at most ``sample_rows`` labelled rows of either label outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for t in (0, 1)]
    # at most 2 * sample_rows pairs of an id and a label
    return docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, min_evidence: float = 24.0,
          min_lift: float = 5.0, max_terms: int = 20_000) -> tuple[dict[str, float], list[float]]:
    """Insult weights by term, and what bias and classes count. The result's size is bounded by ``max_terms``."""
    sample = _sample(docs, labels, sample_rows)

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(_terms(text))
                seen[toxic][""] += 1
        terms = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([s[t] for t in part], pa.int64()) for s in seen)],
                                             ["term", "clean", "toxic"])

    counts = (sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3"))
    rows = counts.where("term != ''")
    totals = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    weights = {w: 3.0 for w in SEEDS}
    if clean and toxic:
        p = F.lit(toxic / (clean + toxic))
        q = F.col("toxic") / (F.col("clean") + F.col("toxic"))
        part = lambda k, a, b: F.when(F.col(k) > 0, F.col(k) * F.ln(a / b)).otherwise(0.0)
        evidence = 2 * (part("toxic", q, p) + part("clean", 1 - q, 1 - p))
        lift = ((F.col("toxic") + 0.5) / toxic) / ((F.col("clean") + 0.5) / clean)
        best = (rows.withColumn("evidence", evidence).withColumn("weight", F.ln(lift))
                .where((q > p) & (F.col("evidence") >= min_evidence) & (lift >= min_lift))
                .orderBy(F.desc("evidence"), "term").limit(max_terms).select("term", "weight").collect())
        weights |= {r["term"]: r["weight"] for r in best}
    grammar = Grammar(weights)

    def features(batches):
        for b in batches:
            x = np.array([grammar.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(CLASSES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(len(CLASSES)))], ["toxic", *CLASSES])

    schema = "toxic int, " + ", ".join(f"{c} double" for c in CLASSES)
    at = sample.mapInArrow(features, schema).groupBy(*("toxic", *CLASSES)).count().toPandas()  # bounded by the sample
    return weights, _fit(at)


def _fit(rows, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps, ridged towards PRIOR."""
    prior, theta = np.array(PRIOR), np.array(PRIOR)
    if not len(rows):
        return list(theta)
    x = np.column_stack([np.ones(len(rows)), rows[list(CLASSES)].to_numpy(float)])
    y, n = rows["toxic"].to_numpy(float), rows["count"].to_numpy(float)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * (theta - prior)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # more of a match never makes a text less toxic
    return [float(theta[0]), *(max(0.0, float(t)) for t in theta[1:])]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          taught_by: DataFrame | None = None, **options) -> DataFrame:
    """``row`` (all columns of the input as they are), ``score``, and the features by class.

    Labels belong to the documents of ``taught_by``, or else of ``docs``."""
    weights, theta = learn(texts(docs if taught_by is None else taught_by, id_col, text_col), labels, **options)
    grammar = Grammar(weights)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))

    def apply(batches):
        for b in batches:
            x = np.array([grammar.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(CLASSES))
            s = 1 / (1 + np.exp(-np.clip(theta[0] + x @ np.array(theta[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *(pa.array(x[:, k]) for k in range(len(CLASSES)))],
                                             ["row", "score", *CLASSES])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in CLASSES)])
    return rows.mapInArrow(apply, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    return score(docs, labels, **options).where(F.col("score") < threshold).select("row.*")


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(few, labels).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"), *CLASSES)
