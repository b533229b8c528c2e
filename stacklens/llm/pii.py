"""Personal data by patterns and by what terms disclose, with DataFrame functions only.

Base kinds (email, ip, card, phone) are found by patterns, leftmost and non-overlapping per kind. Then
corpus co-occurrence says how strongly a term reveals a protected entity, that is a base match's value:
a term t discloses an entity c when pmi(c; t) >= alpha * ic(c), with ic(c) = -log2 p(c) and
pmi(c; t) = log2 p(c, t) / (p(c) p(t)), and at least ``min_joint`` contexts hold both. At alpha = 1 a
term must occur only beside the entity. Terms are words with a letter and at least ``min_chars``
characters within ``window`` words of a match; each occurrence is a span of kind ``term``, also in texts
that do not hold the entity, since there it is what reveals it. Copies of a text repeat the same words beside the same entity and prove nothing
about a term, so contexts are different words of the window, and all four probabilities count the same units:
texts without a base match once per digest, texts with one once per set of (entity, words of the window), so
that copies, and near copies that differ outside the windows, are one unit everywhere. A window has its words
however long they are and however many signs stand between them.

Sanitising replaces base spans by ``[EMAIL]`` and so on and terms by ``[TERM]``.

How places are found without a scan per match: each match is put between marks, the text is split at the
marks, and lengths of the parts are summed. Places are code points, ends exclusive. Patterns are
possessive wherever that changes no match, so that long runs stay linear.

Defined results: null and empty texts hold nothing; a null or repeated id keeps its row, one result each;
empty tables give empty results; further columns of the input are ignored. A text may hold the mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.llm.common import MARK, materialize, texts, unmarked, unused

KINDS = ("email", "ip", "card", "phone")
#: The given patterns; possessive, and starting only where a run starts or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this cannot hold the kind; cheap to try.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    twice = lambda x: F.when(x > 9, x - 9).otherwise(x)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        (n - i) % 2 == 1, twice(F.substr(digits, i, F.lit(1)).cast("int") * 2)).otherwise(
        F.substr(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        # a part may have any number of leading zeros
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _places(parts: Column, kind: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of the valid ones among every second part of a marked text."""
    empty = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), empty.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        keep = acc["inside"] & valid(part)
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"),
                        F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; ``text`` must hold no mark."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(HINTS[kind]), _places(parts, kind, lambda m: _valid(kind, m))).otherwise(F.array().cast(SPAN))


def _base(text: Column) -> Column:
    """The base spans of a text."""
    clear = unmarked(text)
    return F.concat(*(_spans(clear, k) for k in KINDS))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``base``: spans (kind, start, end, value) of each row."""
    return texts(docs, id_col, text_col).withColumn("base", _base(F.col("text")))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed (terms last), then end."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), k)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"),
                                                  s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                               s["end"].alias("end"), s["value"].alias("value")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


WORD_ENDS = r"[\s\p{Punct}]+"
#: Characters beside a match that are read for its window, one size after the other until the window is full or the
#: text ends; the last is more than any text has.
REACHES = tuple(64 << 3 * k for k in range(9))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_ENDS), lambda w: w != "")


#: Up to so many terms are sent to every task; more are joined by a shuffle.
SENT_TERMS = 200_000


def _with_words(rows: DataFrame, terms: DataFrame, min_chars: int) -> DataFrame:
    """copy, unit, term: the words of each text that are among ``terms``, once each."""
    words = F.filter(F.array_distinct(_words(F.col("text"))), lambda w: F.char_length(w) >= min_chars)
    small = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    return rows.select("copy", "unit", F.explode(words).alias("term")).join(F.broadcast(terms) if small else terms, "term")


def _beside(text: Column, at: Column, before: bool, window: int) -> Column:
    """The ``window`` words nearest to a place of a text on one side, the nearest first.

    A reach may cut the word at its far edge, so that word counts only where the reach ends with the text.
    """
    at = at.cast("int")
    far = at if before else F.char_length(text) - at
    start = F.struct(F.lit(False).alias("full"), F.array().cast("array<string>").alias("words"))

    def read(reach: Column) -> Column:
        piece = F.substr(text, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, reach)) if before else F.substr(text, at + 1, reach)
        return F.reverse(_words(piece)) if before else _words(piece)

    def step(acc: Column, reach: Column) -> Column:
        found = F.transform(F.array(read(reach)), lambda w: F.struct(
            ((reach >= far) | (F.size(w) > window)).alias("full"), F.slice(w, 1, window).alias("words")))[0]
        return F.when(acc["full"], acc).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, REACHES)), start, step, lambda a: a["words"])


def _contexts(window: int) -> Column:
    """(entity, around) of each base span of a row: its value and the words of its window."""
    text = F.col("text")
    around = lambda s: F.concat(_beside(text, s["start"], True, window), _beside(text, s["end"], False, window))
    return F.array_sort(F.array_distinct(F.transform("base", lambda s: F.struct(s["value"].alias("entity"), around(s).alias("around")))))


def with_units(spans: DataFrame, window: int = 5) -> DataFrame:
    """The rows of ``base_spans`` with ``copy`` (a digest of the text), ``near`` (their contexts) and ``unit``."""
    rows = spans.withColumn("copy", F.unhex(F.md5("text"))).withColumn("near", _contexts(window))
    return rows.withColumn("unit", F.when(F.size("near") > 0, F.unhex(F.md5(F.to_json(F.struct("near"))))).otherwise(F.col("copy")))


def disclosing_terms(rows: DataFrame, alpha: float = 0.95, min_joint: int = 3, min_chars: int = 4) -> DataFrame:
    """Texts with the terms they hold that disclose any entity (copy, term); ``rows``: see ``with_units``.

    At least as many units hold a term as have it in a window of any entity. Windows are counted first, so a common
    word is dropped by its windows and never meets the texts; what is left is counted in them exactly.
    """
    units = materialize(rows.select("unit", "near").distinct())
    near = units.select("unit", F.explode("near").alias("c")).select("unit", "c.entity", "c.around")
    in_any = units.select("unit", F.explode(F.array_distinct(F.flatten(F.col("near.around")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    joint = materialize(near.select("unit", "entity", "around", F.explode(F.array_distinct("around")).alias("term"))
                        .where((F.char_length("term") >= min_chars) & F.col("term").rlike(r"\p{L}"))
                        .groupBy("entity", "term").agg(F.count_distinct("around").alias("contexts"), F.count_distinct("unit").alias("joint"))
                        .where(F.col("contexts") >= min_joint))
    if joint.isEmpty():
        return rows.select("copy", F.lit("").alias("term")).limit(0)
    n = float(units.count())
    entities = near.groupBy("entity").agg(F.count_distinct("unit").alias("n_entity"))
    share = F.lit(n) / F.col("n_entity")
    # pmi >= alpha * ic says that no more than ``most`` units hold the term; a little room for rounding
    most = F.col("joint") * F.pow(share, F.lit(1 - alpha)) * (1 + 1e-9)
    pairs = materialize(joint.join(entities, "entity").where(share > 1).join(in_any, "term").where(F.col("n_near") <= most)
                        .select("entity", "term", "joint", "n_entity"))
    held = materialize(_with_words(rows, pairs.select("term").distinct(), min_chars).select("copy", "unit", "term").distinct())
    terms = held.groupBy("term").agg(F.count_distinct("unit").alias("n_term"))
    ic = F.log2(share)
    pmi = F.log2(F.col("joint") * n / (F.col("n_entity") * F.col("n_term")))
    told = pairs.join(terms, "term").where((ic > 0) & (pmi >= alpha * ic)).select("term").distinct()
    return held.select("copy", "term").distinct().join(told, "term").select("copy", "term")


def _marked_terms(text: Column, terms: Column) -> Column:
    """Spans of the terms, which hold no punctuation and so stand for themselves in a pattern."""
    any_of = F.concat(F.lit(r"(?iu)(?<![^\s\p{Punct}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![^\s\p{Punct}])"))
    parts = F.split(F.regexp_replace(text, any_of, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    return _places(parts, "term", lambda part: F.lit(True))


def _terms_of_texts(spans: DataFrame, window: int, **options) -> DataFrame:
    """copy, ``terms``: the terms that a text holds and that disclose an entity, of the rows of ``base_spans``.

    Written, so that its size decides whether the texts are shuffled to meet it.
    """
    found = disclosing_terms(with_units(spans, window), **options)
    return materialize(found.groupBy("copy").agg(F.sort_array(F.collect_set("term")).alias("terms")))


def _with_terms(text: Column, base: Column, terms: Column) -> Column:
    """The base spans of a text and those of its terms that overlap none of them, ordered."""
    outside = F.filter(_marked_terms(unmarked(text), terms), lambda t: ~F.exists(
        base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return _ordered(F.when(terms.isNull(), base).otherwise(F.concat(base, outside)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, **options) -> DataFrame:
    """doc_id, text, ``base`` and ``spans`` (all, ordered) of each row."""
    rows = base_spans(docs, id_col, text_col)
    joined = rows.withColumn("copy", F.unhex(F.md5("text"))).join(_terms_of_texts(rows, window, **options), "copy", "left")
    return joined.select("doc_id", "text", _ordered(F.col("base")).alias("base"),
                         _with_terms(F.col("text"), F.col("base"), F.col("terms")).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans become one, named by the first of them."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        piece = F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substr(text, a["at"].cast("int") + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` with their texts sanitised; texts without a span stay as they are, nulls too.

    Each row meets its terms once, by a digest of its text, and is rewritten where it stands.
    """
    terms_of = _terms_of_texts(base_spans(docs, id_col, text_col), window, **options)
    copy, terms, base, spans = unused(docs, "copy", "terms", "base", "spans")
    text = F.col(text_col)
    rows = docs.withColumn(copy, F.unhex(F.md5(text))).join(
        terms_of.select(F.col("copy").alias(copy), F.col("terms").alias(terms)), copy, "left").withColumn(base, _base(text))
    return (rows.withColumn(spans, _with_terms(text, F.col(base), F.col(terms)))
            .withColumn(text_col, F.when(text.isNotNull(), sanitised(text, F.col(spans)))).select(*docs.columns))


def op8_pii(docs: DataFrame) -> DataFrame:
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
