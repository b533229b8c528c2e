"""Version-string expressions. All are native column expressions; nothing here is a UDF."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public version grammar (fixed value), simplified to what decides "parses" / "does not parse".
VERSION_GRAMMAR = (
    r"(?i)^\s*v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*"
    r"(?:[-_.]?(?:a|b|c|rc|alpha|beta|pre|preview)[-_.]?[0-9]*)?"
    r"(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?"
    r"(?:[-_.]?dev[-_.]?[0-9]*)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"
)
RELEASE_ONLY = r"(?i)^\s*v?[0-9]+(?:\.[0-9]+)*\s*$"


def clean_version(v: Column) -> Column:
    """Drop leading operators, then everything from the next operator or comma on."""
    head = F.regexp_replace(v, r"^[><=~^!]+", "")
    return F.trim(F.regexp_replace(head, r"[,<>=~^!].*$", ""))


def version_parts(v: Column) -> Column:
    """Integer parts; null when any part is not an integer."""
    parts = F.transform(F.split(v, r"\."), lambda p: F.trim(p).try_cast("bigint"))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def _padded(parts: Column, other: Column) -> Column:
    missing = F.greatest(F.size(other) - F.size(parts), F.lit(0))
    return F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), missing))


def compare_versions(a: Column, b: Column) -> Column:
    """-1 / 0 / 1 over zero-padded parts; text that is not a version compares as equal."""
    pa, pb = version_parts(a), version_parts(b)
    xa, xb = _padded(pa, pb), _padded(pb, pa)
    return (F.when(pa.isNull() | pb.isNull(), 0).when(xa < xb, -1).when(xa > xb, 1)
            .otherwise(0))


def major_minor(v: Column) -> Column:
    return F.substring_index(v, ".", 2)


def version_number(v: Column) -> Column:
    """First ``major.minor`` as a number ("3.10" is 3.1); 0.0 when there is none."""
    return F.coalesce(F.regexp_extract(v, r"(\d+)\.(\d+)", 0).try_cast("double"), F.lit(0.0))


def normalize_version(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"^[vV]", ""), r"[._-]+", ".")


def version_digits(v: Column) -> Column:
    """Release parts joined into one number: 2.10.0 is 2100. Null unless a plain release."""
    bare = F.regexp_replace(F.trim(v), r"(?i)^v", "")
    parts = F.transform(F.split(bare, r"\."), lambda p: p.try_cast("bigint").cast("string"))
    return F.when(v.rlike(RELEASE_ONLY), F.array_join(parts, "").try_cast("double"))


def _weighted(parts: Column, other: Column) -> Column:
    """Sum of part differences weighted by 100^(2 - position)."""
    gaps = F.zip_with(_padded(parts, other), _padded(other, parts),
                      lambda x, y: F.abs(x - y).cast("double"))
    weighted = F.transform(gaps, lambda d, i: d * F.pow(F.lit(100.0), F.lit(2.0) - i))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def weighted_distance(a: Column, b: Column) -> Column:
    """Position-weighted distance; null if either version has a part that is not an integer."""
    pa, pb = version_parts(a), version_parts(b)
    return F.when(pa.isNotNull() & pb.isNotNull(), _weighted(pa, pb))


def digits_distance(a: Column, b: Column) -> Column:
    return F.abs(version_digits(a) - version_digits(b))


def version_tables(tables: dict[str, list[dict]]) -> Column:
    """Rule tables as one literal: map of package to entries. The optimizer folds it to a constant."""
    rows = {package: [{"rule_ord": i, "parts": [int(p) for p in e["version"].split(".")],
                       "digits": float(e["version"].replace(".", "")), "entry": e}
                      for i, e in enumerate(entries)] for package, entries in tables.items()}
    first = next(iter(tables.values()))[0]
    fields = ",".join(f"{k}:{'array<string>' if isinstance(v, list) else 'string'}"
                      for k, v in first.items())
    return F.from_json(F.lit(json.dumps(rows)), "map<string,array<struct<rule_ord:int,"
                       f"parts:array<bigint>,digits:double,entry:struct<{fields}>>>>")


def closest(v: Column, entries: Column, metric: str) -> Column:
    """The entry whose version is closest to ``v``; the first in table order wins a tie.

    ``entries`` is one value of ``version_tables``. The search is local to the row: no join
    fan-out, no shuffle. Null when the metric gives no match or the package has no table. With
    ``digits``, text that does not parse as a version takes the first entry.
    """
    if metric == "weighted":
        target, dist = version_parts(v), lambda t, c: _weighted(t, c["parts"])
    elif metric == "digits":
        target, dist = version_digits(v), lambda t, c: F.abs(t - c["digits"])
    else:
        raise ValueError(f"unknown metric {metric!r}; use 'digits' or 'weighted'")

    def nearest(t: Column) -> Column:
        return F.array_min(F.transform(entries, lambda c: F.struct(
            dist(t, c).alias("distance"), c["rule_ord"].alias("rule_ord"))))

    # one-element array: the target is parsed once per row, not once per table entry
    best = F.get(F.transform(F.array(target), nearest), 0)
    hit = F.when(target.isNotNull(), F.get(entries, best["rule_ord"])["entry"])
    if metric == "weighted":
        return hit
    return F.when(v.isNotNull() & ~v.rlike(VERSION_GRAMMAR), F.get(entries, 0)["entry"]).otherwise(hit)
