"""Extraction expressions over file and log text (native columns; whole texts, never prefixes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacklens.functions.scalars import contains_any
from stacklens.rules import fixed as R

# one pattern for "name", and "name op version"
REQUIREMENT = r"^([a-zA-Z0-9_-]+)\s*(?:([><=!~]+)\s*([0-9.]+.*?))?$"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
QUOTED = r"""["']([^"']+)["']"""
JSON_OBJECT = r"(?s)\{(?:[^{}]|(?:\{[^{}]*\}))*\}"


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def requirement_parts(line: Column) -> tuple[Column, Column, Column]:
    """(name, op, version) of a requirement line without its comment; the name is empty if the
    line is not a requirement."""
    part = lambda g: F.regexp_extract(line, REQUIREMENT, g)
    return F.lower(part(1)), F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit(""))


def requirement(line: Column) -> Column:
    """struct(name, op, version) of one requirement line; null if the line is not one."""
    name, op, version = requirement_parts(strip(F.substring_index(line, "#", 1)))
    return F.when(name != "", F.struct(name.alias("name"), op.alias("op"), version.alias("version")))


def first_match(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """Captured group of the first pattern, in list order, that occurs in the text."""
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, g)) for p, g in patterns]
    return F.coalesce(*found)


def concat_matches(text: Column, patterns: list[str], group: int) -> Column:
    return F.flatten(F.array(*[extract_all(text, p, group) for p in patterns]))


def readme_findings(content: Column) -> Column:
    low = F.lower(content)
    gpu = F.lit(False)
    for p in R.README_GPU_PATTERNS:
        gpu = gpu | low.rlike(p)
    return F.struct(
        first_match(low, R.README_PYTHON_PATTERNS).alias("python_version"),
        contains_any(low, R.README_CUDA_WORDS).alias("cuda_mentioned"),
        gpu.alias("gpu_required"),
        concat_matches(low, R.README_INSTALL_PATTERNS, 0).alias("installation_commands"),
        concat_matches(low, R.README_REQUIREMENT_PATTERNS, 1).alias("system_requirements"))


def base_images(dockerfile: Column) -> Column:
    return extract_all(dockerfile, r"(?im)^FROM\s+([^\s]+)", 1)


def _unquote(v: Column) -> Column:
    return F.regexp_replace(strip(v), r"""^["']+|["']+$""", "")


def workflow_python_versions(content: Column, compat: bool = False) -> Column:
    """Python versions of a workflow file. ``compat`` keeps the literal one-character capture."""
    quoted = r"""python-version:\s*["']([^"'])+["']""" if compat else \
        r"""python-version:\s*["']([^"']+)["']"""
    pats = [r"python-version:\s*\[([^\]]+)\]", quoted, r"python:\s*\[([^\]]+)\]"]
    return F.transform(F.flatten(F.transform(concat_matches(content, pats, 1),
                                             lambda m: F.split(m, ","))), _unquote)


def workflow_test_commands(content: Column) -> Column:
    return concat_matches(content, R.CI_TEST_PATTERNS, 1)


def travis_python_versions(content: Column) -> Column:
    blocks = extract_all(content, r"python:\s*\n((?:\s*-\s*[^\n]+\n?)+)", 1)
    items = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"-\s*([^\n]+)"), 1)))
    return F.transform(items, _unquote)


def last_json_object(text: Column) -> Column:
    """Last valid JSON object with ``"valid": true``, else the last valid one, else null."""
    valid = F.filter(extract_all(text, JSON_OBJECT, 0),
                     lambda c: F.try_parse_json(c).isNotNull())
    flagged = F.filter(valid, lambda c: F.get_json_object(c, "$.valid") == "true")
    pick = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    return F.coalesce(pick(flagged), pick(valid))


def strip_thinking(text: Column) -> Column:
    """Text that follows a thinking block, by the first pattern that finds any; an opening tag
    that is left over cuts the rest."""
    def tail(p: str) -> Column:
        t = strip(F.try_element_at(extract_all(text, p, 1), F.lit(-1)))
        return F.when(t != "", t)

    body = F.coalesce(*[tail(p) for p in R.THINKING_PATTERNS], text)
    return strip(F.regexp_replace(body, r"(?is)<think(?:ing)?>.*", ""))


def response_answer(text: Column) -> Column:
    """JSON answer of a model response if there is one, else its text without thinking."""
    return F.coalesce(last_json_object(text), strip_thinking(text))
