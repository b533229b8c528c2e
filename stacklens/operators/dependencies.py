"""Dependencies: from manifest text to one row per (repo, package)."""

from __future__ import annotations

import ast
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklens.functions import scalars as S
from stacklens.functions import text as X
from stacklens.rules import fixed as R

# Position of a file kind in a repository's dependency order.
SOURCE_RANK = {"requirements": 0, "setup": 1, "pyproject": 2, "imports": 3}
# The body of a list up to its closing bracket; brackets within quoted strings, such as extras, do not close it.
LIST_BODY = r"""((?:[^\]"'#]|"[^"]*+"|'[^']*+'|#[^\n]*+)*+)\]"""


def _order(kind: str, path, pos):
    """Place of an entry among all of its repository: kind of file, path, position. One value that sorts."""
    return F.struct(F.lit(SOURCE_RANK[kind]).alias("rank"), path.alias("path"), pos.cast("int").alias("pos")).alias("ord")


def _rows(files: DataFrame, specs, kind: str, source) -> DataFrame:
    """Explode an array of requirement structs into dependency rows in file order."""
    base = files.select("repo_id", "path", F.posexplode(specs).alias("pos", "spec"))
    return (base.where(F.col("spec").isNotNull())
            .select("repo_id", _order(kind, F.col("path"), F.col("pos")),
                    F.col("spec.name").alias("name"), F.col("spec.version").alias("version"),
                    F.col("spec.op").alias("op"), F.lit("python").alias("dep_type"),
                    source(F.col("pos"), F.col("path")).alias("source"),
                    S.flag_gpu(F.col("spec.name"), "imports" if kind == "imports" else
                               "requirements").alias("gpu_required")))


def parse_requirements(files: DataFrame) -> DataFrame:
    """Requirement files to dependency rows; the source carries the 1-based line number.

    Lines are exploded and filtered before any pattern runs, so that the patterns are plain
    generated code on one short line each.
    """
    line = files.select("repo_id", "path", F.posexplode(X.lines(F.col("content"))).alias("pos", "raw")) \
        .select("repo_id", "path", "pos", X.strip(F.col("raw")).alias("line")) \
        .where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-r "))
    body = line.select("repo_id", "path", "pos", X.strip(F.substring_index("line", "#", 1)).alias("body")) \
        .where(F.col("body").rlike(X.REQUIREMENT))
    name, op, version = X.requirement_parts(F.col("body"))
    return body.select(
        "repo_id", _order("requirements", F.col("path"), F.col("pos")),
        name.alias("name"), version.alias("version"), op.alias("op"), F.lit("python").alias("dep_type"),
        F.concat(F.lit("requirements.txt:L"), (F.col("pos") + 1).cast("string")).alias("source"),
        S.flag_gpu(name).alias("gpu_required"))


def parse_setup_py(files: DataFrame, mode: str = "native") -> DataFrame:
    """Strings in the ``install_requires`` / ``requires`` lists of a setup file."""
    blocks = X.extract_all(F.col("content"), r"\b(?:install_requires|requires)\s*=\s*\[" + LIST_BODY, 1)
    strings = F.flatten(F.transform(blocks, lambda b: X.extract_all(b, X.QUOTED, 1)))
    specs, source = F.transform(strings, X.requirement), lambda pos, path: F.lit("setup.py")
    if mode == "exact":
        return _exact(files, _setup_items, "setup", source, specs)
    return _rows(files, specs, "setup", source)


def parse_pyproject(files: DataFrame, mode: str = "native") -> DataFrame:
    """``project.dependencies`` and the poetry table of a pyproject file."""
    content = F.col("content")
    listed = lambda text: F.transform(F.flatten(F.transform(
        X.extract_all(text, r"(?m)^dependencies\s*=\s*\[" + LIST_BODY, 1),
        lambda b: X.extract_all(b, X.QUOTED, 1))), X.requirement)
    # only the project table's list counts, where the text has tables at all
    project = F.when(content.rlike(r"(?m)^\[[^\[\]\n]+\]\s*(?:#.*)?$"),
                     F.regexp_extract(content, r"(?ms)^\[project\][^\n]*$(.*?)(?=^\[[^\[\]\n]+\]\s*(?:#[^\n]*)?$|^\[\[|\z)", 1)).otherwise(content)
    table = F.concat(content, F.lit("\n["))
    section = F.regexp_extract(table, r"(?s)\[tool\.poetry\.dependencies\](.*?)\n\[", 1)
    entry = r"""^([A-Za-z0-9_.-]+)\s*=\s*(?:["']([^"']*)["']|\{.*?version\s*=\s*["']([^"']*)["'].*)"""
    def poetry(raw):
        name = F.regexp_extract(raw, r"^([A-Za-z0-9_.-]+)\s*=", 1)
        version = F.coalesce(F.nullif(F.regexp_extract(raw, entry, 2), F.lit("")),
                             F.nullif(F.regexp_extract(raw, entry, 3), F.lit("")))
        return F.when((name != "") & (name != "python"), F.struct(
            name.alias("name"), F.lit(None).cast("string").alias("op"), version.alias("version")))
    specs = lambda text: F.concat(listed(text), F.transform(X.lines(section), poetry))
    source = lambda pos, path: F.lit("pyproject.toml")
    if mode == "exact":
        # of a file that does not parse, only entries with a version are taken
        return _exact(files, _pyproject_items, "pyproject", source, F.filter(specs(content), lambda s: s["version"].isNotNull()))
    return _rows(files, specs(project), "pyproject", source)


def scan_imports(files: DataFrame, mode: str = "native") -> DataFrame:
    """Top-level modules a source file imports, one row per (file, package)."""
    mapped = S.string_map(R.IMPORT_MAP)
    source = lambda pos, path: F.concat(F.lit("imports:"), path)
    if mode == "exact":
        return _exact(files, _import_items, "imports", source, F.array().cast(_SPEC))
    content = F.col("content")
    plain = F.flatten(F.transform(X.extract_all(content, r"(?m)^[ \t]*import[ \t]+([^#;\n]+)", 1),
                                  lambda m: F.split(m, ",")))
    heads = F.concat(plain, X.extract_all(content, r"(?m)^[ \t]*from[ \t]+\.*([A-Za-z_][\w.]*)[ \t]+import\b", 1))
    tops = F.array_distinct(F.transform(heads, lambda h: F.regexp_extract(h, r"^\s*([A-Za-z_]\w*)", 1)))
    names = F.transform(tops, lambda t: F.coalesce(mapped[t], t))
    keep = F.array_sort(F.filter(names, lambda n: (n != "") & ~n.isin(R.IMPORT_SKIP)))
    specs = F.transform(keep, lambda n: F.struct(
        n.alias("name"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("string").alias("version")))
    return _rows(files, specs, "imports", source)


# -- exact modes: the language's own parsers inside Arrow batches; the patterns where a file does not parse
_SPEC = "array<struct<name:string,op:string,version:string>>"


def _exact(files: DataFrame, read, kind: str, source, native) -> DataFrame:
    """``read`` gives a file's requirements as (text, or name and version) items, or raises on a broken file."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            specs = []
            for content in pdf["content"]:
                try:
                    specs.append([_spec(x) for x in read(content or "")])
                except (SyntaxError, ValueError, AttributeError, TypeError):
                    specs.append(None)
            yield pdf.assign(specs=specs)

    id_type = files.schema["repo_id"].dataType.simpleString()
    parsed = files.select("repo_id", "path", "content").mapInPandas(
        parse, f"repo_id {id_type}, path string, content string, specs {_SPEC}")
    return _rows(parsed, F.coalesce("specs", native), kind, source)


def _spec(item):
    if isinstance(item, tuple):
        return {"name": item[0], "op": None, "version": item[1]}
    m = re.match(X.REQUIREMENT, item.partition("#")[0].strip())
    return m and {"name": m[1].lower(), "op": m[2], "version": m[3]}


def _setup_items(content: str) -> Iterator[str]:
    """PEP 508 strings of the keyword lists of a ``setup`` call."""
    for node in ast.walk(ast.parse(content)):
        match node:
            case ast.Call(func=ast.Name(id="setup"), keywords=keywords):
                for k in keywords:
                    match k:
                        case ast.keyword(arg="install_requires" | "requires", value=ast.List(elts=items)):
                            yield from (e.value for e in items if isinstance(e, ast.Constant) and isinstance(e.value, str))


def _pyproject_items(content: str) -> Iterator[str | tuple[str, str | None]]:
    """PEP 621 strings, then the poetry table's entries, whose value is a version or a table that may hold one."""
    data = tomllib.loads(content)
    yield from data.get("project", {}).get("dependencies", [])
    for name, value in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            entry = {"version": value} if isinstance(value, str) else value if isinstance(value, dict) else {}
            yield name, entry.get("version")


def _import_items(content: str) -> list[tuple[str, None]]:
    """Packages of the top-level names that a file imports, by name."""
    tops: set[str] = set()
    for node in ast.walk(ast.parse(content)):
        match node:
            case ast.Import(names=names):
                tops.update(a.name.partition(".")[0] for a in names)
            case ast.ImportFrom(module=str(module)):
                tops.add(module.partition(".")[0])
    return [(n, None) for n in sorted({R.IMPORT_MAP.get(t, t) for t in tops}.difference(R.IMPORT_SKIP))]


# -- relations over dependency rows -----------------------------------------------------------
def union_sources(*parsed: DataFrame) -> DataFrame:
    """All parsed sources in one relation; ``ord`` ranks kinds of files, then their paths, then places in them."""
    out = parsed[0]
    for p in parsed[1:]:
        out = out.unionByName(p)
    return out


def dedup_dependencies(deps: DataFrame) -> DataFrame:
    """One row per (repo, lower-case name), replacing in order of appearance (``ord``, of any type that sorts).

    A later row replaces the kept one if it brings a version the kept one lacks, or a GPU flag the
    kept one lacks. So a row replaces if it has either, no earlier row had both, and the last earlier
    row with either was of another kind; the last row that replaces (or the first row) is kept. Rows
    are read, shuffled and sorted once, and the windows only look back or to the next row that
    replaces, so a package of any number of rows is held by no one.
    """
    cols = [c for c in deps.columns if c != "repo_id"]
    v, g = S.has_version(F.col("version")), F.coalesce("gpu_required", F.lit(False))
    # kinds: 0 nothing, 1 version only, 2 GPU only, 3 both
    kind = F.when(v, 1).otherwise(0) + F.when(g, 2).otherwise(0)
    order = Window.partitionBy("repo_id", "dep_key").orderBy("ord")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = (deps.withColumn("dep_key", F.lower("name")).withColumn("kind", kind)
              .withColumns({"place": F.row_number().over(order), "most": F.max("kind").over(earlier),
                            "before": F.last(F.nullif("kind", F.lit(0)), ignorenulls=True).over(earlier),
                            "first_ord": F.first("ord").over(order.rowsBetween(Window.unboundedPreceding, 0))}))
    replaces = (F.col("kind") > 0) & (F.col("most") < 3) & (F.coalesce("before", F.lit(0)) != F.col("kind"))
    kept = marked.where((F.col("place") == 1) | replaces).withColumn("next", F.lead("place").over(order))
    return kept.where(F.col("next").isNull()).select("repo_id", *cols, "first_ord")


def inconsistent_versions(deps: DataFrame) -> DataFrame:
    """Packages a repository names with more than one version (rows before de-duplication)."""
    return (deps.where(S.has_version(F.col("version")))
            .select("repo_id", F.lower("name").alias("name"), "version").distinct()
            .groupBy("repo_id", "name")
            .agg(F.array_sort(F.collect_list("version")).alias("versions"))
            .where(F.size("versions") > 1))


def python_dependencies(deps: DataFrame) -> DataFrame:
    return deps.where(F.col("dep_type") == "python")
