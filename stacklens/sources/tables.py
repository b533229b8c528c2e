"""Readers and writers for the engine's tables. All plain Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklens.functions import scalars as S
from stacklens.operators import quality as Q
from stacklens.rules import fixed as R
from stacklens.session import materialize

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("operation", T.StringType()), T.StructField("agent", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("duration", T.DoubleType()),
    T.StructField("exception", T.StructType([T.StructField("type", T.StringType()),
                                             T.StructField("message", T.StringType())])),
    T.StructField("_corrupt_record", T.StringType())])


def read_repo_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Files of many repositories: a table of them, or a folder tree ``<owner>/<name>/<file>``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = F.concat(F.lit(r"\Q"), F.lit(path.rstrip("/") + "/"), F.lit(r"\E"))
    parts = F.split(F.element_at(F.split("path", root), -1), "/")
    return raw.select(F.concat_ws("/", parts[0], parts[1]).alias("repo_id"),
                      F.array_join(F.slice(parts, 3, F.size(parts)), "/").alias("path"),
                      F.col("length").alias("size"), F.col("content").cast("string").alias("content"),
                      F.col("modificationTime").alias("fetched_at"))


def with_content_hash(analyses: DataFrame) -> DataFrame:
    """Adds the 12-character content hash that names an analysis."""
    body = F.to_json(F.struct(*[c for c in sorted(analyses.columns) if c != "ts"]))
    return analyses.withColumn("commit_hash", F.substring(F.md5(body), 1, 12))


def write_analyses(analyses: DataFrame, path: str) -> None:
    with_content_hash(analyses).withColumn("day", F.to_date("ts")) \
        .write.mode("append").partitionBy("day").parquet(path)


def with_solution_id(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("solution_id", S.solution_id(F.col("strategy"), F.col("url")))


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append; ``current_outcomes`` gives the keep-latest view."""
    with_solution_id(outcomes).write.mode("append").partitionBy("success").parquet(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Stored outcomes; partition values come back as text, so the flag is cast."""
    return spark.read.parquet(path).withColumn("success", F.col("success").cast("boolean"))


def current_outcomes(outcomes: DataFrame) -> DataFrame:
    """Latest row per (repository, result, solution): a later outcome overwrites an earlier one."""
    key = ["repo_id", "success", "solution_id"]
    rest = [c for c in outcomes.columns if c not in key]
    return (outcomes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ts", "outcome_id")).alias("r"))
            .select(*key, "r.*"))


def append_training_records(records: DataFrame, path: str) -> None:
    records.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_training_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All records, or the newest ``limit`` (a top-k, not a full sort)."""
    df = spark.read.parquet(path)
    return df if limit is None else newest(df, limit)


def newest(df: DataFrame, limit: int, tie: str = "record_id") -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc(tie)).limit(limit)


def latest_feature_vectors(records: DataFrame) -> DataFrame:
    """Newest feature vector per repository with its number of features."""
    n = len(records.schema["repository_features"].dataType.names)
    at = F.struct("ts", "record_id")
    return records.groupBy("repo_id").agg(
        F.max_by("repository_features", at).alias("features"), F.max("ts").alias("ts")) \
        .withColumn("feature_count", F.lit(n).cast("bigint"))


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Snapshot: replaces the stored patterns."""
    patterns.withColumn("stored_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def read_patterns(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if strategy is None else df.where(F.col("pattern_id") == f"strategy_{strategy}_success")


def load_matrix(spark: SparkSession, kind: str) -> DataFrame:
    """A built-in compatibility matrix as a table: package, version, rule_ord, supported values."""
    data = {"cuda": R.STORED_CUDA_MATRIX, "python": R.STORED_PYTHON_MATRIX}
    if kind == "cuda_support":
        rows = [(p, v, i, c) for p, entries in R.CUDA_SUPPORT.items() for i, (v, c) in enumerate(entries)]
    else:
        rows = [(p, v, i, vals) for i, (p, v, vals) in enumerate(data[kind])]
    return spark.createDataFrame(rows, "package string, version string, rule_ord int, supported array<string>")


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path, for listing and deleting whole folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str, complete: bool) -> list[int]:
    fs, p = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = [n for n in names if n.startswith("version=")]
    if complete:
        found = [n for n in found if fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.partition("=")[2]) for n in found)


def update_matrix(matrix: DataFrame, path: str) -> int:
    """Store a matrix as a new version and return its number. Earlier versions stay: a reader keeps what it reads, and
    a write that breaks off leaves the latest complete version in place. Two writers of one number: the second fails.
    """
    version = max(_versions(matrix.sparkSession, path, complete=False), default=0) + 1
    matrix.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def read_matrix(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored matrix: the latest complete version, or the one asked for."""
    found = _versions(spark, path, complete=True)
    if not found or (version is not None and version not in found):
        raise ValueError(f"no such version of {path}: has {found}")
    return spark.read.parquet(f"{path}/version={version or found[-1]}")


def expire_stored(spark: SparkSession, path: str, cutoff: Column, part: str = "day") -> int:
    """Remove rows older than ``cutoff`` (by ``ts``) from a table partitioned by day; returns how many there were.

    Only partitions that hold such rows are touched. A partition that keeps some rows is written anew, from a copy in
    the shared folder and by dynamic partition overwrite, which swaps it in when the job commits; one that keeps none
    is deleted. Both may be repeated: a run that breaks off leaves each partition old or new, and the next ends it.
    """
    rows = spark.read.parquet(path)
    old = F.col("ts") < cutoff
    # later days cannot hold older rows: the bound on the partition column keeps them unread
    touched = rows.where(F.col(part) <= F.to_date(cutoff)).groupBy(part).agg(
        F.count_if(old).alias("old"), F.count("*").alias("n")).where("old > 0").collect()  # one row per day
    partly = [r[part] for r in touched if r["old"] < r["n"]]
    if partly:
        kept = materialize(rows.where(F.col(part).isin(partly) & ~F.coalesce(old, F.lit(False))))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for r in touched:
        if r["old"] == r["n"]:
            fs, p = _files(spark, f"{path}/{part}={r[part]}")
            fs.delete(p, True)
    return sum(r["old"] for r in touched)


def export_csv(df: DataFrame, path: str) -> None:
    """Nested records to flat CSV part files with a header."""
    Q.flatten(df).write.mode("overwrite").option("header", True).csv(path)


def storage_stats(analyses: DataFrame, outcomes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Counts of stored things as (name, value) rows."""
    row = lambda df, name, col: df.agg(col.cast("bigint").alias("value")).select(F.lit(name).alias("name"), "value")
    parts = [row(analyses, "total_repos", F.count_distinct("repo_id")), row(analyses, "total_analyses", F.count("*")),
             row(outcomes, "successful_solutions", F.count_if("success")),
             row(outcomes, "failed_solutions", F.count_if(~F.col("success"))),
             row(patterns, "patterns", F.count("*"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def learning_storage_stats(records: DataFrame, models: DataFrame, patterns: DataFrame) -> DataFrame:
    """Counts of the learning store as (name, value) rows: records, repositories with a vector, models, patterns."""
    row = lambda df, name, col: df.agg(col.cast("bigint").alias("value")).select(F.lit(name).alias("name"), "value")
    return (row(records, "training_records", F.count("*"))
            .unionByName(row(records, "feature_vectors", F.count_distinct(F.when(F.col("repository_features").isNotNull(), F.col("repo_id")))))
            .unionByName(row(models, "models", F.count_distinct("name"))).unionByName(row(patterns, "patterns", F.count("*"))))


def storage_size_mb(df: DataFrame) -> DataFrame:
    """Size of the files behind a file-based table."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.round(F.coalesce(F.sum("s"), F.lit(0)) / (1024 * 1024), 2).alias("storage_size_mb"),
                     F.count("*").alias("files"))


def read_json_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, one-row count of corrupt ones). Corrupt lines are counted, not fatal."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    good = parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, parsed.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt"))


def read_run_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines run logs, batch or stream, with a parsed time."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("ts", F.regexp_replace("timestamp", "Z$", "").try_cast("timestamp"))


def parse_gpu_inventory(df: DataFrame, line: str = "line") -> DataFrame:
    """Inventory CSV lines to name, memory in GB, driver and compute capability."""
    p = F.transform(F.split(F.col(line), ","), lambda x: F.trim(x))
    memory = F.regexp_replace(p[1], r" (MiB|MB)$", "").try_cast("double") / 1024
    return df.where(F.size(F.split(F.col(line), ",")) >= 3).select(
        *[c for c in df.columns if c != line], p[0].alias("name"), memory.alias("memory_gb"),
        p[2].alias("driver_version"), F.get(p, 3).alias("compute_capability"))
