"""Session helpers: sensible local defaults, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "stacklens") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("STACKLENS_DRIVER_MEMORY", "8g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which a cluster must set to shared storage.

    Where the setting is absent (tests, one machine) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stacklens-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per Spark context, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_stacklens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "stacklens.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("stacklens", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._stacklens_shipped = True


#: Spark removes the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside leave no shuffle files; a query that needs some again makes them again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss. What was shuffled for it goes."""
    path = shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
