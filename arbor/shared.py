"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files are deleted at the end of the query that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary folder is taken if driver and tasks are one
    process on one machine (tests, a laptop); on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_arbor_shared_dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = spark._arbor_shared_dir = "file://" + tempfile.mkdtemp(prefix="arbor-")
    return found.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what will be at ``path`` when the driver's JVM ends; lost executors don't matter."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


#: Rows that a task gets of a table that is dealt out, and the most parts, up to which no task holds rows to write them.
ROWS, PARTS = 500_000, 200


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt out by ``keys``: parts as many as its rows need, not as few as their compressed size allows."""
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 20_000))  # few rows: what keeps all cores busy
    return df.repartition(max(1, min(PARTS, max(least, -(-rows // ROWS)))), *keys)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting, never by broadcasting it: a stored table's files are much smaller than its rows in memory."""
    return df.hint("merge")


def stored(df: DataFrame, name: str, by: list[str] | None = None, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder, in folders for the columns ``by``, and read it back: lineage ends there.

    The files outlive lost executors; they are deleted when the driver's JVM ends. The shuffle
    files of the plan that made them are deleted as soon as they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arbor/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any longer."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
