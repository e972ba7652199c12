"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else set on the context; one of our own only in local mode, where driver and
    executors are one process. A cluster without one is refused, as its machines would each write to their own disk."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not (sc.master.startswith("local") and "cluster" not in sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="lexloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def shared_table(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors, has a known size."""
    path = f"{shared_dir(spark).rstrip('/')}/lexloom-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table stands for its shuffles, which need no more disk
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexloom_path = path
    return out


#: Bytes of a table that is read by fewer tasks than there are cores, as it has few row groups, but is worth all of them.
SPREAD = (1 << 20, 64 << 20)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores; larger ones, which have as many splits as they need, as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if SPREAD[0] <= size < SPREAD[1] else df


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for whatever store the path is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes shared tables that nothing reads any more."""
    for t in tables:
        fs, at = filesystem(t.sparkSession, t.lexloom_path)
        fs.delete(at, True)
