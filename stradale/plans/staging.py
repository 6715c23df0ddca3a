"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a local one in local mode (tests), else an error:
    executors would write to their own disks, and later reads would miss the rows."""
    path = spark.conf.get(SETTING, None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stradale-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stradale-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame that reads it.

    Unlike a local checkpoint, the rows outlive any executor, and the plan that made them is not kept.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs: it acts once the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
