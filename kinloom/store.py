"""Tables cut from their lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode with the setting unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="kinloom-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinloom-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles are done with; else their files stay until the driver's heap fills."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more, and the shuffles that are done with."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/kinloom-" in folder.toString():
            folder.getFileSystem(conf).delete(folder, True)
    release(spark)
