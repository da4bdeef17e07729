"""The folder that driver and executors share, and tables that are written there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """This application's folder, as a URI, in spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends.

    Where the setting is missing, a local master (tests) gets a temporary folder; a cluster is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="larkspur-")
        fs, path = file_system(spark, f"{base.rstrip('/')}/larkspur-{app}")
        path = fs.makeQualified(path)
        fs.deleteOnExit(path)
        _roots[app] = path.toString()
    return _roots[app]


def fresh(spark: SparkSession, tag: str) -> str:
    """A URI under the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later stages don't depend on any executor's disk."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def shrink_heaps(spark: SparkSession) -> None:
    """Have each executor collect its garbage, after which its JVM returns the free part of its heap to the system.

    A heap that one step has grown otherwise stays as large beside the Python workers of the next one, and steps of one session add up.
    A task for each executor and one more: idle executors get one each at least; a busy one that gets none only keeps its heap.
    Nothing that is still referenced goes, and results do not depend on it.
    """
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()  # counts the driver
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def discard(spark: SparkSession, *used: str | DataFrame) -> None:
    """Remove folders, or what durable() wrote, when nothing that is still to run reads them."""
    for x in used:
        fs, path = file_system(spark, x if isinstance(x, str) else x._larkspur_path)
        fs.delete(path, True)
