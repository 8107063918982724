"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Share of the driver's heap from which finished plans are collected between steps.
FULL = 0.4

_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset, on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellforge-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def stored(df: DataFrame, after: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage is cut by a copy that outlives its executor: losing one costs tasks and not the job. What was shuffled for
    it is deleted with the end of the write, and so are the stored results ``after``, which nothing may read any more.
    The copy goes when the driver ends, if not before.
    """
    spark, schema = df.sparkSession, df.schema
    at = f"{shared_folder(spark).rstrip('/')}/cellforge-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    _filesystem(spark, at).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(at))
    for x in after:
        discard(x)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > FULL * runtime.maxMemory():
        spark._jvm.System.gc()  # plans of finished steps, in a driver of little memory that runs many
    trim(spark)
    out = spark.read.schema(schema).parquet(at)
    _PLACES[out] = at
    return out


def trim(spark: SparkSession) -> str | None:
    """Return to the system what the driver's compilers and codecs have freed, which the C library keeps for each thread.

    Takes milliseconds; what the virtual machine answers, or None where it has no such command.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    # by reflection on the public interface: the server's own class isn't exported
    kinds = new_array(jvm.java.lang.Class, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(kind)
    values = new_array(jvm.java.lang.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return None


def discard(df: DataFrame) -> None:
    """Delete the copy behind a stored result that nothing reads any more."""
    at = _PLACES.pop(df, None)
    if at is not None:
        _filesystem(df.sparkSession, at).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(at), True)


def _filesystem(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
