"""Session helpers: the folder that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two rounds of ``tidy``, and when the last one was.
_EVERY, _tidied = 5.0, [float("-inf")]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder is set once on a single machine (tests), and on a cluster it is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="edgeatlas-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: computed once, its lineage gone, safe from lost executors.

    The shuffle files of the write go with its end: nothing reads them again.
    """
    spark, schema = df.sparkSession, df.schema
    path, before = scratch(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    tidy(spark)
    return spark.read.schema(schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Collect the garbage of the driver's Python and JVM, and give memory that the JVM no longer uses back to the system.

    Wide plans leave garbage that the JVM would rather grow for than collect, and compiled code leaves freed memory that the C library
    keeps. Spark lets go of the shuffles and broadcasts of plans that are collected. Does nothing within ``_EVERY`` seconds of the last time.
    """
    if time.monotonic() - _tidied[0] < _EVERY:
        return
    gc.collect()
    sc = spark.sparkContext
    java = sc._jvm.java.lang
    java.System.gc()
    with contextlib.suppress(Exception):  # JVMs before 17 and those beside Linux have no such command
        beans, args = java.management.ManagementFactory.getPlatformMBeanServer(), sc._gateway.new_array(java.Object, 4)
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke").invoke(beans, args)
    _tidied[0] = time.monotonic()


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` gave; whatever is planned on them must have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        found = [p for p in _made if p.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]
        for p in found:
            _made.remove(p)
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Delete what ``cut`` and ``scratch`` made in this process; results not yet written elsewhere are lost with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
