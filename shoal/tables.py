"""Tables that cut lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

#: Has Spark delete a query's shuffles when it ends; else they stay until the driver collects what holds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  A cluster must
    name one; a session whose executors are the driver's own threads may leave it out."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_DIR
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``by`` names a column of few values, each of
    which gets files of its own.

    This cuts the lineage: a lost executor costs a reread of Parquet files and
    never a second pass over what made them.  The shuffles that made them are deleted as soon as
    the table is there.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.shoal_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, when nothing reads them any more, and let Spark's cleaner
    delete the shuffles that made them: it waits for the driver's garbage collection."""
    for t in tables:
        _delete(t.sparkSession, t.shoal_path)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of plans that nothing holds any more, and give the driver's free
    memory back.  Events of ended queries hold their plans until every listener has had them, so those go first."""
    gc.collect()
    with suppress(Py4JError):  # a bus that is late holds some shuffles longer, no more
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Have the driver's JVM return freed native memory (the compiler's, mostly) to the system, where it can; what it said."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    with suppress(Py4JError):
        # The server's own class is not open to calls from outside; its interface is.
        kinds = [jvm.java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        types, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            types[i] = kind
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables and archives that ``new_path`` named in this application, when no
    result is read any more.  Other applications' tables stay."""
    _delete(spark, session_dir(spark))
