"""Tables kept between jobs in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import gc
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without it (tests, notebooks) gets a folder of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="packwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def released(spark: SparkSession) -> None:
    """Lets go of plans that nobody holds, and so of their shuffle files and broadcasts, and returns freed memory.

    Spark frees those when the driver's collector meets them, which a driver with little garbage may not do for half an
    hour; jobs that plan many shuffles in a row call this between their steps. What compilers and codecs of the driver
    have freed outside the heap stays with the C library, a few hundred MB after such jobs, until it is told to return it;
    a JVM that can't tell it so leaves it there.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows, computed once and kept as a table in the folder all executors share; options go to the Parquet writer.

    It lies under spark.checkpoint.dir, so lost executors cost nothing that was done before; the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/packwright/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to at least four tasks a core, for work that costs far more than reading its rows.

    A table is read by as many tasks as its files and row groups make; a million short rows may be one. Rows are dealt in
    turn, so no key can fill a task.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
