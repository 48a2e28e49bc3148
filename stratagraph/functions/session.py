"""Sessions, checkpoints and tables."""

from __future__ import annotations

import gc

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Of the heap that the driver may have, the share from which on a checkpoint asks it to hand unused heap back.
HEAP_SHARE = 0.5


def give_back(spark: SparkSession, share: float | None = None) -> None:
    """Collects the driver's garbage, which also shrinks its heap, once that is more than a share of the most it may be.

    Long jobs of many tasks let the heap grow to that most while little of it is live; beside
    it the driver holds as much again for classes, threads and compiled code. Memory that the JVM
    has freed outside of its heap is handed back too.
    """
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > (HEAP_SHARE if share is None else share) * runtime.maxMemory():
        gc.collect()  # frames that only Python still holds
        spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Hands the driver's freed native memory back to the system, which the C library else keeps; what the JVM says, or None where it can't."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds, args = array(jvm.Class, 4), array(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # Through the interface: the bean server's own class is not open to callers.
        return jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a copy in the shared checkpoint folder; a folder is set only where none is."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints")
    out = df.checkpoint()
    give_back(spark)
    return out


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with numbers from 0 in the order of a column: a range sort, then a count of each part."""
    rows = checkpoint(df.orderBy(by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a part
    out = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")
