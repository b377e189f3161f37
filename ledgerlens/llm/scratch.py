"""Shared-folder tables that cut lineage, and small session helpers.

An intermediate result that several jobs read, or that an iteration replaces,
is written as Parquet below the folder the session names in
``spark.checkpoint.dir``.  All executors and the driver see that folder, so a
lost executor costs a retry of its tasks and nothing else.  Where the setting is
missing (unit tests in local mode) a folder of the driver is used.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 200_000
#: Of the driver's largest heap: beyond this share its garbage is collected when a table has been written.
SWOLLEN = 0.4
#: Of kept tables: bytes of a row group, which a task holds as it writes and as it reads.  Rows can be blocks of 1 MB, so sizes are looked at from the first row on.
WRITTEN = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
#: Rows that a task reads from Parquet at once; texts can be long.
READ_ROWS = 256
_kept: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"{tempfile.gettempdir()}/ledgerlens-scratch"
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the scratch folder and return it as read from there.  rows, if known, bounds its rows: a small table gets few files."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_PER_FILE))
    df.write.options(**WRITTEN).parquet(path)
    _kept.append(path)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > SWOLLEN * runtime.maxMemory():
        collect_own_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def kept() -> list[str]:
    """The paths that keep() has written and release() has not deleted."""
    return list(_kept)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what keep() has written, or of that the given paths; results that still read it must have been stored before."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _kept[::-1] if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        _kept.remove(name)
        with contextlib.suppress(Exception):
            path.getFileSystem(hadoop).delete(path, True)


def tune(spark: SparkSession) -> None:
    """Bound the batches between the JVM and Python by bytes too, as texts and blocks can be long, read few rows at once, and let workers find this package."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [*environment.get("PYTHONPATH", "").split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, environment.get("PYTHONPATH", "").split(os.pathsep))])


def collect_own_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that its heap shrinks again, and give the memory that its JVM has freed outside the heap back to the system.

    Plans and broadcast tables of earlier jobs fill the heap: on small tables nearly every join is a broadcast.  Python's garbage goes first, as it holds on to
    objects of the JVM.  What compiling generated code takes is freed but kept by the C library; a JVM without the command to trim it keeps it.
    """
    gc.collect()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):
        find = jvm.java.lang.Class.forName
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        kinds, values = new(jvm.java.lang.Class, len(names)), new(jvm.java.lang.Object, len(names))
        given = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0))
        for i, (kind, value) in enumerate(zip(names, given, strict=True)):
            kinds[i], values[i] = find(kind), value
        find("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver and the executors collect their garbage, so that heap and buffers which only earlier stages needed go back to the system.

    An executor's heap grows to its limit in a long session and is then held beside the Python workers.  There is a task for each core; an executor
    that gets none keeps its garbage, which changes no result.
    """
    collect_own_garbage(spark)
    n = spark.sparkContext.defaultParallelism
    done = F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")
    spark.range(0, n, 1, n).select(done).write.format("noop").mode("overwrite").save()


def shards(total: int, each: int) -> int:
    """How many shards of about `each` items hold `total` items; grows with the input, with no upper limit below 2 ** 24."""
    return max(1, min(1 << 24, -(-int(total) // each)))
