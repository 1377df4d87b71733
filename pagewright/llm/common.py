"""Scratch tables in the cluster's shared folder, and connected components.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again, so that a lost executor costs one stage at most and no table has a single copy.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, tempfile.TemporaryDirectory] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Shuffle files of a query go as soon as it has ended; nothing reads them once its table is written.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two returns of the driver's unused memory, and when the last one was, by application.
TRIM_SECONDS = 2
_TRIMMED: dict[str, float] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if master not in _LOCAL_DIRS:
        _LOCAL_DIRS[master] = tempfile.TemporaryDirectory(prefix="pagewright-")
        atexit.register(_LOCAL_DIRS[master].cleanup)
    return _LOCAL_DIRS[master].name


@contextmanager
def _own_shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def trim_driver(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap back to the system; False where the JVM can't.

    Planning and compiling many queries on many threads leaves freed blocks in the C library's arenas, which otherwise keep them.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # The server's own class is not open to py4j; its interface is.
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = new(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except (Py4JError, StopIteration):
        return False
    return True


def _trim_now_and_then(spark: SparkSession) -> None:
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _TRIMMED.get(app, -TRIM_SECONDS) >= TRIM_SECONDS:
        _TRIMMED[app] = now if trim_driver(spark) else float("inf")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the scratch folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _own_shuffles_freed(spark):
        df.write.parquet(path)
    _trim_now_and_then(spark)
    kept = spark.read.schema(schema).parquet(path)
    _PATHS[kept] = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Removes kept tables. Whatever was made of them must have been kept itself by then."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, by alternating large and small stars.

    ``edges`` has two columns of one orderable type, in any orientation, with repeats and
    loops allowed. Returns (node, component) for every node of a proper edge; component is
    the smallest node reachable. Each round is two joins on node, written to the scratch
    folder; hubs are aggregated before the shuffle, and joins on them are split by AQE.
    """
    a, b = (F.col(c) for c in edges.columns)
    e = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = keep(e, "edges")
    while True:
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before, e = e, keep(small, "stars")
        drop(before)
        several = e.groupBy("hi").count().where("count > 1").limit(1).count()
        if several == 0 and e.join(e.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count() == 0:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
