"""Tables written once to the folder that driver and executors share.

A written table cuts lineage: a lost executor costs a re-read, not a rerun of
the Python stage that made it.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

_RUN = uuid.uuid4().hex[:12]
#: The tables that the innermost scratch() is to remove.
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is set, on a single-machine master
    only; on a cluster an unset folder is an error, since executors could not
    read what others wrote.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    if (made := _MADE.get()) is not None:
        made.append(table)
    return table


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Removes the tables that written() makes within, at the end, but those that the function it gives is told to keep.

    What is returned lazily must keep the tables it reads.
    """
    made: list[DataFrame] = []
    before, wanted = _MADE.set(made), set()
    try:
        yield lambda *tables: wanted.update(t._written_at for t in tables if t is not None)
    finally:
        _MADE.reset(before)
        dropped(*(t for t in made if t._written_at not in wanted))
        if (outer := _MADE.get()) is not None:
            outer += [t for t in made if t._written_at in wanted]


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, most: int = 1000) -> DataFrame:
    """Left join on unique right keys, with hot left keys taken out of the shuffle.

    ``right`` has one row for each key and in ``size`` the number of left rows
    with that key. Keys that hold over 1/``most`` of all those rows number at
    most ``most``, so their rows are broadcast whatever the input; the rest is
    joined by a shuffle in which no key is hot. Neither side is sampled.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    bar = max(1, total // most)
    hot = F.broadcast(right.where(F.col(size) > bar).withColumn("_hot", F.lit(True)))
    cold = right.where(F.col(size) <= bar)
    marked = left.join(hot.select(*keys, "_hot"), keys, "left")
    a = left.join(hot.drop("_hot"), keys, "inner")
    b = marked.where("_hot IS NULL").drop("_hot").join(cold, keys, "left")
    return a.unionByName(b)


#: Rows, and bytes of their strings and arrays, up to which a side may be broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has BROADCAST_ROWS rows and BROADCAST_BYTES bytes at most."""
    wide = [F.coalesce(F.length(F.to_json(F.struct(f.name)) if isinstance(f.dataType, ArrayType) else F.col(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType | BinaryType | ArrayType)]
    each = sum(wide, F.lit(8 * len(df.columns))).cast("long")
    # Counted by partition: a limit would send rows of every partition to one task.
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def trim() -> None:
    """Give the memory that this Python process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    own = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if own is not None:
        own(0)


def give_back(spark: SparkSession) -> None:
    """Collect the driver's garbage and give freed memory back, in the JVM and in Python.

    A query of many jobs leaves their plans behind; Spark removes broadcasts and
    shuffle files only when the plans that made them are collected.
    """
    jvm, made = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    kinds, given = made(jvm.Class, 4), made(jvm.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        # By the interface's method: the class behind it is not open to reflection.
        jvm.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:  # a JVM without this command
        pass
    trim()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python at most ``rows`` rows of text at a time, where Spark's default would be more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
