"""Session helpers shared by the llm operators: durable lineage cuts and connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.graph import checkpointed, linked_components, shared_folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's setting, or a local one where none is set and the session is local (tests)."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation."""
    return checkpointed(df)


def free_shuffles(spark: SparkSession) -> None:
    """Has shuffle files removed that nothing refers to any more. Spark does so when the driver collects its garbage, which may be long after a step that wrote several times its input has ended. Takes about two seconds."""
    for _ in range(2):  # what Python lets go of is released in the background before the driver can collect it
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes that an Arrow batch holds at most, or one longer row.
BATCH = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends rows to Python in batches of at most ``BATCH`` bytes, or of less where it is set so.

    Spark's own bound is 64 MB or 10,000 rows, in practice all the texts of a task. A batch lies outside the heap of an executor, up to three times while it grows, and again in the Python worker.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))
    return df


def normal_text(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system at its end: workers are used again by later stages, and an executor's memory holds them too."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return inner


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow over all columns, whatever their names hold."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(named, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that an edge (u, v) joins to another; component is the smallest id of its component."""
    return linked_components(edges)
