"""Shared helpers of the training-data operators: work folders, materialised steps, exact selection."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.store import shared_folder

#: Rows and bytes of one Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between JVM and Python, unless the session asks for fewer rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over small batches; a finished task hands its memory back."""
    small_batches(df.sparkSession)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(frugal, schema)


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The written table cuts the lineage and survives lost executors; what reads it twice
    computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`, once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm  # noqa: SLF001
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def id_bucket(doc_id: int | None, modulus: int = 5) -> int:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest index reachable over the links ``a[i]-b[i]``."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label
