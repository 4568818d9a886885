"""What the operators of this subpackage share: reading, shared scratch space and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds at a time; longer texts are taken alone.
SLICE_BYTES = 2 << 20
#: Bytes of a batch that goes to a Python worker.
ARROW_BYTES, ARROW_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes a step may broadcast after they were counted; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def bounded(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of ARROW_BYTES, not of 64 MB, of which JVM and worker hold several each; a smaller setting stays."""
    now = spark.conf.get(ARROW_CONF)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > ARROW_BYTES:
        spark.conf.set(ARROW_CONF, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests), below Spark's warehouse, which executors share too."""
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: later steps start from it, also after an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has Spark's cleaner delete shuffle files and broadcasts of steps that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_key() -> Column:
    """A hash of a row's text, which with its doc_id tells the row from others but for copies."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `materialise` has written, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, which should be a written table, with a broadcast hint if it has few rows and bytes; otherwise the join is left to
    shuffle, and Spark splits keys that are hot on the other side, as a written table needs no aggregate above its exchange."""
    wide = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum((F.coalesce(c, F.lit(0)).cast("long") for c in wide), F.lit(0).cast("long"))
    rows = df.count()  # of a written table without reading rows; a limit would send them all to one task
    if rows > limit or rows * 8 * len(df.columns) > most:
        return df
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"] if wide else 0
    return F.broadcast(df) if rows * 8 * len(df.columns) + held <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written copy of the rows with a number of their own, and that column's name: steps that decide row by row read this copy."""
    row = fresh(df, "row")[0]
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), name), row


def partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 of null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def released() -> None:
    """Gives back to the system what a finished step of a Python worker has held: workers live on for other steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes and the offsets of each (one more than texts); null is empty."""
    filled = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    arr = filled.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have `limit` bytes together, at least one row each."""
    sizes = text_sizes(batch.column(column))
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)
