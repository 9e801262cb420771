"""Small helpers shared by the operators: reading tables, work on Arrow batches, written tables, names of rows."""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a worker handles at a time. A single longer text is handled whole.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Rows of an Arrow batch where the session keeps Spark's own 10,000: rows here hold texts, and a batch is held outside the heap on both sides.
BATCH_ROWS = "2000"


def short_batches(spark: SparkSession) -> None:
    """Batches for rows with texts. A session that has a limit of its own keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Things that remember what a partition met; they are cleared when it ends, so that a reused worker keeps nothing of it.
CACHES: weakref.WeakSet = weakref.WeakSet()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release(remember: bool = False) -> None:
    """Give the memory of a finished partition back to the machine: Python workers are reused, and their heaps would add up."""
    for cache in [] if remember else list(CACHES):
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, remember: bool = False) -> DataFrame:
    """Apply ``work`` to each Arrow batch, in slices of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` bytes.

    With ``remember``, what a worker looked up (a bounded cache) stays for the next partition: faster, for some 25 MB a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                rows = max(1, min(SLICE_ROWS, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1))))
                for at in range(0, batch.num_rows, rows):
                    if (out := work(batch.slice(at, rows))) is not None and out.num_rows:
                        yield out
        finally:
            release(remember)

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share, for written tables. A session on one machine that names none gets its own."""
    import uuid

    context = spark.sparkContext
    if not (folder := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        import tempfile

        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a smaller file than a checkpoint's. Its shuffle files go."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` (or read from one) that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that name a row by its content, so that repeated ids with other texts stay apart. Rows without an id go by two hashes."""
    return [F.coalesce(doc_id.cast("long"), F.xxhash64(F.lit("no id"), text)).alias("_k1"), F.xxhash64(text).alias("_k2")]
