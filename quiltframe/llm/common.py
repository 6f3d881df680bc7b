"""Shared plumbing of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset in local mode (tests) a folder of this machine is
    used, and the setting is then made so that later calls agree; a cluster
    without the setting is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="quiltframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder.

    Spark's cleaner removes the files once nothing refers to them any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a columnar table: smaller, and read column by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quiltframe-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files that nothing refers to any more; without, they stay until the driver's memory fills.

    The listener bus keeps the last query until another one ends, so an empty one is run.
    """
    import gc

    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Lets the executors' JVMs give back the heap that earlier stages filled with garbage, which they otherwise keep beside the workers' memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()


def frugal(run: Callable, tokenizer: bool = False) -> Callable:
    """A function for mapInArrow that gives back what its worker process has freed, before and after.

    Workers live on for later tasks of other stages, and would keep their
    peaks, and the tokenizers of earlier stages unless this one has use for them.
    """

    def free() -> None:
        bpe = sys.modules.get("quiltframe.llm.bpe")
        if bpe and not tokenizer:
            bpe.library_encoder.cache_clear()
            bpe.queue_encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        try:
            yield from run(batches)
        finally:
            free()

    return wrapped


def parallelism(spark: SparkSession, least: int = 8) -> int:
    """Partitions for an explicit shuffle: what the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def whole(text: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(text), F.lit("")).alias(text)


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each batch as Python lists of at most ROWS entries, as lists of texts are far larger than the batch."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, ROWS):
            yield tuple(c.slice(at, ROWS).to_pylist() for c in columns)


def chunked(size: int, *lists: list) -> Iterator[tuple]:
    for i in range(0, len(lists[0]), size):
        yield tuple(x[i : i + size] for x in lists)


def u32crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
