"""What several operators share: the shared folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="genomark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of any executor. The table goes when the application ends, or with ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path  # for discard
    return found


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_among(key: Column, boundaries: Sequence, kind: str) -> Column:
    """How many of the sorted boundaries (of that type; structs as dicts) are below key: a binary search in a constant array, so the expression stays small however many there are."""

    def step(bounds: Column, width: int) -> Callable[[Column], Column]:
        return lambda at: F.when(F.get(bounds, at + (width - 1)) < key, at + width).otherwise(at)

    def search(bounds: Column) -> Column:
        at = F.lit(0)
        for k in range(len(boundaries).bit_length() - 1, -1, -1):
            at = let(at, step(bounds, 1 << k))
        return at

    return let(F.from_json(F.lit(json.dumps(list(boundaries))), f"array<{kind}>"), search) if boundaries else F.lit(0)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing will read any more."""
    spark, path = table.sparkSession, table._written_at
    _file_system(spark, path).delete(_path(spark, path), True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives back to the system at its end what the worker holds unused: workers live on and serve other operators."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Gives memory that this process holds unused back to the system, where the allocators can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batch with about max_bytes of text each (a longer text is a part of its own), and their texts with nulls as empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    ends = pc.cumulative_sum(pc.binary_length(texts)).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + max_bytes, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What make returns, made once in this process: Python workers are used for many tasks, and a task's own globals are not kept."""
    kept = sys.modules.setdefault("_genomark_worker", type(sys)("_genomark_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
