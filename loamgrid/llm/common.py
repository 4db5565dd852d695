"""Shared storage, Arrow batching and row-level helpers of the operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handed to one vectorised kernel call; a longer text is taken alone.
BLOCK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) may the session have
    none: a local folder is made then and set as the checkpoint folder.  On a
    cluster that is an error, as executors wouldn't find each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = process_cache()
        if "own_dir" not in known:
            known["own_dir"] = "file://" + tempfile.mkdtemp(prefix="loamgrid-")
            spark.sparkContext.setCheckpointDir(known["own_dir"])
        base = known["own_dir"]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/loamgrid/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    A lost executor costs only the tasks that were running on it, since
    finished parts are files in shared storage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """A dictionary that lives as long as this Python process.

    It is held by ``sys`` so that functions shipped by value to a reused
    worker still find what an earlier task has loaded.
    """
    return sys.__dict__.setdefault("_loamgrid_process_cache", {})


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [0 if x is None else x for x in pc.binary_length(col).to_pylist()]
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def texts_as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that a result column would clash with (any case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to send texts to Python in small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def release() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    known = process_cache()
    if "trim" not in known:
        known["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if known["trim"] is not None:
        known["trim"](0)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers, which Spark keeps for later tasks, don't hold on to a task's memory."""

    def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def slim(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text: what else the table holds never meets an operator's own names."""
    return small_batches(df).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def schema_plus(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` followed by the DDL ``fields``."""
    extra = T._parse_datatype_string(fields)
    return T.StructType(list(df.schema.fields) + list(extra.fields))
