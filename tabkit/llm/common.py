"""Shared steps of the operators: columns added by an Arrow function, numbered Arrow pieces, settings of the session."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.text import as_bytes, slices
from tabkit.session import checkpoint_dir

TEXT = "__text"


def name(column: str):
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def annotate(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``fields`` computed from its text, without a shuffle.

    ``make`` runs once in each task and returns a function from (texts as binary array, the piece) to one array per field.
    ``keep`` names the columns to carry along (default all). A carried column with the name of a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[name(c) for c in kept], name(text).cast("string").cast("binary").alias(TEXT))
    schema = T.StructType(source.schema.fields[:-1] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for part in slices(batch, TEXT):
                made = work(as_bytes(part.column(part.num_columns - 1)), part)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)
                del made
        del work
        release()

    return source.mapInArrow(run, schema)


def scan(df: DataFrame, text: str, schema: str | T.StructType, make: Callable[[], tuple[Callable, Callable]], keep: list[str] | None = None) -> DataFrame:
    """Rows made from whole partitions: ``make`` returns (take a piece and yield batches, yield the rest at the end)."""
    source = df.select(*[name(c) for c in keep or []], name(text).cast("string").cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, finish = make()
        for batch in batches:
            for part in slices(batch, TEXT):
                yield from take(as_bytes(part.column(part.num_columns - 1)), part)
        yield from finish()
        del take, finish
        release()

    return source.mapInArrow(run, schema)


def remainder(column: str, divisor: int):
    """crc32 of a key written as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(name(column).cast("string"), F.lit("")).cast("binary")) % divisor


def shuffle_width(df: DataFrame, factor: int = 1) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * factor


def stage(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared checkpoint folder and read again: cuts lineage, survives lost executors, gives real sizes."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "tabkit", f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(staged: DataFrame) -> int:
    """Bytes that Spark's optimizer knows a staged table to have (its files, scaled by width); exact enough for a bound."""
    return int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array from the lengths of its lists and the values of all."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def texts(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


FIELD = T.StructField
LONG, DOUBLE, INT, STRING, BINARY, BOOLEAN = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.BooleanType()
