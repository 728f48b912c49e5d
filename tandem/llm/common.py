"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import scratch

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: lineage ends, lost executors do not matter."""
    path = f"{scratch(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; nulls are empty. No copy unless needed."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, ends, data = array.buffers()
    at = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of ``text_bytes``; bytes that are not UTF-8 become replacement characters."""
    blob = data.tobytes()
    try:
        blob.decode("utf-8")
        starts = at[:-1][at[:-1] < len(data)]
        good = not ((data[starts] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        good = False
    if good:
        return pa.Array.from_buffers(
            pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(blob)]
        ).cast(pa.string())
    return pa.array([blob[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cut a batch into runs of rows of about ``limit`` text bytes, so that work arrays stay small."""
    array = batch.column(column)
    sizes = np.zeros(len(array), np.int64)
    if len(array):
        _, at = text_bytes(array)
        sizes = np.diff(at)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(array):
        yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
