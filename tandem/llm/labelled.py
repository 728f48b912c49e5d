"""Bounded samples of labelled rows, for the two operators that learn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, label: str, key: str, learn: Column, per_class: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, labels) of at most ``per_class`` rows of each class among the rows to learn from.

    The rows are those with the smallest key hashes, so the sample does not
    depend on the partitioning. Null keys and labels teach nothing; of
    contradicting labels of one key the larger counts.
    """
    rows = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    found = []
    for value in (0, 1):
        part = rows.where(F.col(label).cast("int") == value).select(F.col(key).cast("long").alias("k"))
        got = part.orderBy(F.xxhash64("k"), "k").limit(per_class).toPandas()["k"].to_numpy(np.int64)
        found.append((got, np.full(len(got), value, np.int8)))
    keys, values = np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def place(keys: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Position of each key in the sorted sample, -1 where it is not in it."""
    if not len(sampled):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sampled, keys), len(sampled) - 1)
    return np.where(sampled[at] == keys, at, -1)


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def numbers(column) -> np.ndarray:
    """A key column as integers, nulls as the smallest one."""
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
