"""Embedding whitening on MLlib block matrices.

Vectors become exact long lattice points, so their sums are exact and a row is
centred without rounding before its one division. The centred rows, numbered
without a gap, form a BlockMatrix of row blocks; its transpose times itself is
the scatter, whose eigenvectors are found on the driver (the matrix has the
size of a vector squared, whatever the number of rows); the BlockMatrix times
the whitening matrix projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import settle

SCALE, SHIFT = 64, 1_000_000
ROWS, COLUMNS = 1024, 256  # of a block
SPLIT_BYTES = 64 << 20  # of centred rows that one task of the scatter holds
_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition above, place below


def lattice(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x`` (array<long>): floor(64 c) + 1,000,000 of every entry c, as double.

    Rows whose vector is null or has a null or non-finite entry are left out;
    entries that a shorter vector lacks count as null ones.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    kept = rows.select(F.col(key).alias("key"), v.alias("v")).where(
        F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    return kept.select("key", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _totals(placed: DataFrame, width: int) -> np.ndarray:
    """The exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _matrix(batch.column("x"), width).sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width, dtype=np.int32), "s": total})

    parts = placed.select("x").mapInArrow(run, "at int, s long")
    got = parts.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return np.array([r["s"] for r in got], np.int64)


def _centred(placed: DataFrame, first: dict[int, int], n: int, total: np.ndarray) -> DataFrame:
    """(index, key, deviation, v): the gapless row number, sum((n x - S)^2) and x - S / n."""
    width = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            index = np.array([first[p] for p in (at >> 33).tolist()], np.int64) + (at & _LOW)
            from_mean = n * _matrix(batch.column("x"), width) - total
            if (from_mean.astype(np.float64) ** 2).sum(1).max(initial=0.0) >= 2.0**63:
                raise OverflowError("a deviation does not fit a long")
            v = pa.ListArray.from_arrays(
                pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array((from_mean / n).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(index), batch.column("key"), pa.array((from_mean**2).sum(1)), v], ["index", "key", "deviation", "v"]
            )

    kind = placed.schema["key"].dataType.simpleString()
    return placed.mapInArrow(run, f"index long, key {kind}, deviation long, v array<double>")


def _times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a x b; the middle dimension is dealt to ``splits`` tasks, which Python's own multiply cannot say."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, explained, defined): columns are eigenvectors over the root of their eigenvalue, by falling eigenvalue.

    ``explained`` is the share of the trace. Where the eigenvalue is zero to
    double precision nothing can be scaled: the column is zero and not ``defined``.
    The largest entry of a column is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(covariance))
    defined = values > max(trace, 0.0) * len(covariance) * np.finfo(np.float64).eps
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    matrix = np.where(defined, vectors * sign / np.sqrt(np.where(defined, values, 1.0)), 0.0)
    return matrix, values / trace if trace > 0 else np.full(len(order), np.nan), defined


def _identity_error(projected: DataFrame, n: int, defined: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the projected rows minus the identity."""
    k = len(defined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _matrix(batch.column("w"), k)
            gram += w.T @ w
            total += w.sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(k * k + k, dtype=np.int32), "s": np.concatenate([gram.ravel(), total])})

    parts = projected.select("w").mapInArrow(run, "at int, s double")
    got = parts.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").toPandas()["s"].to_numpy()
    mean = got[k * k :] / n
    off = got[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(off[np.ix_(defined, defined)]).max(initial=0.0))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per row with a sound vector: ``key``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``whitened`` (array<double>) has the first ``components`` principal
    components, each of variance one over all these rows; ``explained`` (array)
    their shares of the variance. ``deviation`` is the exact
    sum((n x - S)^2) over the lattice points x; one beyond a long stops the
    job. Null, ragged and non-finite vectors are left out (see ``lattice``);
    null and repeated keys are rows like any other; ties of eigenvalues fall in
    any order. A component without variance has null ``whitened`` entries, and
    null ``explained`` if there is no variance at all; it does not count for
    ``identity_error``. Other columns are not read. An empty table gives no rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    spark = rows.sparkSession
    shape = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    nothing = spark.createDataFrame([], f"`{key}` {kind}, {shape}")
    placed = settle(lattice(rows, key, vector).withColumn("at", F.monotonically_increasing_id()))
    width = placed.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return nothing
    per_part = F.shiftright("at", 33).alias("p"), F.size("x") == width
    found = placed.groupBy(per_part[0], per_part[1].alias("sound")).agg(F.count(F.lit(1)).alias("c")).collect()
    if not all(r["sound"] for r in found):  # shorter vectors leave gaps in the numbers
        placed = settle(placed.where(per_part[1]).withColumn("at", F.monotonically_increasing_id()))
        found = placed.groupBy(per_part[0]).agg(F.count(F.lit(1)).alias("c")).collect()
    first, n = {}, 0
    for part in sorted(found, key=lambda r: r["p"]):  # one number per partition
        first[part["p"]] = n
        n += part["c"]
    total = _totals(placed, width)
    centred = _centred(placed, first, n, total)
    vectors = centred.select("index", array_to_vector("v").alias("v"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, width)
    blocks = indexed.toBlockMatrix(ROWS, min(COLUMNS, width))
    row_blocks = -(-n // ROWS)
    splits = min(row_blocks, max(-(-n * width * 8 // SPLIT_BYTES), spark.sparkContext.defaultParallelism))
    scatter = _times(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    matrix, explained, defined = whitening_matrix(scatter / n, components)
    k = len(defined)
    own = BlockMatrix(
        spark.sparkContext.parallelize([
            ((i, 0), DenseMatrix(len(part), k, part.ravel(order="F").tolist()))
            for i, part in enumerate(np.split(matrix, range(COLUMNS, width, COLUMNS)))
        ]),
        min(COLUMNS, width), k, width, k,
    )
    product = _times(blocks, own).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model).toDF("index", "w")
    found = centred.drop("v").join(projected.select("index", vector_to_array("w").alias("w")), "index")
    found = settle(found.select("key", "deviation", "w"))
    error = _identity_error(found, n, defined)
    held = F.array(*[F.lit(bool(d)) for d in defined])
    shares = F.array(*[F.lit(None if np.isnan(e) else float(e)).cast("double") for e in explained])
    return found.select(
        F.col("key").alias(key), F.lit(n).cast("long").alias("n"), "deviation",
        F.zip_with("w", held, lambda w, ok: F.when(ok, w)).alias("whitened"),
        shares.alias("explained"), F.lit(error).alias("identity_error"),
    )


def by_component(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``whiten`` with a row per ``key`` and ``component`` (from 1)."""
    found = whiten(rows, key, vector, components)
    return found.select(
        key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    ).select(
        key, (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
