"""Embedding whitening with MLlib's BlockMatrix.

Rows are dealt into blocks of a distributed matrix where they lie, each block with the ids of its rows beside it; the
centred blocks, transposed and multiplied with themselves, give the scatter matrix. Its eigenvectors are found at the
driver (a matrix of dimension x dimension), scaled, and the blocks times that matrix are the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixbench.llm.common import forget, stored

#: Rows of a block, and blocks whose products one task adds up.
ROWS, TOGETHER = 1024, 16
#: Components whose eigenvalue is this share of the largest have no variance to scale.
_NOTHING = 1e-12


class Whitening(NamedTuple):
    """What was fitted: number of vectors, per-dimension sums of the whole numbers, eigenvalues from the largest,
    components (columns), and the trace of the covariance."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty, and holds finite numbers only, of the commonest length (of several the
    larger); vectors of another length cannot be compared and are left out."""
    good = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d")).first().d
    return good.where(F.size(vector) == (length or 0))


def blocks(df: DataFrame, key: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(block, ids, x): blocks of at most ``ROWS`` rows, numbered from 0 without gaps, as a stored table. x has the
    rows' whole numbers floor(scale * c) + offset one row after the other. Rows stay where they are: a task cuts its
    own into blocks, and a table of its tasks and their numbers of blocks makes the numbers run on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, ids, xs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def made(ids, xs):
            ids, x = pa.concat_arrays(ids), np.concatenate(xs)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, pa.array(x.ravel()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), *lists], names=["part", "at", "ids", "x"])

        for batch in batches:
            wide = batch.num_rows and len(batch.column(1).flatten()) // batch.num_rows
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                c = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)
                ids.append(rows.column(0))
                xs.append(np.floor(scale * c).astype(np.int64) + offset)
                held += len(c)
                while held >= ROWS:
                    all_ids, all_x = pa.concat_arrays(ids), np.concatenate(xs)
                    yield made([all_ids[:ROWS]], [all_x[:ROWS]])
                    at, ids, xs, held = at + 1, [all_ids[ROWS:]], [all_x[ROWS:]], held - ROWS
        if held:
            yield made(ids, xs)

    name = df.schema[key].dataType.simpleString()
    cut = stored(df.select(key, vector).mapInArrow(run, f"part int, at long, ids array<{name}>, x array<long>"), "cut")
    tasks = cut.groupBy("part").agg(F.count("*").alias("m"))
    before = tasks.select("part", (F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")).alias("before"))
    out = stored(cut.join(before, "part").select((F.col("before") + F.col("at")).alias("block"), "ids", "x"), "blocks")
    forget(cut)
    return out


def _sums(cut: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and per-dimension sums of x, exact in any order."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            for ids, x in zip(batch.column(0), batch.column(1), strict=True):
                rows = len(ids.values)
                part = x.values.to_numpy().reshape(rows, -1).sum(axis=0)
                n, total = n + rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = cut.select("ids", "x").mapInArrow(run, "n long, sums array<long>")
    n = parts.agg(F.sum("n").alias("n")).first().n
    each = parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return n or 0, np.array([r.s for r in each], np.int64)


def _matrix(cut: DataFrame, n: int, sums: np.ndarray, count: int) -> BlockMatrix:
    """The centred rows as a BlockMatrix of one column of blocks; the last rows of a block that is not full are zero.
    Kept in memory or on disk, as the multiplications read it several times."""
    dims = len(sums)

    def centred(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                own = x.values.to_numpy().reshape(-1, dims)
                rows = np.zeros((ROWS, dims))
                rows[: len(own)] = (own * n - sums) / n  # whole numbers up to the division
                out.append(rows.tobytes(order="F"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "values"])

    rows = cut.select("block", "x").mapInArrow(centred, "block long, values binary").rdd
    made = rows.map(lambda r: ((int(r[0]), 0), DenseMatrix(ROWS, dims, np.frombuffer(r[1]))))
    return BlockMatrix(made, ROWS, dims, count * ROWS, dims).persist(StorageLevel.MEMORY_AND_DISK)


def _scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """matrix' x matrix. The long side is cut into ``splits`` parts, each multiplied in a task of its own."""
    java = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", java._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _project(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(block, values): the rows of each block times ``weights``, row after row."""
    d, k = weights.shape
    one = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, weights.ravel(order="F")))], 1)
    product = matrix.multiply(BlockMatrix(one, d, k, d, k))
    rows = product.blocks.map(lambda b: (int(b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes())))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("values", T.BinaryType())])
    return spark.createDataFrame(rows, schema)


def _identity_error(values: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the values' covariance less the identity, centred before multiplying; rows of
    zeros behind a block's last are not counted, as ``m`` is the number of its rows."""

    def over(work):
        def run(batches):
            total = None
            for batch in batches:
                for m, v in zip(batch.column(0), batch.column(1), strict=True):
                    part = work(np.frombuffer(v.as_py()).reshape(-1, k)[: m.as_py()])
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

        made = values.select("m", "values").mapInArrow(run, "s array<double>")
        each = made.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
        return np.array([r.x for r in each])

    mean = over(lambda v: v.sum(axis=0)) / n
    covariance = over(lambda v: (v - mean).T @ (v - mean)).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def fit(cut: DataFrame) -> tuple[Whitening | None, BlockMatrix | None]:
    """The fit of ``blocks`` and the centred matrix; None without a row."""
    n, sums = _sums(cut)
    if not n:
        return None, None
    count = cut.count()
    matrix = _matrix(cut, n, sums, count)
    covariance = _scatter(matrix, max(1, -(-count // TOGETHER))) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return Whitening(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(covariance))), matrix


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each row of ``df`` with a usable
    vector (``finite``) and each component up to ``most``.

    Entries c become whole numbers x = floor(scale * c) + offset. ``n`` is the number of vectors, S their sums;
    ``deviation`` the sum over the dimensions of (n * x - S)^2, exact (null where a long cannot hold it); ``whitened``
    the row's x - S / n on the component over the root of its eigenvalue; ``explained`` that eigenvalue's share of the
    covariance's trace; ``identity_error`` one value, how far the whitened rows' covariance is from the identity.

    Components are numbered from 1 by falling eigenvalue. Those without variance have no whitened form and are left
    out, so that equal vectors, or a single one, give no row, like an empty table. Null and repeated keys are rows like
    others. The driver holds matrices of the dimension, and the numbers of the blocks, which the multiplication asks
    for; a block's rows are ``ROWS``, so that these are a thousandth of the rows."""
    spark = df.sparkSession
    good = finite(df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector")), "_vector")
    cut = blocks(good, "_key", "_vector", scale, offset)
    fitted, matrix = fit(cut)
    id_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = 0 if fitted is None else int((fitted.eigenvalues > _NOTHING * max(fitted.eigenvalues[0], 0)).sum()) if fitted.eigenvalues[0] > 0 else 0
    k = min(most, usable)
    if not k:
        return spark.createDataFrame([], schema)
    n, sums = fitted.n, fitted.sums
    made = _project(spark, matrix, fitted.components[:, :k] / np.sqrt(fitted.eigenvalues[:k]))
    rows = stored(cut.select("block", "ids", "x").join(made, "block").withColumn("m", F.size("ids")), "whitened")
    error, explained = _identity_error(rows, n, k), fitted.eigenvalues[:k] / fitted.trace
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    largest = np.iinfo(np.int64).max

    def out(batches):
        for batch in batches:
            for ids, x, v in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                m = len(ids.values)
                apart = x.values.to_numpy().reshape(m, -1) * n - sums
                if len(sums) * float(np.abs(apart).max()) ** 2 < 2.0**62:
                    squares = (apart * apart).sum(axis=1).tolist()
                else:
                    squares = [sum(int(a) ** 2 for a in row) for row in apart]
                deviation = pa.array([s if s <= largest else None for s in squares], pa.int64())
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation.take(pa.array(at)),
                        pa.array(np.frombuffer(v.as_py()).reshape(-1, k)[:m].ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    done = rows.select("ids", "x", "values").mapInArrow(out, schema)
    forget(cut)
    return done
