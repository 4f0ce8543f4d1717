"""Whitening of embeddings by distributed block matrices (MLlib's BlockMatrix).

Centred rows are indexed into blocks of at most 4 MB; the scatter is the product of the transposed block matrix with itself, its sums split over
as many tasks as there are row blocks; the driver holds nothing but dimensions x dimensions values and solves the eigenproblem; the product
with the whitening matrix, again a block matrix, projects the rows.

Rows are read once as integers x = floor(64 * c) + 1,000,000, which Parquet packs tightly, and written in blocks to the shared folder,
so that every later reader sees the same blocks, also after an executor is lost. Only exact integers n * x - S are centred,
then divided once. Block products shuffle about three times the blocks; nothing depends on ids, so hot ids do not matter.

Defined results: vectors that are null or hold null or non-finite entries are left out, so are empty ones and those whose length is not
the most frequent (of equally frequent ones the longer); rows without or with repeated ids are rows of their own; 64 * c saturates at +-2^62;
a deviation beyond a long is null; of components without variance (up to rounding) `whitened` is null, and `explained` is null where
nothing varies; `identity_error` is over the components with variance, 0 without any; no rows give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.llm.common import fresh_path, materialised

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 2.0**62
#: Entries of a block: 4 MB of doubles.
BLOCK_ENTRIES = 1 << 19
COMPONENTS = 32

_PLACE = pa.struct([("i", pa.int64()), ("j", pa.int64())])
_MATRIX = pa.struct(
    [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
     ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
)
_BLOCKS = StructType([StructField("place", StructType([StructField("i", LongType()), StructField("j", LongType())])), StructField("m", MatrixUDT())])


def _vectors(vectors: pa.ListArray, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as int64 matrix) of the valid vectors, for each length, or for one."""
    starts, sizes = vectors.offsets.to_numpy()[:-1], np.diff(vectors.offsets.to_numpy())
    entries = vectors.values.cast(pa.float64())
    bad = np.asarray(entries.is_null()) | ~np.isfinite(entries.fill_null(np.nan).to_numpy(zero_copy_only=False))
    faults = np.concatenate([[0], np.cumsum(bad)])
    valid = np.asarray(vectors.is_valid()) & (sizes > 0) & (faults[starts + sizes] == faults[starts])
    numbers = entries.fill_null(0.0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[valid]) if length is None else [length]:
        rows = np.flatnonzero(valid & (sizes == size))
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * numbers[starts[rows][:, None] + np.arange(size)])
        yield rows, np.clip(x, -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are of the most frequent length, and their sums by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, x in _vectors(batch.column("vector")):
                n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
                # 2^31 rows of a half word each: no sum overflows.
                high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
                held[x.shape[1]] = n + len(x), [s + (int(h) << 31) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
        for size, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["size", "n", "sums"])

    found = materialised(rows.select("vector").mapInArrow(partial, "size long, n long, sums array<string>"))
    most = found.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return 0, []
    by_dimension = (
        found.filter(F.col("size") == most["size"]).select(F.posexplode("sums").alias("k", "s"))
        .groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    )
    return most["n"], [int(r["s"]) for r in by_dimension]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n * x - S as doubles, sums of its squares as exact longs)."""
    reach = n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in sums)
    if reach >= 2**62:
        apart = n * x.astype(object) - np.array(sums, dtype=object)
        squares = [int(s) for s in (apart * apart).sum(axis=1)]
        return apart.astype(np.float64), [s if s < 2**63 else None for s in squares]
    apart = n * x - np.array(sums, dtype=np.int64)
    most = float(np.abs(apart).max())
    if most * most * x.shape[1] < 2.0**62:
        return apart.astype(np.float64), (apart * apart).sum(axis=1).tolist()
    return apart.astype(np.float64), [s if s < 2**63 else None for s in (int(sum(v * v for v in row)) for row in apart.tolist())]


def _write_blocks(rows: DataFrame, path: str, n: int, sums: list[int]) -> None:
    """Blocks of rows in the shared folder: (part, j, rows, ids, deviations, x row by row)."""
    size = len(sums)
    most = max(1, BLOCK_ENTRIES // size)
    id_type = rows.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        ids: list[pa.Array] = []
        xs: list[np.ndarray] = []
        j = held = 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(xs)
            _, squares = _deviations(x, n, sums)
            key = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([j], pa.int64()), pa.array([len(x)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), pa.array([squares], pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))],
                names=["part", "j", "rows", "ids", "deviations", "x"],
            )

        for batch in batches:
            key = batch.column("id")
            for at, x in _vectors(batch.column("vector"), size):
                done = 0
                while done < len(at):
                    taken = min(most - held, len(at) - done)
                    ids.append(key.take(pa.array(at[done : done + taken])))
                    xs.append(x[done : done + taken])
                    held, done = held + taken, done + taken
                    if held == most:
                        yield block()
                        ids, xs, j, held = [], [], j + 1, 0
        if held:
            yield block()

    rows.mapInArrow(blocks, f"part long, j long, rows int, ids array<{id_type}>, deviations array<long>, x array<long>").write.parquet(path)


def _block_matrix(blocks: DataFrame, n: int, sums: list[int], rows_per_block: int, row_blocks: int) -> BlockMatrix:
    """The centred rows; the last block of a part may be short, zeros fill it up."""
    size = len(sums)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("x")[i].values.to_numpy().reshape(-1, size)
                centred = np.zeros((rows_per_block, size))
                centred[: len(x)] = _deviations(x, n, sums)[0] / n
                # Columns one after another: values of a dimension lie together and compress well.
                values = pa.ListArray.from_arrays(pa.array([0, centred.size], pa.int32()), pa.array(centred.ravel(order="F")))
                none = pa.array([None], pa.list_(pa.int32()))
                place = pa.StructArray.from_arrays([batch.column("block").slice(i, 1), pa.array([0], pa.int64())], fields=list(_PLACE))
                matrix = pa.StructArray.from_arrays(
                    [pa.array([1], pa.int8()), pa.array([rows_per_block], pa.int32()), pa.array([size], pa.int32()), none, none, values, pa.array([False])], fields=list(_MATRIX)
                )
                yield pa.RecordBatch.from_arrays([place, matrix], names=["place", "m"])

    made = callMLlibFunc("createBlockMatrix", blocks.select("block", "x").mapInArrow(matrices, _BLOCKS), rows_per_block, size, row_blocks * rows_per_block, size)
    return BlockMatrix(made, rows_per_block, size)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left times right; the sums over middle blocks are split over so many tasks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _stored_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The blocks, numbered, a bound of the numbers, and the rows of the longest."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("part").alias("part"), F.max("j").alias("j"), F.max("rows").alias("rows")).first()
    width = last["j"] + 1
    return stored.withColumn("block", F.col("part") * width + F.col("j")), (last["part"] + 1) * width, last["rows"]


def _matrix_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    m = batch.column("m")[i]
    rows, cols = m["numRows"].as_py(), m["numCols"].as_py()
    values = m["values"].values.to_numpy()
    return values.reshape(rows, cols) if m["isTransposed"].as_py() else values.reshape(cols, rows).T


def _blocks_of(matrix: BlockMatrix) -> DataFrame:
    """Rows (block, m) of a matrix of one column of blocks."""
    found = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).toDF("place", "m")
    return found.select(F.col("place._1").cast("long").alias("block"), "m")


def _identity_error(projected: DataFrame, lengths: DataFrame, kept: int, n: int) -> float:
    """The largest entry of the projected rows' covariance minus the identity: centred scatters of blocks, merged by their means."""

    def scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                z = _matrix_of(batch, i)[: batch.column("rows")[i].as_py(), :kept]
                mean = z.mean(axis=0)
                apart = z - mean
                scatter, means = apart.T @ apart + len(z) * np.outer(mean, mean), len(z) * mean
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([means, scatter.ravel()]).tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = (
        projected.join(lengths, "block").select("m", "rows").mapInArrow(scatters, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    )
    values = np.array([r["v"] for r in sums])
    mean, scatter = values[:kept] / n, values[kept:].reshape(kept, kept)
    return float(np.abs(scatter / n - np.outer(mean, mean) - np.eye(kept)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error), one for each valid vector and component."""
    spark = rows.sparkSession
    plain = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    id_type = plain.schema["id"].dataType.simpleString()
    n, sums = _sums(plain)
    if not n:
        return spark.createDataFrame([], f"{key} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    size = len(sums)
    path = fresh_path(spark, "whitening")
    _write_blocks(plain, path, n, sums)
    blocks, row_blocks, rows_per_block = _stored_blocks(spark, path)
    centred = _block_matrix(blocks, n, sums, rows_per_block, row_blocks)
    splits = min(row_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scatter = _product(centred.transpose(), centred, splits).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / 2 / n

    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    total = float(np.trace(covariance))
    kept = int((values > max(values[0], 0.0) * size * np.finfo(float).eps).sum())
    explained = [float(max(v, 0.0) / total) if total > 0 else None for v in values]
    error = 0.0
    if kept:
        whitening = vectors[:, :kept] / np.sqrt(values[:kept])
        local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, kept, whitening.ravel(order="F")))], 1)
        projected = _blocks_of(_product(centred, BlockMatrix(local, size, kept, size, kept)))
        error = _identity_error(projected, blocks.select("block", "rows"), kept, n)
        placed = projected.join(blocks.select("block", "ids", "deviations"), "block").select("m", "ids", "deviations")
    else:
        placed = blocks.select("ids", "deviations")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, deviations = batch.column("ids")[i].values, batch.column("deviations")[i].values
                z = np.full((len(ids), len(values)), np.nan)
                if kept:
                    z[:, :kept] = _matrix_of(batch, i)[: len(ids), :kept]
                flat = z.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(values), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([ids, deviations, lists], names=["id", "deviation", "z"])

    spread_rows = placed.mapInArrow(spread, f"id {id_type}, deviation long, z array<double>")
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return spread_rows.select(F.col("id").alias(key), "deviation", F.posexplode("z").alias("k", "whitened")).select(
        key, (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
