"""Embedding whitening with Spark MLlib's BlockMatrix.

Every entry becomes a whole number, so sums and means are exact.  The
distinct vectors (the fit list) are numbered one after the other, centred
and laid into a BlockMatrix of row blocks.  Its transpose times itself is
the scatter; the rows between are split, so that no task sees more than a
share of the blocks.  The scatter, dimensions x dimensions, is solved on the
driver, and the BlockMatrix times the whitening matrix projects the rows.
The whitened rows' own transpose product measures how far their covariance
is from the identity.  Equal vectors are projected once.

The driver holds the coordinates of the blocks (one pair for ``BLOCK``
entries) and matrices of the dimensions' size, no rows.

Defined results: vectors that are null, empty, hold null or non-finite
entries, or have another dimension than the most common one (of two, the
smaller) are dropped; repeated ids and vectors each keep their rows; a
component whose variance is zero beside the largest (below 1e-12 of it) has
null ``whitened`` and does not count in ``identity_error``; a deviation
beyond 38 digits and an entry that is no long are errors; other columns,
whatever their names, are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from .common import join_groups, store

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK = 1 << 18                     # entries of a block
SPLITS = 64                         # of the rows between in a transpose product, and blocks of a split beyond that
FLAT = 1e-12                        # a variance below this share of the largest counts as zero
POSITION = 33                       # bits of the place within a partition in monotonically_increasing_id

BLOCKS = T.StructType([T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])),
                       T.StructField("block", MatrixUDT())])
ARROW_AT = pa.struct([("row", pa.int64()), ("column", pa.int64())])
ARROW_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                          ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    value = F.col(column).cast("array<double>")
    sound = (F.size(value) > 0) & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(value, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    rows = vectors.where(sound).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))
    key = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256))
    return store(rows.withColumn("key", key), "vectors")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``row``, a stored monotonically_increasing_id) plus ``idx``, 0, 1, 2 and so on."""
    rows = rows.withColumn("part", F.shiftright("row", POSITION))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)             # one row a partition
    offsets = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.col("row").bitwiseAND(F.lit((1 << POSITION) - 1))
    return rows.join(F.broadcast(offsets), "part").withColumn("idx", F.col("offset") + place).drop("part", "offset", "row")


def _blocks(numbered: DataFrame, n: int, sums: np.ndarray, height: int) -> DataFrame:
    """The centred rows as blocks of ``height`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in chain(batches, [None]):
            ids = batch.column(0).to_numpy() if batch is not None else np.array([-1])
            x = batch.column(2).flatten().to_numpy().reshape(len(ids), -1) if batch is not None else np.empty((1, len(sums)), np.int64)
            bounds = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if ids[a] != here:
                    if held:
                        rows = (np.concatenate(held) * n - sums) / n
                        matrix = {"type": 1, "numRows": len(rows), "numCols": len(sums), "values": rows.ravel(), "isTransposed": True}
                        yield pa.RecordBatch.from_arrays([pa.array([{"row": here, "column": 0}], ARROW_AT), pa.array([matrix], ARROW_MATRIX)], ["at", "block"])
                    here, held = int(ids[a]), []
                held.append(x[a:b])

    rows = numbered.select((F.col("idx") / height).cast("long").alias("number"), "idx", "x")
    return rows.repartition("number").sortWithinPartitions("number", "idx").mapInArrow(run, BLOCKS)


def _matrix(blocks: DataFrame, height: int, rows: int, columns: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, columns, rows, columns), height, columns)


def _gram(matrix: BlockMatrix, height: int, rows: int) -> np.ndarray:
    """The transpose of ``matrix`` times itself; the rows between are dealt out to many tasks."""
    blocks = -(-rows // height)
    splits = max(min(blocks, SPLITS), -(-blocks // SPLITS))
    columns = matrix.numCols()
    # the Python wrapper of multiply has no argument for the number of splits
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, columns, columns).toLocalMatrix().toArray()


def _projected(blocks: DataFrame, height: int) -> DataFrame:
    """(idx, whitened array) of the rows of the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                shape = m["numRows"].as_py(), m["numCols"].as_py()
                values = m["values"].values.to_numpy()
                rows = values.reshape(shape) if m["isTransposed"].as_py() else values.reshape(shape[::-1]).T
                ends = np.arange(0, rows.size + 1, shape[1], dtype=np.int32)
                whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(number * height + np.arange(shape[0])), whitened], ["idx", "whitened"])

    return blocks.select("at.row", "block").mapInArrow(run, "idx long, whitened array<double>")


def components(vectors: DataFrame, count: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each row and component: vec_id, component, n, deviation (exact, decimal), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    usable = _usable(vectors, id_column, column)
    common = usable.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    if common is None:
        return spark.createDataFrame([], kind)
    dims = common["dims"]
    usable = usable.where(F.size("x") == dims)
    fit = store(usable.groupBy("key", "x").agg(F.count("*").alias("copies")).withColumn("row", F.monotonically_increasing_id()), "distinct")
    n = fit.count()
    summed = fit.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s")).orderBy("d").collect()      # one row a dimension
    sums = np.array([r["s"] for r in summed], dtype=np.int64)

    height = max(1, BLOCK // dims)
    numbered = _numbered(fit)
    laid = store(_blocks(numbered, n, sums, height), "blocks")
    centred = _matrix(laid, height, n, dims)
    variance, vectors_of = np.linalg.eigh(_gram(centred, height, n) / n)
    total = float(variance.sum())
    variance, vectors_of = variance[::-1][:count], vectors_of[:, ::-1][:, :count]
    vectors_of = vectors_of * np.where(np.take_along_axis(vectors_of, np.abs(vectors_of).argmax(axis=0)[None], 0) < 0, -1, 1)
    kept = len(variance)
    sound = (variance > FLAT * variance[0]) if variance[0] > 0 else np.zeros(kept, bool)
    whitening = np.where(sound, vectors_of / np.sqrt(np.where(sound, variance, 1)), 0)

    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, kept, whitening.ravel(order="F").tolist()))], 1), dims, kept)
    product = centred.multiply(right)
    result = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    result = store(result.select(F.struct(F.col("_1._1").cast("long").alias("row"), F.col("_1._2").cast("long").alias("column")).alias("at"), F.col("_2").alias("block")), "whitened")
    apart = np.abs(_gram(_matrix(result, height, n, kept), height, n) / n - np.eye(kept))[np.ix_(sound, sound)]

    deviation = F.expr(f"aggregate(zip_with(x, sums, (a, s) -> cast({n}L * a - s AS decimal(19,0))), cast(0 AS decimal(38,0)), "
                       "(t, v) -> cast(t + v * v AS decimal(38,0)))")
    known = (numbered.withColumn("sums", F.array(*[F.lit(s).cast("long") for s in sums.tolist()]))
             .select("idx", "key", "copies", deviation.alias("deviation")).join(_projected(result, height), "idx").drop("idx"))
    rows = join_groups(usable.select("vec_id", "key"), store(known, "projected"), "key", "copies", usable.count())
    place = F.col("place")
    share = F.array(*[F.lit(float(v / total) if total > 0 else None).cast("double") for v in variance])
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value"))
            .select("vec_id", (place + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.when(F.get(F.array(*[F.lit(bool(s)) for s in sound]), place), F.col("value")).alias("whitened"),
                    F.get(share, place).alias("explained"), F.lit(float(apart.max()) if apart.size else None).cast("double").alias("identity_error")))
