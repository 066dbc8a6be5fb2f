"""Embedding whitening with distributed block matrices.

Vectors become vectors of integers; each distinct one counts once in the fit. Its rows, centred and
indexed without gaps, are blocks of a BlockMatrix B; the scatter matrix is B'B, taken in parts so that no task
holds all blocks; its eigenvectors are found on the driver, since it has the square of the dimension only;
B times the whitening matrix gives the whitened rows. The rows of the table itself are projected in the
same way by an index of their own, so a vector that many rows share is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wattline.llm.common import broadcast_rows, stored

#: Rows of a block at least, columns at most, bytes at most.
ROWS, COLUMNS, BYTES = 1024, 1024, 1 << 26
#: Blocks that one task multiplies, and write tasks whose starts may be broadcast.
TOGETHER, TASKS = 8, 200_000
#: Entries of this size and more (after scaling) cannot be told exactly from their mean.
LARGEST = 2.0**40
#: Components whose variance is a smaller share of the whole are rounding errors.
LEAST = 1e-12
#: A block as it is stored, and as it is read back.
BLOCK = "at struct<blockRowIndex:long,blockColIndex:long>, m struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
MATRIX = T.StructType([T.StructField("at", T.StructType([T.StructField(f, T.LongType()) for f in ("blockRowIndex", "blockColIndex")])), T.StructField("m", MatrixUDT())])


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # variances of the components, falling
    vectors: np.ndarray  # a column each
    trace: float
    error: float = field(default=0.0)  # of the whitened fit list's covariance

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def integers(rows: DataFrame, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """`row` (all columns of rows, as a struct) and `x`: floor(scale * c) + shift of each entry c of `vector`.

    Rows without a vector, or with a null, NaN, infinite or too large entry (scale * c of 2**40 and more) are dropped. A vector
    that is shorter than the longest one lacks entries, which counts as nulls; an empty vector too.
    """
    value = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    fine = F.forall(value, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False)))  # NaN is larger than any number
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    longest = usable.agg(F.max(F.size(vector))).first()[0] or 0
    return usable.where(F.size(vector) == longest).select(F.struct(*rows.columns).alias("row"), F.transform(value, lambda v: F.floor(v).cast("long") + shift).alias("x"))


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df stored, with `index` from 0 without gaps, and its number of rows.

    A row's index is its place in the task that wrote it plus the rows of the tasks before: a table with a row for each task.
    """
    kept = stored(df.withColumn("at", F.monotonically_increasing_id()), name)
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(task.alias("task")).count()
    before = stored(sizes.select("task", "count", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("before")), "starts")
    n = before.agg(F.sum("count")).first()[0] or 0
    joined = kept.withColumn("task", task).join(broadcast_rows(before.select("task", "before"), TASKS), "task")
    return joined.select(*df.columns, (F.col("before") + place).alias("index")), n


def sums(distinct: DataFrame) -> list[int]:
    """The exact sum of each entry of x: low and high bits are added apart, so no sum overflows."""
    parts = distinct.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").bitwiseAND(F.lit((1 << 20) - 1))).alias("low"), F.sum(F.shiftright("v", 20)).alias("high"))
    return [(r.high << 20) + r.low for r in sorted(parts.collect(), key=lambda r: r.pos)]


def _off(x: str, n: int, total: list[int]):
    """Entries minus the whole part of their mean, and what remains of the mean, times n: n * x - S = n * off - rest."""
    whole = [s // n for s in total]
    off = F.zip_with(x, F.lit(whole), lambda v, w: v - w)
    return off, [s - w * n for s, w in zip(total, whole, strict=True)]


def blocks(indexed: DataFrame, rows: int, n: int, total: list[int]) -> BlockMatrix:
    """The centred rows x - S / n as a BlockMatrix. `rows`: how many there are.

    Blocks are made by numpy in the tasks that the rows' block numbers go to, and stored; read back, a block is a matrix of Spark's own type.
    """
    spark, width = indexed.sparkSession, len(total)
    wide = min(COLUMNS, width)
    tall = min(max(ROWS, rows // 50_000), BYTES // (8 * wide))
    whole = np.array([s // n for s in total], np.int64)
    part = np.array([(s - w * n) / n for s, w in zip(total, whole.tolist(), strict=True)])

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by("index").combine_chunks()
        first = group["index"][0].as_py() // tall
        x = np.asarray(pa.compute.list_flatten(group["x"])).reshape(-1, width)
        centred = (x - whole).astype(np.float64) - part
        cut = [centred[:, k : k + wide] for k in range(0, width, wide)]
        out = [{"blockRowIndex": first, "blockColIndex": j} for j in range(len(cut))]
        m = [{"type": 1, "numRows": len(c), "numCols": c.shape[1], "values": c.ravel(), "isTransposed": True} for c in cut]
        return pa.Table.from_arrays([pa.array(out, place), pa.array(m, matrix)], names=["at", "m"])

    place = pa.struct([("blockRowIndex", pa.int64()), ("blockColIndex", pa.int64())])
    matrix = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
    made = stored(indexed.groupBy(F.expr(f"index div {tall}")).applyInArrow(make, BLOCK), "blocks", MATRIX)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", made, tall, wide, rows, width), tall, wide)


def gram(b: BlockMatrix) -> np.ndarray:
    """B'B. The long dimension is cut into parts of a few blocks; each part's product is a small matrix, and these are added."""
    parts = -(-b.numRows() // b.rowsPerBlock) // TOGETHER + 1
    turned = b.transpose()
    product = turned._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, turned.rowsPerBlock, b.colsPerBlock).toLocalMatrix().toArray()


def projected(b: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """B times a matrix of few columns."""
    wide = b.colsPerBlock
    spark = SparkSession.getActiveSession()
    cut = [((i, 0), Matrices.dense(len(part), part.shape[1], part.ravel("F").tolist())) for i, part in enumerate(matrix[k : k + wide] for k in range(0, len(matrix), wide))]
    return b.multiply(BlockMatrix(spark.sparkContext.parallelize(cut, 1), wide, matrix.shape[1], *matrix.shape))


def rows_of(b: BlockMatrix) -> DataFrame:
    """(index, w) of a BlockMatrix that is one block wide."""
    tall = b.rowsPerBlock
    frame = callMLlibFunc("getMatrixBlocks", b._java_matrix_wrapper._java_model)

    def run(batches):
        for batch in batches:
            for at, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first = next(iter(at.values()))  # block row, block column
                height, width = m["numRows"].as_py(), m["numCols"].as_py()
                values = np.asarray(m["values"].values).reshape((height, width) if m["isTransposed"].as_py() else (width, height))
                values = values if m["isTransposed"].as_py() else values.T
                w = pa.ListArray.from_arrays(np.arange(0, height * width + 1, width, dtype=np.int32), np.ascontiguousarray(values).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(first * tall + np.arange(height), pa.int64()), w], names=["index", "w"])

    return frame.mapInArrow(run, "index long, w array<double>")


def fit(x: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct values of the column x; None without rows."""
    distinct, n = numbered(x.select("x").distinct(), "distinct")
    if not n:
        return None
    total = sums(distinct)
    b = blocks(distinct, n, n, total)
    v = gram(b) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    trace = float(np.trace(v))
    keep = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST * trace]
    found = Whitening(n, total, values[keep], vectors[:, keep], trace)
    if not keep:
        return found
    white = gram(projected(b, found.matrix)) / n
    return Whitening(n, total, found.values, found.vectors, trace, float(np.abs(white - np.eye(len(keep))).max()))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """rows with a usable vector (see `integers`), as `row`, with n, deviation, explained (array), identity_error and w: the whitened components, at most `components`.

    Components without variance are left out (a table of equal vectors has none); deviation is null where it does not
    fit in a long. Repeated rows stay, and count once in the fit; a table without usable vectors gives no rows.
    Rows are kept in a struct, so columns of any name are safe.
    """
    spark = rows.sparkSession
    x, count = numbered(integers(rows, vector), "vectors")
    found = fit(x, components)
    if found is None:
        return x.select("row", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.lit([0.0]).alias("explained"), F.lit(0.0).alias("identity_error"), F.lit([0.0]).alias("w"))
    n = F.lit(found.n).cast("long")
    off, rest = _off("x", found.n, found.sums)
    square = F.zip_with(off, F.lit(rest).cast("array<long>"), lambda v, r: F.try_subtract(F.try_multiply(n, v), r))
    deviation = F.aggregate(square, F.lit(0).cast("long"), lambda a, s: F.try_add(a, F.try_multiply(s, s)))
    if len(found.values):
        w = rows_of(projected(blocks(x, count, found.n, found.sums), found.matrix))
    else:
        w = spark.createDataFrame([], "index long, w array<double>")
    own = [n.alias("n"), deviation.alias("deviation"), F.lit([float(e) / found.trace for e in found.values] or [0.0]).alias("explained"), F.lit(found.error).alias("identity_error")]
    return x.join(w, "index").select("row", *own, "w")
