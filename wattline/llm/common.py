"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Text is split into words at these bytes (space and \t to \r), as the contracts say.
SPACE = " \t\n\x0b\x0c\r"
#: Words of a shingle and the least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with a part of its own for this application.

    Where none is configured, a temporary one will do if driver and executors are one process; on a cluster it would lose data.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-wattline-"))
    return f"{at.rstrip('/')}/wattline-{spark.sparkContext.applicationId}"


_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """df written once to the shared folder and read back (with `schema`, if given): a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


BUCKET_BYTES, MOST_BUCKETS = 1 << 24, 100_000  # of one bucket; the number that Spark allows


def bucketed(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """df stored in the shared folder in buckets of `key`, and their number; size: its bytes, about.

    A join on key with a frame repartitioned to that number needs no exchange of df.
    """
    spark = df.sparkSession
    n = min(MOST_BUCKETS, size // BUCKET_BYTES + 1)
    table = f"wattline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table), n


def broadcast_rows(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint for a stored table of at most `most` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_key(text: Column) -> list[Column]:
    """A 128-bit content key: two xxhash64 with different seeds. Equal texts (nulls too) have equal keys."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more for the end); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def byte_table(seed: int) -> np.ndarray:
    """256 random 64-bit values, the same in every process."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each node's connected component.

    Each round every node takes its least neighbour (or itself) as parent, parents are replaced by their
    parents until they are roots, and the graph is contracted to the roots; edges within a root
    vanish, so a star is gone after one round, and the number of roots at least halves. Every step is an aggregation
    or a join of narrow rows, stored in the shared folder. Nodes without edges are not returned.
    """
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    first = True
    while now.limit(1).count():
        both = now.union(now.select("v", "u"))
        up = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("r")), "parents")
        moved = True
        while moved:
            parent = up.select(F.col("u").alias("r"), F.col("r").alias("higher"))
            jumped = stored(up.join(parent, "r").select("u", F.col("higher").alias("r"), F.col("r").alias("was")), "parents")
            moved, up = jumped.where("r <> was").limit(1).count() > 0, jumped.select("u", "r")
        if first:
            out, first = up.select(F.col("u").alias("node"), F.col("r").alias("root")), False
        else:
            out = out.join(up.select(F.col("u").alias("root"), F.col("r").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        ends = now.join(up.select("u", F.col("r").alias("ru")), "u").join(up.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v")
        now = stored(ends.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges")
    return stored(out, "components")
