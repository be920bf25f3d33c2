"""Small helpers of the operators in this subpackage: stored tables, row keys, Arrow tasks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardatlas.storage import scratch_path, ship_package

BROADCAST_BYTES = 32 << 20
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep the Arrow batches of whole texts small: what a task holds follows them."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and a lost executor costs no more than a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_column(schema: StructType, name: str, kind) -> StructType:
    """The schema and one column more; the name must be new."""
    if name in schema.names:
        raise ValueError(f"there is a column {name} already")
    return StructType([*schema.fields, StructField(name, kind)])


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its counted rows, at `row_bytes` each, stay within BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, as (doc, rid, text). rid is a key of the row's content: rows that repeat both
    id and text have one rid and count as one document."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"),
                       F.col(text_col).cast("string").alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where `fn` turns a batch into dicts of equally long arrays, in the order of `schema`."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_pydict(columns)
    return df.mapInArrow(task, schema)


#: What operators keep in a Python worker from task to task, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Let go of what other operators keep in this worker: a worker is used again by the next stage, with all its memory."""
    for forget in HELD.values():
        forget()


def keep_where(df: DataFrame, text_col: str, test: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all columns, whose text passes `test` (an Arrow string array to booleans). Only texts go to Python; the rows
    stay where they are."""
    def passes(column: pa.Array) -> pa.Array:
        release()
        return pa.array(test(column), type=pa.bool_())
    return df.where(F.arrow_udf(passes, "boolean")(F.col(text_col).cast("string")))


def signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return np.ascontiguousarray(hashes).view(np.int64)


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex in `links` (a bigint, b bigint): root is the smallest vertex that links lead to.

    Each round takes the smallest root among a vertex's neighbours and then the root's own root, until nothing changes.
    A vertex with very many links is summed by partial minima and its joins can be split, as one side has a row a key.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                   .select("v", F.least("v", "m").alias("root")), "roots")
    while True:
        near = (both.join(roots, both.a == roots.v).groupBy(F.col("b").alias("v")).agg(F.min("root").alias("near")))
        lower = roots.join(near, "v").select("v", "root", F.least("root", "near").alias("low"))
        jump = roots.select(F.col("v").alias("low"), F.col("root").alias("far"))
        after = stored(lower.join(jump, "low").select("v", F.least("low", "far").alias("root"), F.col("root").alias("was")), "roots")
        if after.where("root <> was").isEmpty():
            return after.select("v", "root")
        roots = after.select("v", "root")
