"""Joins that check what they assume: size before a broadcast, key counts before a salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

# Rows and bytes of a dimension table that the driver and each executor hold with ease.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32_000_000


def has_more_rows(df: DataFrame, limit: int) -> bool:
    return df.select(F.lit(1)).limit(limit + 1).count() > limit


def _row_bytes(df: DataFrame) -> int | None:
    """Bytes a row of fixed-width columns takes; None if a column's width depends on its values."""
    width = 8
    for f in df.schema.fields:
        if f.dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp"):
            return None
        width += 8
    return width


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table may be broadcast: at most ``max_rows`` rows and BROADCAST_BYTES bytes, both counted.

    Spark's own estimate is not asked: it starts from compressed files and takes an unfolded array for one row.
    Fixed-width rows are counted up to the limit; texts and arrays are measured in the same pass that counts.
    """
    width = _row_bytes(df)
    if width is not None:
        return not has_more_rows(df, min(max_rows, BROADCAST_BYTES // width))
    text = F.coalesce(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(2))
    n, size = df.agg(F.count(F.lit(1)), F.sum(text.cast("bigint"))).first()
    return n <= max_rows and (size or 0) <= BROADCAST_BYTES


def shuffled(df: DataFrame) -> DataFrame:
    """A join side of unknown size, which Spark must not broadcast on an estimate of its own."""
    return df.hint("merge")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension table once its size is known to fit.

    A larger one is returned as it is: Spark then chooses, by its own estimate.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same, but a larger one takes part in a shuffled join, with adaptive skew handling, whatever Spark estimates."""
    return F.broadcast(df) if fits(df, max_rows) else shuffled(df)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows_per_task: int = 200_000,
                how: str = "inner", unfolded: bool = False) -> DataFrame:
    """Equi-join whose hot keys are spread over several tasks.

    Keys holding more than ``rows_per_task`` left rows are counted first, with
    map-side combining; there are at most rows/rows_per_task of them.  The
    left rows of a hot key take one of several salts by a hash of their
    content, the right rows of that key are repeated once per salt, and all
    other keys keep salt 0.  The result equals the plain join, and without a
    hot key it is the plain join.  ``unfolded`` tells that a side holds
    unfolded arrays: Spark takes it for far smaller than it is, so no side is
    broadcast.
    """
    side = shuffled if unfolded else lambda df: df
    if how not in ("inner", "left"):
        raise ValueError("salted_join does inner and left joins")
    hot = materialize(
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .select(*on, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )
    if hot.isEmpty():
        return left.join(side(right), on, how)
    hot = small_side(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    lefts = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), salts).cast("int")
    ).drop("_salts")
    rights = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return lefts.join(side(rights), [*on, "_salt"], how).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcast the right side if its size allows, else join with hot left keys salted."""
    if fits(right):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how=how)
