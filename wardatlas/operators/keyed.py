"""Keyed tables: guards, upserts, checked merges, key discovery and key coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import district_number
from ..storage import materialize
from .joins import dimension, shuffled


def assert_none(df: DataFrame, condition: Column, message: str, show: list[str] | None = None) -> None:
    """Raise with a count and up to ten examples if any row meets the condition."""
    bad = df.where(condition)
    examples = [tuple(r) for r in bad.select(*(show or df.columns[:1])).take(10)]
    if examples:
        raise ValueError(f"{message}: {bad.count()} rows, for example {examples}")


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    examples = [tuple(r) for r in repeated.take(10)]
    if examples:
        raise ValueError(f"{what}: {repeated.count()} repeated keys on {keys}, for example {examples}")


def assert_keys(df: DataFrame, keys: list[str], what: str) -> None:
    """A row key must be present and unique."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    assert_none(df, missing, f"{what}: NULL in key {keys}", keys)
    assert_unique(df, keys, what)


def upsert(base: DataFrame | None, new: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """New rows replace base rows with the same key; a key twice in ``new`` is an error.

    The check shuffles the keys of the batch once; ``check=False`` leaves it
    out for a batch whose writer guarantees its key.
    """
    if check:
        assert_unique(new, keys, "upsert batch")
    if base is None:
        return new
    kept = base.join(shuffled(new.select(*keys)), keys, "left_anti")
    return kept.unionByName(new.select(*base.columns))


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = 256) -> str:
    """A keyed table as parquet in folders by a hash of its key, the form that ``upsert_buckets`` changes in place.

    The number of buckets and the key stand beside the data.  A bucket is what an upsert rewrites at least, so there
    should be many more of them than a batch touches.
    """
    assert_unique(df, keys, "keyed table")
    _bucketed(df, keys, buckets).repartition(buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    df.sparkSession.createDataFrame([(buckets, list(keys))], "buckets int, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
    return path


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def upsert_buckets(path: str, new: DataFrame, check: bool = True) -> list[int]:
    """Rows of a batch into a stored keyed table; only the buckets that hold one of its keys are read and rewritten.

    Returns these buckets.  A key twice in the batch is an error.  The new buckets are complete in the shared folder
    before the old ones are replaced, one folder each.
    """
    spark = new.sparkSession
    layout = spark.read.schema("buckets int, keys array<string>").json(f"{path}/_layout").first()
    keys = list(layout["keys"])
    if check:
        assert_keys(new, keys, "upsert batch")
    stored = spark.read.parquet(path)
    batch = materialize(_bucketed(new.select(*[c for c in stored.columns if c != "_bucket"]), keys, layout["buckets"]))
    touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())                # at most the number of buckets
    if not touched:
        return []
    held = stored.where(F.col("_bucket").isin(touched))
    merged = held.join(batch.select("_bucket", *keys), ["_bucket", *keys], "left_anti").select(*stored.columns).unionByName(batch.select(*stored.columns))
    whole = materialize(merged.repartition(len(touched), "_bucket"))                            # before its own source is replaced
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return touched


def replace_where(base: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Delete the rows that meet the condition, then add the new ones."""
    return base.where(~F.coalesce(condition, F.lit(False))).unionByName(new.select(*base.columns))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 validate: str = "m:1") -> DataFrame:
    """Join after checking that the sides hold unique keys where the cardinality says so."""
    sides = {"1:1": "both", "one_to_one": "both", "m:1": "right", "many_to_one": "right",
             "1:m": "left", "one_to_many": "left"}
    if validate not in sides:
        raise ValueError(f"unknown cardinality {validate!r}")
    if sides[validate] in ("both", "left"):
        assert_unique(left, on, "left side of the merge")
    if sides[validate] in ("both", "right"):
        assert_unique(right, on, "right side of the merge")
    return left.join(right, on, how)


def missing_keys(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Expected keys without a row in ``present``, whose rows are combined to keys before they are shuffled."""
    return expected.select(*on).distinct().join(shuffled(present.select(*on).distinct()), on, "left_anti")


def orphan_rows(assignments: DataFrame, units: DataFrame, on: str = "vtd_geoid") -> DataFrame:
    """Assignment rows whose unit is unknown."""
    return assignments.join(dimension(units.select(on)), on, "left_anti")


def require_full_cover(nodes: DataFrame, plan_map: DataFrame, on: str = "vtd_geoid") -> None:
    """Every graph node needs a district in the plan; raise with ten examples otherwise."""
    gone = missing_keys(nodes, plan_map, [on])
    examples = [r[0] for r in gone.take(10)]
    if examples:
        raise ValueError(f"plan map lacks {gone.count()} units, for example {examples}")


def reindex_zero(universe: DataFrame, totals: DataFrame, on: list[str]) -> DataFrame:
    """One row per universe key; keys without totals get 0."""
    values = [c for c in totals.columns if c not in on]
    joined = universe.select(*on).join(totals, on, "left")
    return joined.select(*on, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])


def mean_per_key(df: DataFrame, key: str) -> DataFrame:
    """Collapse repeated keys to the mean of their numeric columns."""
    numeric = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float", "smallint")]
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in numeric])


def join_quality(joined: DataFrame, probe: str) -> DataFrame:
    """Rows, matched rows, their share and whether the share is under 0.8."""
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count(probe).alias("matched"),
    ).withColumn("match_share", F.try_divide("matched", "total")).withColumn(
        "low_match", F.coalesce(F.col("match_share") < 0.8, F.lit(True)))


def key_overlap(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Share of distinct left district numbers found on the right, per candidate pair.

    The candidates are column names, a handful; each side is read once.
    """
    def number(df: DataFrame, key: str) -> Column:
        """Whole numbers as they are, text by the digits it ends with."""
        if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
            return F.col(key).cast("bigint")
        return F.coalesce(district_number(key).cast("bigint"), F.col(key).cast("string").try_cast("bigint"))

    def numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.lit(k).alias(name), number(df, k).alias("num"))
            for i, k in enumerate(keys)]))
        return df.select(pairs.alias("p")).select("p.*").where("num is not null").distinct()

    ls = numbers(left, [k for k in left_keys if k in left.columns], "left_key").withColumnRenamed("pos", "left_pos")
    rs = numbers(right, [k for k in right_keys if k in right.columns], "right_key").withColumnRenamed("pos", "right_pos")
    n_left = ls.groupBy("left_key").agg(F.count(F.lit(1)).alias("n_ids"))
    hits = ls.join(rs, "num").groupBy("left_pos", "left_key", "right_pos", "right_key").agg(
        F.count(F.lit(1)).alias("n_matched"))
    return hits.join(n_left, "left_key").select(
        "left_pos", "left_key", "right_pos", "right_key", "n_ids", "n_matched",
        (F.col("n_matched") / F.col("n_ids")).alias("overlap"))


def detect_join_key(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                    least: float = 0.8) -> tuple[str, str]:
    """First candidate pair, in the given order, whose overlap is above ``least``."""
    found = key_overlap(left, right, left_keys, right_keys).where(F.col("overlap") > least).orderBy(
        "left_pos", "right_pos").limit(1).collect()
    if not found:
        raise KeyError("no candidate pair of key columns overlaps enough")
    return found[0]["left_key"], found[0]["right_key"]


def find_district_column(df: DataFrame, candidates: list[str], low: int, high: int) -> str:
    """First candidate column whose every value reads as a district number in range."""
    present = [c for c in candidates if c in df.columns]
    if present:
        checks = df.agg(*[
            F.count_if(F.coalesce(~district_number(c).between(low, high), F.lit(True))).alias(c) for c in present
        ]).first()
        for c in present:
            if checks[c] == 0:
                return c
    raise KeyError(f"no column reads as district numbers; columns: {df.columns}")


def stack_plans(enacted: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Enacted and ensemble plans in one table; columns missing on a side are NULL."""
    return enacted.unionByName(ensemble, allowMissingColumns=True)
