"""Column profiles and correlation matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null, to_number
from .joins import sized_join
from .order_stats import distribution, ranked_values, uniform_hash


def _tall(df: DataFrame, cols: list[str], value_type: str | None = None, keep: list[str] | None = None) -> DataFrame:
    v = lambda c: F.col(c).cast(value_type) if value_type else F.col(c)
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v(c).alias("value")) for c in cols]))
    return df.select(*(keep or []), pair.alias("_p")).select(*(keep or []), "_p.*")


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL or empty-text count per column, one pass, most missing first."""
    row = df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in df.columns])
    return _tall(row, df.columns).select("column", F.col("value").alias("missing_count")).orderBy(
        F.desc("missing_count"), "column")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sd, range and quartiles of numeric columns, all columns in one ranking."""
    return distribution(_tall(df, cols, "double"), ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column positions, names and types as a table."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string")


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of every column pair over the rows where both are present, in one aggregation; NaN counts as missing."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    known = lambda c: nan_to_null(F.col(c).cast("double"))
    row = df.agg(*[F.corr(known(a), known(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def average_ranks(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Average rank of every value within its column; ties share the mean of their ranks.

    All columns are ranked together.  A missing value has no rank and does
    not touch the ranks of the other columns.
    """
    tall = _tall(df, cols, "double", [key])
    ranks = ranked_values(tall, ["column"], "value").select(
        "column", "value", (F.col("below") + (F.col("cnt") + 1) / 2).alias("rank"))
    back = sized_join(tall, ranks, ["column", "value"], "left")
    return back.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in cols])


def spearman(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rank correlation of every column pair, each over the rows where both values are present.

    Complete columns are ranked once.  Pairs with a missing value have ranks of
    their own, taken within the rows that count for the pair.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    gaps = df.agg(*[F.count_if(~ok(c)).alias(f"{i}") for i, c in enumerate(cols)]).first()
    whole = [c for i, c in enumerate(cols) if not gaps[i]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    parts = []
    if len(whole) > 1:
        parts.append(pearson(average_ranks(df, key, whole), whole))
    broken = [(a, b) for a, b in pairs if not (a in whole and b in whole)]
    if broken:
        both = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), F.when(ok(a) & ok(b), F.col(c).cast("double")).alias("value"))
                                   for i, (a, b) in enumerate(broken) for side, c in ((0, a), (1, b))]))
        tall = df.select(key, both.alias("_p")).select(key, "_p.*").where("value is not null")
        ranks = ranked_values(tall, ["pair", "side"], "value").select(
            "pair", "side", "value", (F.col("below") + (F.col("cnt") + 1) / 2).alias("rank"))
        back = sized_join(tall, ranks, ["pair", "side", "value"]).groupBy(key, "pair").agg(
            F.max(F.when(F.col("side") == 0, F.col("rank"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("rank"))).alias("y"))
        names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in broken])
        parts.append(back.groupBy("pair").agg(F.corr("x", "y").alias("corr")).select(
            names[F.col("pair")]["a"].alias("col_a"), names[F.col("pair")]["b"].alias("col_b"), "corr"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_scale(df: DataFrame, cols: list[str]) -> str:
    """'0-1' when no value exceeds one, else '0-100' (also for no values)."""
    row = df.agg(*[F.max(to_number(c)).alias(c) for c in cols]).first()
    seen = [v for v in row if v is not None]
    return "0-1" if seen and max(seen) <= 1.0 + 1e-6 else "0-100"


def to_percent(df: DataFrame, cols: list[str], scale: str | None = None) -> DataFrame:
    factor = 100.0 if (scale or value_scale(df, cols)) == "0-1" else 1.0
    return df.withColumns({c: to_number(c) * F.lit(factor) for c in cols})


def group_means(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Column means per group, one row per (column, group)."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])
    return _tall(means, cols, "double", [group]).withColumnRenamed("value", "mean")


def party_labels(df: DataFrame, key: str, dem: str = "dem_share", rep: str = "rep_share") -> DataFrame:
    """0/1 party column that has both values whenever the rows allow it.

    Plain majority first.  If all rows agree, above the median; if none is
    above it, the upper half of the rows, equal values ordered by a hash of
    the key.
    """
    def classes(flag: Column) -> int:
        return df.agg(F.countDistinct(F.coalesce(flag, F.lit(False)).cast("int"))).first()[0]

    majority = F.col(dem) > F.col(rep)
    if classes(majority) == 2:
        return df.withColumn("party", F.coalesce(majority, F.lit(False)).cast("int"))
    median = distribution(df, [], dem, {"p50": 0.5}).first()
    if median is None:
        return df.withColumn("party", F.lit(0))
    above = F.col(dem) > F.lit(median["p50"])
    if classes(above) == 2:
        return df.withColumn("party", F.coalesce(above, F.lit(False)).cast("int"))
    # the median is the largest value: only its own rows need an order
    below = df.where(F.col(dem) < F.lit(median["p50"])).count()
    ties = df.where(F.col(dem) == F.lit(median["p50"])).select(key, uniform_hash(F.col(key)).alias("_h"))
    ordered = ranked_values(ties.withColumn("_o", F.struct("_h", key)), [], "_o", spread="hash", range_on="_h")
    upper = ordered.where(F.col("below") + below >= -(-median["n"] // 2)).select(
        F.col(f"_o.{key}").alias(key), F.lit(1).alias("party"))
    return df.join(upper, key, "left").withColumn("party", F.coalesce("party", F.lit(0)))
