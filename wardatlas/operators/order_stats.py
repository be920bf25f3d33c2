"""Exact ranks, quantiles and empirical distribution positions without one-task groups.

A window over a group, or ``percentile`` on it, brings all distinct values of
the group to one task.  Here the values are first collapsed to counts with
map-side combining, then cut into value ranges; a range of a group is what one
task sorts, and only the totals of the ranges are summed across the group.
The cut points decide the balance, never the result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL = "_all_rows"


def _range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut_points(df: DataFrame, column: str, ranges: int) -> list[float]:
    probs = [i / ranges for i in range(1, ranges)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", probs, 0.25 / ranges)
    return sorted(set(found))


def uniform_hash(*cols) -> Column:
    """64-bit hash; its leading bits cut rows into even ranges without a look at the data."""
    return F.xxhash64(*cols)


def ranked_values(df: DataFrame, by: list[str], value: str, *, spread: str = "quantile",
                  range_on: str | None = None, weight: Column | None = None,
                  carry: list[Column] | None = None) -> DataFrame:
    """One row per (group, value): ``cnt``, rows ``below`` it and ``n`` in the group.

    spread='quantile'  cut points from one approximate-quantile pass;
    spread='hash'      ``range_on`` is a ``uniform_hash``: even cuts, no pass;
    spread='few'       the group has few distinct values by its nature (a count
                       of districts), so no cut is needed.
    ``mean`` of the group is added for numeric values.  Rows with a NULL or NaN
    value or a NULL group key are left out.  ``carry`` adds aggregates per value.
    """
    keys = list(by) or [_ALL]
    src = df if by else df.withColumn(_ALL, F.lit(0))
    src = src.where(F.col(value).isNotNull())
    for k in by:
        src = src.where(F.col(k).isNotNull())
    range_on = range_on or value
    numeric = dict(df.dtypes)[value] in ("int", "bigint", "double", "float", "smallint", "tinyint")
    if dict(df.dtypes)[value] in ("double", "float"):     # NaN is a missing number here
        src = src.where(~F.isnan(value))

    ranges = _range_count(df)
    extra = [] if range_on == value else [F.first(range_on).alias(range_on)]
    counts = src.groupBy(*keys, value).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("cnt"), *extra, *(carry or []))
    if spread == "few":
        counts = counts.withColumn("_range", F.lit(0))
    elif spread == "hash":
        counts = counts.withColumn(
            "_range", F.floor((F.col(range_on).cast("double") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    else:
        cuts = _cut_points(src, range_on, ranges)
        counts = counts.withColumn("_cut_on", F.col(range_on).cast("double"))
        if cuts:
            splits = [float("-inf"), *cuts, float("inf")]
            counts = Bucketizer(splits=splits, inputCol="_cut_on", outputCol="_range").transform(counts)
        else:
            counts = counts.withColumn("_range", F.lit(0.0))
        counts = counts.drop("_cut_on")

    if spread == "few":
        w = Window.partitionBy(*keys)
        before = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = counts.withColumns({
            "below": F.coalesce(F.sum("cnt").over(before), F.lit(0)),
            "n": F.sum("cnt").over(w),
            **({"mean": F.try_divide(F.sum(F.col("cnt") * F.col(value)).over(w), F.sum("cnt").over(w))} if numeric else {}),
        })
        return out.drop("_range", *([] if by else [_ALL]))

    sums = [F.sum("cnt").alias("_cnt")]
    if numeric:
        sums.append(F.sum(F.col("cnt") * F.col(value).cast("double")).alias("_sum"))
    totals = counts.groupBy(*keys, "_range").agg(*sums)
    w = Window.partitionBy(*keys)                         # at most one row per range
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_range",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(w).alias("n"),
        *([F.try_divide(F.sum("_sum").over(w), F.sum("_cnt").over(w)).alias("mean")] if numeric else []),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(totals, [*keys, "_range"]).withColumn(
        "below", F.col("_offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return out.drop("_range", "_offset", *([] if by else [_ALL]))


def _value_at(position: Column, value: str) -> Column:
    hit = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
    return F.max(F.when(hit, F.col(value)))


def distribution(df: DataFrame, by: list[str], value: str, probs: dict[str, float], *,
                 spread: str = "quantile", above: float | None = None) -> DataFrame:
    """Count, mean, sample sd, min, max and interpolated quantiles per group, all exact.

    ``above`` adds the share of values greater than it as ``share_above``.
    With the default spread the input is read twice; hand in a stored table
    where it is dear to compute.
    """
    ranked = ranked_values(df, by, value, spread=spread).withColumn("_v", F.col(value).cast("double"))
    aggs = [
        F.max("n").alias("n"), F.max("mean").alias("mean"),
        F.sum(F.col("cnt") * F.pow(F.col("_v") - F.col("mean"), 2)).alias("_ss"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    ]
    if above is not None:
        aggs.append(F.sum(F.when(F.col("_v") > above, F.col("cnt")).otherwise(0)).alias("_above"))
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        aggs += [_value_at(F.floor(pos), "_v").alias(f"_lo_{name}"),
                 _value_at(F.ceil(pos), "_v").alias(f"_hi_{name}")]
    g = ranked.groupBy(*by).agg(*aggs)
    cols = [F.col("n").cast("bigint").alias("n"), "mean",
            F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("sd"), "min", "max"]
    if above is not None:
        cols.append((F.col("_above") / F.col("n")).alias("share_above"))
    for name, p in probs.items():
        frac = F.lit(float(p)) * (F.col("n") - 1)
        frac = frac - F.floor(frac)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return g.select(*by, *cols)


def ecdf_positions(targets: DataFrame, draws: DataFrame, by: list[str], value: str, *,
                   spread: str = "quantile") -> DataFrame:
    """Place each distinct target value of a group among the draws of that group.

    Adds ``n_draws``, ``n_le``, ``n_ge`` and the draws' ``draw_mean`` and
    ``draw_sd``.  Targets enter the ranking with weight zero, so one pass
    serves any number of targets and no target meets every draw.  Targets of a
    group without draws stay, with ``n_draws`` 0.
    """
    if not by:
        placed = ecdf_positions(targets.withColumn(_ALL, F.lit(0)), draws.withColumn(_ALL, F.lit(0)),
                                [_ALL], value, spread=spread)
        return placed.drop(_ALL)
    both = draws.select(*by, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_w")).unionByName(
        targets.select(*by, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_w")))
    ranked = ranked_values(both, by, "_v", spread=spread, weight=F.col("_w"),
                           carry=[F.min("_w").alias("_has_target")])
    spread_of = ranked.groupBy(*by).agg(
        F.sum(F.col("cnt") * F.pow(F.col("_v") - F.col("mean"), 2)).alias("_ss"))
    places = ranked.where(F.col("_has_target") == 0).select(
        *by, F.col("_v").alias(value), F.col("n").alias("n_draws"),
        (F.col("below") + F.col("cnt")).alias("n_le"), (F.col("n") - F.col("below")).alias("n_ge"),
        F.col("mean").alias("draw_mean"))
    return places.join(spread_of, by).withColumn(
        "draw_sd", F.when(F.col("n_draws") > 1, F.sqrt(F.col("_ss") / (F.col("n_draws") - 1)))).drop("_ss")


def row_index(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, 2 ... in the order of a unique numeric key, without sorting in one task.

    A key that is NULL or occurs twice is an error.
    """
    rest = [c for c in df.columns if c != key]
    missing = df.where(F.col(key).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no {key}")
    ranked = ranked_values(df, [], key, carry=[F.first(c).alias(c) for c in rest])
    once = F.when(F.col("cnt") > 1, F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string"))).cast("bigint"))
    return ranked.select(*df.columns, once.otherwise(F.col("below")).alias(name))
