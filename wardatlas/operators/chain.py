"""Plans of a chain as runs: one row per stretch of plans over which a unit keeps its district.

Neighbouring plans of a chain differ in few units, so a chain has far fewer runs (unit, district, first plan, last plan)
than rows (unit, plan).  Roll-ups work on the ends of runs: a run adds its unit's counts to a district at its first plan
and takes them away after its last one, and running sums over these changes are the district's counts.  What is shuffled
follows the changes, not units times plans.  Plans are numbered without a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import share
from ..tables import GROUP_VAP, VOTE_COLUMNS
from .joins import dimension
from .rollup import deviation_of

RUN = ["vtd_geoid", "district_id", "first_plan", "last_plan"]


def to_runs(plan_map: DataFrame, plan: str = "plan_no") -> DataFrame:
    """Runs of a long plan map; a unit that stands twice in a plan is an error, rows without a district or a plan are left out.

    The plans of a unit in a district are combined to a bit mask per 64 plans before anything is shuffled, so what is shuffled
    follows the runs and not units times plans.
    """
    rows = plan_map.select("vtd_geoid", "district_id", F.col(plan).cast("bigint").alias("plan")).where("district_id is not null and plan is not null")
    masks = rows.groupBy("vtd_geoid", "district_id", F.expr("shiftright(plan, 6)").alias("_block")).agg(
        F.expr("bit_or(shiftleft(1L, cast(plan & 63 as int)))").alias("_mask"), F.count(F.lit(1)).alias("_n"),
        F.min("plan").alias("first_plan"), F.max("plan").alias("last_plan"))
    twice = F.raise_error(F.concat(F.lit("unit twice in one plan: "), F.col("vtd_geoid").cast("string")))
    held, start = F.expr("bit_count(_mask)"), F.expr("shiftleft(_block, 6)")
    bits = lambda m: F.expr(f"filter(sequence(0L, 63L), i -> (shiftright({m}, cast(i as int)) & 1L) = 1L)")
    pieces = F.zip_with(bits("(_mask & ~shiftleft(_mask, 1))"), bits("(_mask & ~shiftrightunsigned(_mask, 1))"),
                        lambda a, b: F.struct((start + a).alias("first_plan"), (start + b).alias("last_plan")))
    whole = F.array(F.struct("first_plan", "last_plan"))
    each = masks.select("vtd_geoid", "district_id", F.explode(
        F.when(F.col("_n") > held, twice.cast("array<struct<first_plan:bigint,last_plan:bigint>>"))
        .when(F.col("last_plan") - F.col("first_plan") + 1 == held, whole).otherwise(pieces)).alias("p")).select("vtd_geoid", "district_id", "p.*")
    order = Window.partitionBy("vtd_geoid").orderBy("first_plan")
    before = F.lag("last_plan").over(order)
    fresh = F.when(before >= F.col("first_plan"), twice.cast("int")).when(
        (before == F.col("first_plan") - 1) & (F.lag("district_id").over(order) == F.col("district_id")), 0).otherwise(1)
    numbered = each.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy("vtd_geoid", "_run").agg(
        F.first("district_id").alias("district_id"), F.min("first_plan").alias("first_plan"), F.max("last_plan").alias("last_plan")).select(*RUN)


def each_plan(stretches: DataFrame, plan: str = "plan_no") -> DataFrame:
    """One row per plan of every run or stretch."""
    return stretches.withColumn(plan, F.explode(F.sequence("first_plan", "last_plan"))).drop("first_plan", "last_plan")


def write_runs(runs: DataFrame, path: str) -> str:
    """Runs as zstd parquet, sorted by their first plan within a file, so a reader of a few plans skips most of it."""
    runs.select(*RUN).sortWithinPartitions("first_plan", "vtd_geoid").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_runs(spark: SparkSession, path: str, plans: tuple[int, int] | None = None) -> DataFrame:
    """Stored runs, cut to a range of plans if one is given."""
    runs = spark.read.parquet(path)
    if plans is None:
        return runs
    low, high = (F.lit(int(p)).cast("bigint") for p in plans)
    held = runs.where((F.col("first_plan") <= high) & (F.col("last_plan") >= low))
    return held.withColumns({"first_plan": F.greatest("first_plan", low), "last_plan": F.least("last_plan", high)})


def roll_up(runs: DataFrame, values: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Sums of whole-number columns per group over stretches of plans: (by, first_plan, last_plan, n_rows, columns).

    ``values`` holds the columns per unit, and more keys of ``by`` if there are any.  A stretch ends where anything of
    its group changes, and plans in which a group has no unit have none.  The changes are summed before the shuffle; a
    group's running sums pass over one row per plan at which it changes.
    """
    kinds = dict(values.dtypes)
    if other := [c for c in columns if kinds[c] not in ("tinyint", "smallint", "int", "bigint") and not kinds[c].startswith("decimal(")]:
        raise ValueError(f"running differences want whole numbers: {other}")
    met = runs.join(dimension(values), "vtd_geoid")
    ends = F.explode(F.array(F.struct(F.col("first_plan").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("last_plan") + 1).alias("at"), F.lit(-1).alias("sign"))))
    changes = met.select(*by, *columns, ends.alias("e")).groupBy(*by, F.col("e.at").alias("first_plan")).agg(
        F.sum("e.sign").alias("n_rows"), *[F.sum(F.col("e.sign") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns],
        *[F.sum(F.when(F.col(c).isNotNull(), F.col("e.sign"))).alias(f"_n_{c}") for c in columns])
    upward = Window.partitionBy(*by).orderBy("first_plan").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*by).orderBy("first_plan")

    def total(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c), F.lit(0))).over(upward)

    sums = changes.select(*by, "first_plan", (F.lead("first_plan").over(onward) - 1).alias("last_plan"), total("n_rows").alias("n_rows"),
                          *[F.when(total(f"_n_{c}") > 0, total(c)).alias(c) for c in columns])
    return sums.where("n_rows > 0")


def district_demo_vap(runs: DataFrame, units: DataFrame) -> DataFrame:
    """Voting-age counts and shares per district over stretches of plans."""
    counts = ["vap_total", *GROUP_VAP]
    return roll_up(runs, units.select("vtd_geoid", *counts), counts, ["district_id"]).drop("n_rows").withColumns({
        "share_white_vap": share("vap_nh_white", "vap_total"), "share_black_vap": share("vap_nh_black", "vap_total"),
        "share_hisp_vap": share("vap_hisp", "vap_total"), "share_minority_vap": F.lit(1.0) - share("vap_nh_white", "vap_total")})


def district_returns(runs: DataFrame, returns: DataFrame) -> DataFrame:
    """Votes per district and election over stretches of plans, of the units that have a row in the returns."""
    reported = returns.where("election_id is not null").select("vtd_geoid", "election_id", *VOTE_COLUMNS)
    return roll_up(runs, reported, list(VOTE_COLUMNS), ["district_id", "election_id"]).drop("n_rows").withColumn(
        "dem_share", share("votes_dem", "votes_total"))


def units_per_plan(runs: DataFrame) -> DataFrame:
    """Number of assigned units over stretches of plans; the one group has a row per plan with a change at most."""
    units = runs.select("vtd_geoid", "first_plan", "last_plan").withColumn("all", F.lit(0))
    return roll_up(units, units.select("vtd_geoid").distinct(), [], ["all"]).select("first_plan", "last_plan", F.col("n_rows").alias("n_vtd"))


def population_deviation(runs: DataFrame, units: DataFrame, pop: str = "vap_total", epsilon: float = 0.01) -> DataFrame:
    """Ideal population and largest relative deviation of every plan; rows are districts times plans from here on."""
    stretches = roll_up(runs, units.select("vtd_geoid", pop), [pop], ["district_id"])
    return deviation_of(each_plan(stretches).select("plan_no", "district_id", F.col(pop).alias("pop")), "plan_no", epsilon)
