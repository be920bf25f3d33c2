"""Unit tables rolled up to the districts of every plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import share
from ..tables import GROUP_VAP, VOTE_COLUMNS
from .joins import dimension
from .keyed import orphan_rows


def district_demo_vap(plan_map: DataFrame, units: DataFrame) -> DataFrame:
    """Voting-age counts and shares per (plan, district).

    The unit table is broadcast when its counted size allows, so the plan map
    is never shuffled before its partial sums; the exchange then carries one
    row per district and task.
    """
    counts = ("vap_total", *GROUP_VAP)
    joined = plan_map.select("plan_id", "district_id", "vtd_geoid").join(
        dimension(units.select("vtd_geoid", *counts)), "vtd_geoid")
    out = joined.groupBy("plan_id", "district_id").agg(*[F.sum(c).alias(c) for c in counts])
    return out.withColumns({
        "share_white_vap": share("vap_nh_white", "vap_total"),
        "share_black_vap": share("vap_nh_black", "vap_total"),
        "share_hisp_vap": share("vap_hisp", "vap_total"),
        "share_minority_vap": F.lit(1.0) - share("vap_nh_white", "vap_total"),
    })


def _map_with_returns(plan_map: DataFrame, returns: DataFrame) -> DataFrame:
    reported = returns.where(F.col("election_id").isNotNull()).select("vtd_geoid", "election_id", *VOTE_COLUMNS)
    return plan_map.select("plan_id", "district_id", "vtd_geoid").join(dimension(reported), "vtd_geoid")


def district_returns(plan_map: DataFrame, returns: DataFrame) -> DataFrame:
    """Votes per (plan, district, election) over the units that have a row in the returns."""
    out = _map_with_returns(plan_map, returns).groupBy("plan_id", "district_id", "election_id").agg(
        *[F.sum(c).alias(c) for c in VOTE_COLUMNS])
    return out.withColumn("dem_share", share("votes_dem", "votes_total"))


def returns_coverage(plan_map: DataFrame, returns: DataFrame) -> DataFrame:
    """Units assigned and units with votes per (plan, district, election)."""
    out = _map_with_returns(plan_map, returns).groupBy("plan_id", "district_id", "election_id").agg(
        F.count(F.lit(1)).alias("n_vtd_assigned"), F.count("votes_total").alias("n_vtd_with_returns"))
    return out.withColumn("coverage", F.try_divide("n_vtd_with_returns", "n_vtd_assigned"))


def units_per_plan(plan_map: DataFrame) -> DataFrame:
    return plan_map.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_vtd"))


def unit_count_range(plan_map: DataFrame) -> DataFrame:
    """Smallest and largest unit count over the plans and whether they differ."""
    return units_per_plan(plan_map).agg(
        F.count(F.lit(1)).alias("n_plans"), F.min("n_vtd").alias("min_vtd"), F.max("n_vtd").alias("max_vtd"),
    ).withColumn("uneven", F.col("min_vtd") != F.col("max_vtd"))


def check_assignments(plan_map: DataFrame, units: DataFrame) -> DataFrame:
    """Raise on unknown units or an empty map; return the unit count range."""
    n = orphan_rows(plan_map, units).count()
    if n:
        raise ValueError(f"{n} assignment rows name units that are not in the unit table")
    counts = unit_count_range(plan_map)
    if counts.first()["n_plans"] == 0:
        raise ValueError("the plan map is empty")
    return counts


def population_deviation(plan_map: DataFrame, units: DataFrame, pop: str = "vap_total",
                         epsilon: float = 0.01) -> DataFrame:
    """Ideal population and largest relative deviation per plan, and the tolerance that admits it.

    A plan beyond the asked tolerance relaxes it to its own deviation + 1e-6.
    """
    by_district = plan_map.select("plan_id", "district_id", "vtd_geoid").join(
        dimension(units.select("vtd_geoid", pop)), "vtd_geoid"
    ).groupBy("plan_id", "district_id").agg(F.sum(pop).alias("pop"))
    return deviation_of(by_district, "plan_id", epsilon)


def deviation_of(by_district: DataFrame, plan: str, epsilon: float = 0.01) -> DataFrame:
    """The same from the population ``pop`` of every district of every plan."""
    # |p - ideal| is largest at the smallest or the largest district
    per_plan = by_district.groupBy(plan).agg(
        F.count(F.lit(1)).alias("n_districts"), F.sum("pop").alias("total_pop"),
        F.min("pop").alias("_low"), F.max("pop").alias("_high"))
    ideal = F.col("total_pop") / F.col("n_districts")
    return per_plan.select(
        plan, "n_districts", "total_pop", ideal.alias("ideal_pop"),
        F.when(ideal > 0, F.greatest(F.col("_high") - ideal, ideal - F.col("_low")) / ideal).alias("max_dev"),
    ).withColumn("epsilon_used", F.when(F.col("max_dev") > epsilon, F.col("max_dev") + 1e-6).otherwise(F.lit(epsilon)))
