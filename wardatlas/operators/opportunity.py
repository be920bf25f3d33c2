"""Opportunity districts and the plan metrics built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import sized_join

# The standard definitions, a share of at least one half.
STANDARD_DEFINITIONS = (
    ("BVAP50", "BLACK", "share_black_vap", 0.50),
    ("HVAP50", "HISP", "share_hisp_vap", 0.50),
    ("MINVAP50", "MINORITY", "share_minority_vap", 0.50),
)


def definitions(spark: SparkSession, rows=STANDARD_DEFINITIONS) -> DataFrame:
    """Opportunity definitions as a table: id, group, share column, threshold."""
    return spark.createDataFrame(
        [(i, g, c, float(t), None) for i, g, c, t in rows],
        "opp_def_id string, group_label string, group_share_col string, threshold double, notes string")


def district_opportunity(demo: DataFrame, opp_def: DataFrame) -> DataFrame:
    """Value and flag per (plan, district, definition).

    The share columns a definition may name become rows and meet the
    definitions on the column name.  ``share_minority_vap`` is kept for the
    plan metrics.  A NULL share is no opportunity.
    """
    shares = [c for c in demo.columns if c.startswith("share_")]
    unknown = [r[0] for r in opp_def.where(~F.col("group_share_col").isin(shares))
               .select("group_share_col").distinct().limit(10).collect()]
    if unknown:
        raise ValueError(f"definitions name share columns that the district table lacks: {unknown}")
    tall = demo.select(
        "plan_id", "district_id", "share_minority_vap",
        F.explode(F.array(*[F.struct(F.lit(c).alias("group_share_col"), F.col(c).alias("opp_value"))
                            for c in shares])).alias("s"),
    ).select("plan_id", "district_id", "share_minority_vap", "s.*")
    # four share names serve as keys, so a definition table too large to broadcast meets them salted
    out = sized_join(tall, opp_def.select("opp_def_id", "group_share_col", "threshold"), ["group_share_col"])
    return out.select(
        "plan_id", "district_id", "opp_def_id", "opp_value",
        F.coalesce(F.col("opp_value") >= F.col("threshold"), F.lit(False)).alias("is_opportunity"),
        "share_minority_vap",
    )


def plan_metrics(opportunity: DataFrame, demo: DataFrame | None = None) -> DataFrame:
    """Opportunity districts and mean minority share per (plan, definition).

    A stored opportunity table without the minority share takes it from the
    district table; the fresh one carries it and needs no join.
    """
    if "share_minority_vap" not in opportunity.columns:
        opportunity = opportunity.join(
            demo.select("plan_id", "district_id", "share_minority_vap"), ["plan_id", "district_id"])
    return opportunity.groupBy("plan_id", "opp_def_id").agg(
        F.count_if("is_opportunity").alias("n_opportunity_districts"),
        F.avg("share_minority_vap").alias("mean_minority_share"),
    )
