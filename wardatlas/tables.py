"""Schemas of the analysis tables and the column checks every loader uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Voting-age population columns by group, in table order.
GROUP_VAP = ("vap_nh_white", "vap_nh_black", "vap_hisp", "vap_nh_asian", "vap_nh_native", "vap_other")
VOTE_COLUMNS = ("votes_total", "votes_dem", "votes_rep", "votes_other")


# Table name -> (key columns, columns with types).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "geo_vtd": (("vtd_geoid",), (
        "vtd_geoid string, state_fips string, county_fips string, county_name string, "
        "area_km2 double, total_pop bigint, vap_total bigint, vap_nh_white bigint, "
        "vap_nh_black bigint, vap_hisp bigint, vap_nh_asian bigint, vap_nh_native bigint, "
        "vap_other bigint")),
    "election": (("election_id",), (
        "election_id string, year int, office string, stage string, notes string")),
    "election_returns_vtd": (("election_id", "vtd_geoid"), (
        "election_id string, vtd_geoid string, votes_total bigint, votes_dem bigint, "
        "votes_rep bigint, votes_other bigint, dem_share double")),
    "plan": (("plan_id",), (
        "plan_id string, plan_type string, cycle string, chamber string, ensemble_id string, "
        "generator string, seed bigint, constraints_json string, created_at string")),
    "plan_district_vtd": (("plan_id", "vtd_geoid"), (
        "plan_id string, vtd_geoid string, district_id string")),
    "opp_def": (("opp_def_id",), (
        "opp_def_id string, group_label string, group_share_col string, threshold double, notes string")),
    "ei_run": (("ei_run_id",), (
        "ei_run_id string, ensemble_id string, election_id string, model_spec_json string, created_at string")),
}


def require_columns(df: DataFrame, columns, what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that are absent, each with its default value or expression."""
    add = {n: (v if hasattr(v, "cast") else F.lit(v)) for n, v in defaults.items() if n not in df.columns}
    return df.withColumns(add) if add else df


def standard_names(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case; two that become equal are an error."""
    names = [c.strip().lower() for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after stripping and lower-casing: {clash}")
    return df.toDF(*names)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's columns in order with their types."""
    columns = [c.split() for c in TABLES[table][1].split(", ")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])
