"""Loaders of the analysis tables: column check, defaults, types, key check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null, share, to_count, to_number
from ..operators.keyed import upsert
from ..tables import GROUP_VAP, TABLES, VOTE_COLUMNS, conform, ensure_columns, require_columns
from .readers import read_table

# Fixed value: state code used where a file names none.
STATE_FIPS = "48"


def _rows(spark: SparkSession, source) -> DataFrame:
    return source if isinstance(source, DataFrame) else read_table(spark, source)


def _merged(new: DataFrame, table: str, base: DataFrame | None, check: bool = True) -> DataFrame:
    return upsert(base, conform(new, table), list(TABLES[table][0]), check)


def load_geo_vtd(spark: SparkSession, source, base: DataFrame | None = None) -> DataFrame:
    df = ensure_columns(_rows(spark, source), {"vap_nh_native": 0})
    require_columns(df, ("vtd_geoid", "vap_total", *GROUP_VAP), "geo_vtd")
    none = lambda t: F.lit(None).cast(t)
    df = ensure_columns(df, {
        "state_fips": STATE_FIPS, "county_fips": F.substring(F.col("vtd_geoid").cast("string"), 3, 3),
        "county_name": none("string"), "area_km2": none("double"), "total_pop": none("bigint")})
    df = df.withColumns({
        "state_fips": F.coalesce(F.col("state_fips").cast("string"), F.lit(STATE_FIPS)),
        "area_km2": nan_to_null(F.col("area_km2").cast("double")),
        **{c: to_count(c) for c in ("total_pop", "vap_total", *GROUP_VAP)}})
    return _merged(df, "geo_vtd", base)


def load_election(spark: SparkSession, source, base: DataFrame | None = None) -> DataFrame:
    df = _rows(spark, source)
    require_columns(df, ("election_id", "year", "office", "stage"), "election")
    return _merged(ensure_columns(df, {"notes": F.lit(None).cast("string")}), "election", base)


def load_election_returns(spark: SparkSession, source, base: DataFrame | None = None) -> DataFrame:
    df = _rows(spark, source)
    require_columns(df, ("election_id", "vtd_geoid", "votes_total", "votes_dem", "votes_rep"), "election_returns_vtd")
    df = ensure_columns(df, {"votes_other": 0})
    df = df.withColumns({c: to_number(c) for c in VOTE_COLUMNS})
    df = df.withColumn("dem_share", share("votes_dem", "votes_total"))
    return _merged(df.withColumns({c: to_count(c) for c in VOTE_COLUMNS}), "election_returns_vtd", base)


def load_plan(spark: SparkSession, source, base: DataFrame | None = None) -> DataFrame:
    df = _rows(spark, source)
    require_columns(df, ("plan_id", "plan_type", "cycle", "chamber", "ensemble_id"), "plan")
    none = lambda t: F.lit(None).cast(t)
    df = ensure_columns(df, {"generator": none("string"), "seed": none("bigint"),
                             "constraints_json": none("string"), "created_at": none("string")})
    return _merged(df.withColumn("seed", to_count("seed")), "plan", base)


def load_plan_map(spark: SparkSession, source, base: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Assignments; ``check=False`` skips the key check of a map whose writer guarantees it."""
    df = _rows(spark, source)
    require_columns(df, ("plan_id", "vtd_geoid", "district_id"), "plan_district_vtd")
    return _merged(df, "plan_district_vtd", base, check)


def read_enacted_map(spark: SparkSession, source, unit: str = "vtd_geoid", district: str = "district_id") -> DataFrame:
    """Enacted assignment as text ids; a column ``district`` serves for ``district_id``."""
    df = _rows(spark, source)
    if district not in df.columns and district == "district_id" and "district" in df.columns:
        district = "district"
    require_columns(df, (unit, district), "enacted plan map")
    return df.select(F.col(unit).cast("string").alias("vtd_geoid"), F.col(district).cast("string").alias("district_id"))
