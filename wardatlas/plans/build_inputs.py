"""Input build: raw files to the processed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_number, vtd_geoid, zfill
from ..operators import elections, overlay
from ..operators.keyed import assert_none, assert_unique, checked_join
from ..sources import writers
from ..sources.readers import decode_geometry, read_table
from ..storage import materialize
from ..tables import require_columns, standard_names

# Names a column may carry, first match wins.
GEOID_NAMES = ("geoid20", "geoid", "tabblock20", "block_geoid", "block_geoid20", "geoid_20")
UNIT_GEOID_NAMES = ("geoid20", "geoid", "vtdgeoid", "vtd_geoid", "geoid_20")
DISTRICT_NAMES = ("district", "district_id", "dist", "dist_id", "districtnum", "district_n", "cd", "cd116", "cd118")
GROUP_NAMES = {"vap_nh_white": ("anglovap",), "vap_nh_black": ("blackvap",),
               "vap_hisp": ("hispvap", "hispanicvap"), "vap_nh_asian": ("asianvap",)}
BLOCK_NAMES = ("blk", "block")


@dataclass(frozen=True)
class InputConfig:
    """Paths (or DataFrames) and labels of one input build."""
    districts: object
    census_blocks: object
    vtds: object
    pl94: object
    elections: object
    processed_dir: str | None
    plan_id: str
    ensemble_id: str
    cycle: str
    chamber: str
    election_id: str
    election_year: int
    election_office: str
    election_stage: str
    office_filter: str | None = None
    allow_total_only: bool = False                      # block attributes may lack the population groups


def first_present(df: DataFrame, names) -> str | None:
    return next((n for n in names if n in df.columns), None)


def with_geoid20(df: DataFrame) -> DataFrame:
    """Block id as 15-digit text, from an id column or from state, county, tract and block."""
    df = standard_names(df)
    name = first_present(df, GEOID_NAMES)
    if name:
        df = df if name == "geoid20" else df.withColumnRenamed(name, "geoid20")
        return df.withColumn("geoid20", zfill(F.trim(F.col("geoid20").cast("string")), 15))
    block = first_present(df, BLOCK_NAMES)
    if block and {"state", "fips", "trt"} <= set(df.columns):
        part = lambda c, n: zfill(F.trim(F.col(c).cast("string")), n)
        state = zfill(F.coalesce(to_number("state").cast("bigint"), F.lit(0)), 2)
        return df.withColumn("geoid20", zfill(F.concat(state, part("fips", 3), part("trt", 6), part(block, 4)), 15))
    raise ValueError("no block id: neither a GEOID column nor state, fips, trt and blk")


def group_columns(df: DataFrame, allow_total_only: bool = False) -> tuple[str, dict[str, str]]:
    """Total column and the source column of each population group."""
    require_columns(df, ("vap",), "block attributes")
    found = {out: first_present(df, names) for out, names in GROUP_NAMES.items()}
    missing = [out for out, c in found.items() if c is None]
    if missing and not allow_total_only:
        raise ValueError(f"block attributes lack the groups {missing}")
    return "vap", {} if missing else found


def with_unit_keys(vtds: DataFrame) -> DataFrame:
    """Units with text id and numeric join key; an unreadable key is an error."""
    vtds = standard_names(vtds)
    ready = first_present(vtds, UNIT_GEOID_NAMES)
    require_columns(vtds, ("vtdkey",) if ready else ("cntykey", "vtdkey"), "units")
    key = F.trim(F.col(ready).cast("string")) if ready else vtd_geoid("cntykey", "vtdkey")
    out = vtds.withColumns({"vtd_geoid": key, "_key": to_number("vtdkey").cast("bigint")})
    assert_none(out, F.col("vtd_geoid").isNull() | F.col("_key").isNull(), "units with an unreadable key", ["vtdkey"])
    assert_unique(out, ["vtd_geoid"], "units")
    return out.drop("vtdkey").withColumnRenamed("_key", "vtdkey")


def assign_districts(units: DataFrame, districts: DataFrame, plan_id: str) -> DataFrame:
    """Plan map by largest overlap."""
    districts = standard_names(districts)
    name = first_present(districts, DISTRICT_NAMES)
    if name is None:
        raise ValueError(f"no district id column; columns: {districts.columns}")
    named = districts.select(F.col(name).cast("string").alias("district_id"), "rings")
    pairs = materialize(overlay.overlay_polygons(units, named, "vtd_geoid", "district_id"))
    best = overlay.assign_by_area(units.select("vtd_geoid"), pairs, "vtd_geoid", "district_id")
    return best.select(F.lit(plan_id).alias("plan_id"), "vtd_geoid", "district_id")


def unit_population(units: DataFrame, blocks: DataFrame, pl: DataFrame, allow_total_only: bool = False) -> DataFrame:
    """Block counts spread over units by area."""
    blocks, pl = with_geoid20(blocks), with_geoid20(pl)
    total, groups = group_columns(pl, allow_total_only)
    pairs = materialize(overlay.overlay_polygons(blocks, units, "geoid20", "vtd_geoid"))
    if pairs.isEmpty():
        raise ValueError("the overlay of blocks and units has no intersection")
    out = overlay.unit_demographics(blocks, pl, pairs, units, "vtd_geoid", total, groups)
    return out.withColumn("state_fips", F.lit("48"))


def build_inputs(spark: SparkSession, cfg: InputConfig) -> dict[str, DataFrame]:
    """All processed tables; written below ``processed_dir`` when one is given."""
    def raw(source) -> DataFrame:
        return decode_geometry(standard_names(source if isinstance(source, DataFrame) else read_table(spark, source)))

    units = with_unit_keys(raw(cfg.vtds))
    wide = elections.clean_returns(raw(cfg.elections), cfg.office_filter)
    if "vtdkey" not in wide.columns:
        raise ValueError("the election file has no vtdkey")
    geo = unit_population(units, raw(cfg.census_blocks), raw(cfg.pl94), cfg.allow_total_only)
    tables = {
        "election_returns_vtd": elections.returns_by_unit(units, wide, cfg.election_id),
        "plan_district_vtd": assign_districts(units, raw(cfg.districts), cfg.plan_id),
        "geo_vtd": geo,
        "elections": writers.election_row(spark, cfg.election_id, cfg.election_year, cfg.election_office, cfg.election_stage),
        "plans": writers.enacted_plan_row(spark, cfg.plan_id, cfg.cycle, cfg.chamber, cfg.ensemble_id),
    }
    if cfg.processed_dir:
        out = cfg.processed_dir.rstrip("/")
        for name, df in tables.items():
            tables[name] = spark.read.parquet(writers.write_parquet(df, f"{out}/{name}.parquet"))
    tables["vtds_geo"] = checked_join(units.select("vtd_geoid", "vtdkey", "rings"), tables["geo_vtd"], ["vtd_geoid"], "left", "1:1")
    if cfg.processed_dir:
        tables["vtds_geo"] = spark.read.parquet(writers.write_geo(tables["vtds_geo"], f"{out}/geospatial/vtds.parquet"))
    return tables


def district_features(demo: DataFrame, returns: DataFrame, shapes: DataFrame) -> DataFrame:
    """Feature row per district of one plan: compactness, group shares, party shares."""
    by_group = demo.select("district_id", F.col("share_white_vap").alias("pct_white"), F.col("share_black_vap").alias("pct_black"),
                           F.try_divide("vap_nh_asian", "vap_total").alias("pct_asian"), F.col("share_hisp_vap").alias("pct_hispanic"))
    by_party = returns.select("district_id", "dem_share", F.try_divide("votes_rep", "votes_total").alias("rep_share"))
    shape = overlay.compactness(shapes, "district_id").drop("area", "perimeter")
    return shape.join(by_group, "district_id").join(by_party, "district_id", "left").select(
        "district_id", "polsby_popper", "schwartzberg", "convex_hull_ratio", "reock", "pct_white", "pct_black",
        "pct_asian", "pct_hispanic", "dem_share", "rep_share")
