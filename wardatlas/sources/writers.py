"""Sinks: parquet and CSV tables, plan maps, one-row metadata, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import TABLES
from .readers import wkb_from_rings

# Result tables an export offers, in order.
EXPORTED = ("district_demo_vap", "district_returns", "district_opportunity", "plan_metrics", "ensemble_distribution",
            "plan_vs_ensemble", "ei_run", "ei_posterior_group", "ei_posterior_district")


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_plan_map(df: DataFrame, path: str, mode: str = "append") -> str:
    """Assignment rows as zstd parquet by ensemble, so a reader of one ensemble skips the others.

    Each ensemble is written by as many tasks as hold its rows; nothing is
    brought together per ensemble.
    """
    cols = [F.col(c).cast("string").alias(c) for c in ("plan_id", "vtd_geoid", "district_id")]
    df.select("ensemble_id", *cols).write.mode(mode).option("compression", "zstd").partitionBy("ensemble_id").parquet(path)
    return path


def write_geo(df: DataFrame, path: str, required: tuple[str, ...] = ("rings", "vap_total")) -> str:
    """Units with geometry and population; a unit without either is an error.

    Beside ``rings`` the table holds the outline as WKB in ``geometry``, which other tools read.
    """
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first().asDict()
    if any(missing.values()):
        raise ValueError(f"units without a value: {missing}")
    return write_parquet(df.withColumn("geometry", wkb_from_rings("rings")), path)


def export_table(df: DataFrame, name: str, out_dir: str, fmt: str = "parquet") -> str:
    path = f"{out_dir.rstrip('/')}/{name}.{fmt}"
    if fmt == "parquet":
        return write_parquet(df, path)
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
        return path
    raise ValueError(f"unknown export format: {fmt}")


def export_outputs(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """Write the result tables that exist and hold rows."""
    return [export_table(tables[n], n, out_dir, fmt)
            for n in EXPORTED if tables.get(n) is not None and not tables[n].isEmpty()]


def write_artifact(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Metrics or summaries as JSON lines or CSV."""
    writer = df.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)
    return path


def election_row(spark: SparkSession, election_id: str, year: int, office: str, stage: str, notes: str = "") -> DataFrame:
    return spark.createDataFrame([(election_id, int(year), office, stage, notes or None)], TABLES["election"][1])


def enacted_plan_row(spark: SparkSession, plan_id: str, cycle: str, chamber: str, ensemble_id: str) -> DataFrame:
    return spark.createDataFrame(
        [(plan_id, "ENACTED", cycle, chamber, ensemble_id, "enacted", None, None, None)], TABLES["plan"][1])
