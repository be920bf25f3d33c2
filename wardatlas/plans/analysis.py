"""Staged analysis: load, sanity, aggregates, metrics, ensemble, ei, export.

Each stage takes the tables so far and returns its own.  With a work folder
every table a stage makes is written there and read back, so later stages
start from stored tables and a single stage can run on its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import ensemble, inference, opportunity, rollup
from ..sources import loaders, writers
from ..storage import materialize

STAGES = ("schema", "load", "sanity", "aggregates", "metrics", "ensemble", "ei", "export")


@dataclass(frozen=True)
class AnalysisConfig:
    geo_vtd: object = None
    elections: object = None
    returns: object = None
    plans: object = None
    plan_map: object = None
    ensemble_plans: object = None
    ensemble_plan_map: object = None
    ensemble_id: str | None = None
    ei_election_id: str | None = None
    ei_run_id: str = "EI_RUN_001"
    replicates: int = 1000
    metric: str = "n_opportunity_districts"
    out_dir: str | None = None
    export_format: str = "parquet"
    work_dir: str | None = None
    definitions: tuple = field(default=opportunity.STANDARD_DEFINITIONS)


Tables = dict[str, DataFrame]


def _need(value, what: str):
    if not value:
        raise ValueError(f"this stage needs {what}")
    return value


def schema(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    return {"opp_def": opportunity.definitions(spark, cfg.definitions)}


def load(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    for name in ("geo_vtd", "elections", "returns", "plans", "plan_map"):
        if getattr(cfg, name) is None:
            raise ValueError(f"stage load needs {name}")
    plans = loaders.load_plan(spark, cfg.plans)
    maps = loaders.load_plan_map(spark, cfg.plan_map)
    if cfg.ensemble_plans is not None:
        plans = loaders.load_plan(spark, cfg.ensemble_plans, plans)
    if cfg.ensemble_plan_map is not None:
        maps = loaders.load_plan_map(spark, cfg.ensemble_plan_map, maps)
    return {"geo_vtd": loaders.load_geo_vtd(spark, cfg.geo_vtd), "election": loaders.load_election(spark, cfg.elections),
            "election_returns_vtd": loaders.load_election_returns(spark, cfg.returns),
            "plan": plans, "plan_district_vtd": maps}


def sanity(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    return {"unit_counts": rollup.check_assignments(t["plan_district_vtd"], t["geo_vtd"])}


def aggregates(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    return {"district_demo_vap": rollup.district_demo_vap(t["plan_district_vtd"], t["geo_vtd"]),
            "district_returns": rollup.district_returns(t["plan_district_vtd"], t["election_returns_vtd"])}


def metrics(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    if t["district_demo_vap"].isEmpty():
        raise ValueError("district_demo_vap is empty; run the aggregates first")
    flags = opportunity.district_opportunity(t["district_demo_vap"], t["opp_def"])
    return {"district_opportunity": flags.drop("share_minority_vap"), "plan_metrics": opportunity.plan_metrics(flags)}


def ensembles(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    eid = _need(cfg.ensemble_id, "an ensemble id")
    ensemble.require_ensemble(t["plan"], eid)
    args = (t["plan_metrics"], t["plan"], cfg.metric, eid)
    return {"ensemble_distribution": ensemble.ensemble_distribution(*args),
            "ensemble_distribution_draws": ensemble.ensemble_draws(*args),
            "plan_vs_ensemble": ensemble.plan_vs_ensemble(*args)}


def ei(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    eid, election = _need(cfg.ensemble_id, "an ensemble id"), _need(cfg.ei_election_id, "an election id")
    rows = inference.design(t["geo_vtd"], t["election_returns_vtd"], election)
    n = rows.count()
    if n == 0:
        raise ValueError("no valid rows remain for the inference")
    draws = materialize(inference.support_draws(rows, cfg.replicates))
    return {"ei_run": inference.ei_run(spark, cfg.ei_run_id, eid, election, n),
            "ei_posterior_group": inference.group_posterior(draws, cfg.ei_run_id),
            "ei_posterior_district": inference.project_ensemble(
                t["district_demo_vap"], t["plan"], draws, cfg.ei_run_id, eid)}


def export(spark: SparkSession, cfg: AnalysisConfig, t: Tables) -> Tables:
    writers.export_outputs(t, _need(cfg.out_dir, "an output folder"), cfg.export_format)
    return {}


_RUN = dict(zip(STAGES, (schema, load, sanity, aggregates, metrics, ensembles, ei, export)))


def stored_tables(spark: SparkSession, work_dir: str) -> Tables:
    """Tables earlier stages left in the work folder."""
    out: Tables = {}
    for name in ("opp_def", "geo_vtd", "election", "election_returns_vtd", "plan", "plan_district_vtd", "unit_counts",
                 "district_demo_vap", "district_returns", "district_opportunity", "plan_metrics", "ensemble_distribution",
                 "ensemble_distribution_draws", "plan_vs_ensemble", "ei_run", "ei_posterior_group", "ei_posterior_district"):
        path = f"{work_dir.rstrip('/')}/{name}.parquet"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            out[name] = spark.read.parquet(path)
    return out


def run(spark: SparkSession, cfg: AnalysisConfig, stage: str = "all", tables: Tables | None = None) -> Tables:
    """One stage, or all in order (export only when an output folder is named)."""
    if stage != "all" and stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; stages: {STAGES}")
    t = dict(tables or {})
    if cfg.work_dir and stage != "all":
        t = {**stored_tables(spark, cfg.work_dir), **t}
    for name in (STAGES if stage == "all" else (stage,)):
        if name == "export" and stage == "all" and not cfg.out_dir:
            continue
        for table, df in _RUN[name](spark, cfg, t).items():
            if cfg.work_dir:
                df = spark.read.parquet(writers.write_parquet(df, f"{cfg.work_dir.rstrip('/')}/{table}.parquet"))
            t[table] = df
    return t
