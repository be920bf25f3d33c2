"""Ensembles of plans: chain output, distributions and the place of a plan in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .joins import dimension, salted_join
from .order_stats import distribution, ecdf_positions

# Quantile columns of the distribution table.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50,
             "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}

# metrics that count districts: a handful of distinct values however many plans there are
COUNT_METRICS = ("n_opportunity_districts",)


def _spread(metric: str) -> str:
    return "few" if metric in COUNT_METRICS else "quantile"


def thin_chain(steps: DataFrame, burnin: int, thin: int) -> DataFrame:
    """Kept steps of a chain, with the id of the plan each one becomes.

    Steps run 0, 1, 2 ... in every chain, so the number of a kept plan is
    arithmetic on its step and needs no window over the chain.
    """
    after = F.col("step") - burnin
    number = F.floor(after / F.lit(thin)).cast("bigint") + 1
    return steps.where((after >= 0) & (after % thin == 0)).withColumn(
        "plan_id", F.concat(F.col("ensemble_id"), F.lit("_"), F.format_string("%06d", number)))


def ensemble_plan_ids(plan_map: DataFrame) -> DataFrame:
    return plan_map.select("plan_id").where("plan_id is not null").distinct()


def ensemble_plans(plan_map: DataFrame, ensemble_id: str, cycle: str | None = None,
                   chamber: str | None = None, generator: str = "recom") -> DataFrame:
    """Plan metadata rows for every plan id in an ensemble's map."""
    text = lambda v: F.lit(v).cast("string")
    return ensemble_plan_ids(plan_map).select(
        F.col("plan_id").cast("string").alias("plan_id"), F.lit("ENSEMBLE").alias("plan_type"),
        text(cycle).alias("cycle"), text(chamber).alias("chamber"), F.lit(ensemble_id).alias("ensemble_id"),
        F.lit(generator).alias("generator"), F.lit(None).cast("bigint").alias("seed"),
        text(None).alias("constraints_json"), text(None).alias("created_at"))


def require_ensemble(plans: DataFrame, ensemble_id: str) -> None:
    found = plans.where((F.col("plan_type") == "ENSEMBLE") & (F.col("ensemble_id") == ensemble_id))
    if found.isEmpty():
        sample = [r.asDict() for r in plans.limit(10).collect()]
        raise ValueError(f"no ensemble plans for {ensemble_id!r}; plans present: {sample}")


def metric_values(metrics: DataFrame, plans: DataFrame, metric: str) -> DataFrame:
    """A metric per plan and definition with the plan's type and ensemble; NULL values left out."""
    if metric not in metrics.columns:
        raise ValueError(f"plan metrics lack {metric!r}; columns: {metrics.columns}")
    info = plans.select("plan_id", "plan_type", "ensemble_id")
    return metrics.where(F.col(metric).isNotNull()).select(
        "plan_id", "opp_def_id", F.col(metric).cast("double").alias("metric_value")
    ).join(dimension(info), "plan_id")


def ensemble_draws(metrics: DataFrame, plans: DataFrame, metric: str = "n_opportunity_districts",
                   ensemble_id: str | None = None) -> DataFrame:
    """The metric of every ensemble plan."""
    rows = metric_values(metrics, plans, metric).where(F.col("plan_type") == "ENSEMBLE")
    if ensemble_id is not None:
        rows = rows.where(F.col("ensemble_id") == ensemble_id)
    return rows.select("ensemble_id", "plan_id", "opp_def_id", "metric_value")


def ensemble_distribution(metrics: DataFrame, plans: DataFrame, metric: str = "n_opportunity_districts",
                          ensemble_id: str | None = None, by: tuple[str, ...] = ("opp_def_id",)) -> DataFrame:
    """Count, mean, sd, range and quantiles of a metric over an ensemble.

    ``by=()`` pools the definitions of an ensemble.
    """
    draws = ensemble_draws(metrics, plans, metric, ensemble_id)
    if _spread(metric) == "quantile":                      # read twice: keep the roll-up behind it to one run
        draws = materialize(draws)
    out = distribution(draws, ["ensemble_id", *by], "metric_value", QUANTILES, spread=_spread(metric))
    return out.select("ensemble_id", *by, F.lit(metric).alias("metric_name"), F.col("n").alias("n_plans"),
                      "mean", "sd", *QUANTILES, "min", "max")


def plan_vs_ensemble(metrics: DataFrame, plans: DataFrame, metric: str = "n_opportunity_districts",
                     ensemble_id: str | None = None, by: tuple[str, ...] = ("opp_def_id",)) -> DataFrame:
    """Where each plan that is no ensemble plan falls among the plans of its ensemble.

    The metric rows, one per plan and definition, are stored first: they are
    read several times, and the roll-up behind them should run once.
    """
    rows = metric_values(metrics, plans, metric)
    if ensemble_id is not None:
        rows = rows.where(F.col("ensemble_id") == ensemble_id)
    rows = materialize(rows)
    targets = rows.where(F.col("plan_type") != "ENSEMBLE")
    draws = rows.where(F.col("plan_type") == "ENSEMBLE")
    keys = ["ensemble_id", *by]
    placed = ecdf_positions(targets, draws, keys, "metric_value", spread=_spread(metric))
    v, n = F.col("metric_value"), F.col("n_draws")
    return salted_join(targets, placed, [*keys, "metric_value"]).select(
        "plan_id", "plan_type", "ensemble_id", "opp_def_id", F.lit(metric).alias("metric_name"),
        v.alias("plan_value"), n, F.try_divide("n_le", n).alias("percentile"),
        F.when(F.col("draw_sd") > 0, (v - F.col("draw_mean")) / F.col("draw_sd")).alias("z_score"),
        F.try_divide("n_le", n).alias("tail_prob_low"), F.try_divide("n_ge", n).alias("tail_prob_high"),
        (v - F.col("draw_mean")).alias("delta_from_mean"))


def chain_metadata(deviation: DataFrame, ensemble_id: str, *, epsilon: float, burnin: int, thin: int,
                   n_steps: int, pop_col: str, proposal: str = "recom") -> DataFrame:
    """Constraint record of a chain as JSON text, from the enacted plan's deviation row."""
    return deviation.select(
        F.lit(ensemble_id).alias("ensemble_id"), "plan_id",
        F.to_json(F.struct(
            F.lit(proposal).alias("proposal"), F.lit(float(epsilon)).alias("epsilon_requested"),
            F.col("epsilon_used"), F.col("max_dev").alias("max_dev_enacted"), F.col("ideal_pop"),
            F.col("n_districts"), F.lit(burnin).alias("burnin"), F.lit(thin).alias("thin"),
            F.lit(n_steps).alias("n_steps"), F.lit(pop_col).alias("pop_col"),
        )).alias("constraints_json"))
