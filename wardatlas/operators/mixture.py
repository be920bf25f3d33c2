"""Two-component mixture on a compactness index: membership of the less compact component."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import sized_join


def low_component_membership(df: DataFrame, value: str, seed: int = 42) -> DataFrame:
    """Probability of the component with the lower mean, and its 0.5 flag."""
    rows = df.withColumn("_v", array_to_vector(F.array(F.col(value).cast("double"))))
    model = GaussianMixture(k=2, seed=seed, featuresCol="_v", predictionCol="_c", probabilityCol="_p", tol=1e-6,
                            maxIter=200).fit(rows.select("_v"))
    means = [g.mean[0] for g in model.gaussians]
    low = means.index(min(means))
    return flag(model.transform(rows).withColumn("post_prob", vector_to_array("_p")[low]).drop("_v", "_c", "_p"))


def membership_from_draws(z: DataFrame, means: DataFrame, unit: str, iteration: str = "iter") -> DataFrame:
    """Share of draws that put a unit in the low component.

    ``z``: unit, iteration, component 1 or 0; ``means``: iteration, mu_1, mu_2.
    The low component is named per iteration, so label switching cancels.
    """
    low = means.select(iteration, F.when(F.col("mu_1") < F.col("mu_2"), 1).otherwise(0).alias("_low"))
    out = sized_join(z, low, [iteration]).groupBy(unit).agg(
        F.avg(F.when(F.col("component") == F.col("_low"), 1.0).otherwise(0.0)).alias("post_prob"))
    return flag(out)


def flag(df: DataFrame) -> DataFrame:
    return df.withColumn("low_cluster", (F.col("post_prob") >= 0.5).cast("int"))


def most_likely(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Top units by membership probability."""
    return df.orderBy(F.desc("post_prob"), key).limit(n)
