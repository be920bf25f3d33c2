"""Sufficient statistics: one pass over the rows, one small matrix per group back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


def missing_error(df: DataFrame, cols: list[str], count: int, what: str) -> ValueError:
    """The error for rows with a NULL, NaN or infinite value, with three of them as examples."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & is_finite(F.col(c).cast("double"))
    shown = [tuple(r) for r in df.where(~ok).select(*cols).limit(3).collect()]
    return ValueError(f"{what}: {count} rows have a NULL, NaN or infinite value, for example {shown}")


def require_finite(df: DataFrame, cols: list[str], what: str) -> None:
    """Raise unless every value of the columns is a finite number; one aggregation."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~is_finite(F.col(c).cast("double"))
    count = df.agg(F.count_if(bad)).first()[0]
    if count:
        raise missing_error(df, cols, count, what)


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance matrix, in one native aggregation."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    if row[0] is None:
        raise ValueError("no rows to take moments of")
    mean, cov = np.array(row[: len(cols)], float), np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[len(cols):]):
        cov[i, j] = cov[j, i] = v
    return mean, cov


def grams(df: DataFrame, cols: list[str], group: str | None = None) -> dict[int, np.ndarray]:
    """X'X of the columns per integer group.

    Every task adds its batches to one matrix per group and hands over that
    alone, so what is shuffled depends on the columns and groups, not on rows.
    Rows with a NULL, NaN or infinite value are counted in the same pass, and
    any such row is an error.
    """
    p = len(cols)

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        bad = 0
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            whole = np.isfinite(x).all(axis=1)
            bad += int((~whole).sum())
            x, g = x[whole], pdf["_g"].to_numpy()[whole]
            for key in np.unique(g):
                part = x[g == key]
                acc[int(key)] = acc.get(int(key), 0) + part.T @ part
        for key, m in acc.items():
            yield pd.DataFrame({"g": key, "pos": np.arange(p * p), "v": m.ravel()})
        if bad:
            yield pd.DataFrame({"g": [0], "pos": [-1], "v": [float(bad)]})

    rows = df.select((F.col(group) if group else F.lit(0)).cast("int").alias("_g"),
                     *[F.col(c).cast("double").alias(c) for c in cols])
    sums = rows.mapInPandas(partial, "g int, pos int, v double").groupBy("g", "pos").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():                       # p * p numbers per group
        if r["pos"] < 0:
            raise missing_error(df, cols, int(r["v"]), "cross products")
        out.setdefault(r["g"], np.zeros(p * p))[r["pos"]] = r["v"]
    return {g: v.reshape(p, p) for g, v in out.items()}
