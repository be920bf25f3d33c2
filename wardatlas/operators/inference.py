"""Ecological inference: design rows, group support with bootstrap draws, projection, posterior tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, is_finite, normalize_row, timestamp_text
from ..storage import materialize
from ..tables import GROUP_VAP
from .joins import dimension, has_more_rows
from .moments import require_finite
from .order_stats import distribution, ranked_values

# Population groups, in the order of GROUP_VAP.
GROUPS = ("WHITE_NH", "BLACK_NH", "HISP", "ASIAN_NH", "NATIVE_NH", "OTHER")


def design(units: DataFrame, returns: DataFrame, election_id: str) -> DataFrame:
    """Valid binomial rows of one election with group shares that sum to one."""
    votes = returns.where(F.col("election_id") == election_id).select(
        "vtd_geoid", *[F.col(c).try_cast("double").alias(c) for c in ("votes_total", "votes_dem")])
    rows = units.select("vtd_geoid", *[F.col(c).try_cast("double").alias(c) for c in ("vap_total", *GROUP_VAP)]).join(
        votes, "vtd_geoid")
    n, y = F.rint("votes_total"), F.rint("votes_dem")
    valid = is_finite("votes_total") & (F.col("votes_total") > 0) & is_finite("votes_dem") & (y >= 0) & (y <= n)
    valid = valid & is_finite("vap_total") & (F.col("vap_total") > 0)
    for c in GROUP_VAP:
        valid = valid & (F.col(c).isNull() | is_finite(c))
    # the counts are scaled by their own sum, so dividing them by vap_total first would change nothing
    counts = [F.coalesce(c, F.lit(0.0)) for c in GROUP_VAP]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return rows.where(valid).select(
        "vtd_geoid", n.cast("bigint").alias("votes_total"), y.cast("bigint").alias("votes_dem"),
        *[F.when(total > 0, c / total).otherwise(0.0).alias(g) for c, g in zip(counts, GROUPS)])


def normal_equations(rows: DataFrame, groups=GROUPS) -> DataFrame:
    """Vote-weighted X'WX and X'Wy of the design, one row per matrix entry."""
    g, w = list(groups), F.col("votes_total")
    y = F.col("votes_dem") / w
    sums = {f"{a}|{b}": F.sum(w * F.col(a) * F.col(b)) for i, a in enumerate(g) for b in g[i:]}
    sums |= {f"{a}|y": F.sum(w * F.col(a) * y) for a in g}
    row = rows.agg(*[e.alias(n) for n, e in sums.items()])
    cell = [F.struct(F.lit(n.split("|")[0]).alias("row_term"), F.lit(n.split("|")[1]).alias("col_term"),
                     F.col(f"`{n}`").alias("value")) for n in sums]
    return row.select(F.explode(F.array(*cell)).alias("c")).select("c.*")


def _poisson_weights(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in each replicate, fixed by the row's hash."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (
            np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed))[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    u = (z >> np.uint64(11)).astype(float) / float(1 << 53)
    terms, cdf = np.exp(-1.0), []
    for k in range(1, 18):
        cdf.append(terms if not cdf else cdf[-1] + terms)
        terms /= k
    return np.searchsorted(np.array(cdf), u, side="right").astype(float)


def support_draws(rows: DataFrame, replicates: int = 1000, seed: int = 0, groups=GROUPS,
                  key: str = "vtd_geoid") -> DataFrame:
    """Group support by vote-weighted ecological regression, one draw per bootstrap replicate.

    Draw 0 is the estimate itself.  A row's weight in a replicate comes from a
    hash of its key, so a lost task repeats itself exactly.  Tasks hand over
    one small system per replicate; each system is solved where it is summed.
    Wide output: ``draw_id`` and one column per group, within 0..1.
    """
    g, p = list(groups), len(groups)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    width = len(upper) + p

    def partial(batches):
        acc = np.zeros((replicates + 1, width))
        for pdf in batches:
            x, n = pdf[g].to_numpy(float), pdf["votes_total"].to_numpy(float)
            bad = ~(np.isfinite(x).all(axis=1) & np.isfinite(n) & (n > 0) & np.isfinite(pdf["votes_dem"].to_numpy(float)))
            if bad.any():                                   # a partial sum with NaN would be lost without a trace
                raise ValueError(f"support draws: {int(bad.sum())} rows have a NULL, NaN or infinite value, "
                                 f"for example {pdf[bad].head(3).to_dict('records')}")
            y = pdf["votes_dem"].to_numpy(float) / n
            terms = np.column_stack([n * x[:, i] * x[:, j] for i, j in upper] + [n * x[:, i] * y for i in range(p)])
            step = max(1, 2_000_000 // (replicates + 1))
            for k in range(0, len(x), step):
                w = np.column_stack([np.ones(len(x[k:k + step])),
                                     _poisson_weights(pdf["_h"].to_numpy()[k:k + step], replicates, seed)])
                acc += w.T @ terms[k:k + step]
        yield pd.DataFrame({"draw_id": np.arange(replicates + 1), "terms": list(acc)})

    def solve(batches):
        for pdf in batches:
            out = []
            for t in pdf["terms"]:
                t, a = np.asarray(t, float), np.zeros((p, p))
                for v, (i, j) in zip(t, upper):
                    a[i, j] = a[j, i] = v
                out.append(np.clip(np.linalg.lstsq(a, t[len(upper):], rcond=None)[0], 0.0, 1.0))
            yield pd.DataFrame(np.array(out).reshape(-1, p), columns=g).assign(draw_id=pdf["draw_id"].to_numpy())[["draw_id", *g]]

    ready = rows.select(F.xxhash64(key).alias("_h"), "votes_total", "votes_dem", *g)
    sums = ready.mapInPandas(partial, "draw_id bigint, terms array<double>").groupBy("draw_id").agg(
        F.array(*[F.sum(F.col("terms")[i]) for i in range(width)]).alias("terms"))
    return sums.mapInPandas(solve, "draw_id bigint, " + ", ".join(f"{c} double" for c in g))


def ei_run(spark, ei_run_id: str, ensemble_id: str, election_id: str, n_obs: int, groups=GROUPS) -> DataFrame:
    """One-row record of a run with its specification as JSON."""
    spec = F.to_json(F.struct(
        F.lit("weighted_ecological_regression").alias("model"), F.lit(election_id).alias("election_id"),
        F.array(*[F.lit(g) for g in groups]).alias("groups"), F.lit(n_obs).alias("n_obs")))
    return spark.range(1).select(
        F.lit(ei_run_id).alias("ei_run_id"), F.lit(ensemble_id).alias("ensemble_id"),
        F.lit(election_id).alias("election_id"), spec.alias("model_spec_json"), timestamp_text().alias("created_at"))


def group_posterior(draws: DataFrame, ei_run_id: str, groups=GROUPS, param: str = "support_dem") -> DataFrame:
    """Mean, sd and 5/50/95 % quantiles of each group's draws."""
    cell = F.explode(F.array(*[F.struct(F.lit(g).alias("group_id"), F.col(g).alias("value")) for g in groups]))
    tall = draws.select(cell.alias("c")).select("c.*")
    out = distribution(tall, ["group_id"], "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return out.select(F.lit(ei_run_id).alias("ei_run_id"), "group_id", F.lit(param).alias("param_name"),
                      "mean", "sd", "q05", "q50", "q95")


def district_composition(demo: DataFrame, groups=GROUPS, residual_split: bool = False) -> DataFrame:
    """Group shares per district, scaled to sum one.

    The share left after the black and hispanic ones stands for each of the
    three remaining groups in full; ``residual_split`` gives each a third.
    """
    rest = clip(F.col("share_minority_vap") - F.col("share_black_vap") - F.col("share_hisp_vap"), 0.0, 1.0)
    rest = rest / 3 if residual_split else rest
    source = {"WHITE_NH": F.col("share_white_vap"), "BLACK_NH": F.col("share_black_vap"), "HISP": F.col("share_hisp_vap")}
    shares = demo.select("plan_id", "district_id", *[source.get(g, rest).alias(g) for g in groups])
    return shares.select("plan_id", "district_id",
                         *[e.alias(g) for e, g in zip(normalize_row(list(groups), keep_when_zero=True), groups)])


DRAW_LIMIT = 1_000_000                                   # Fixed value: draws a task holds (x 6 groups = 48 MB)


def project_draws(composition: DataFrame, draws: DataFrame, groups=GROUPS,
                  dem_is_minority_preferred: bool = True, draw_limit: int = DRAW_LIMIT) -> DataFrame:
    """Predicted share and win probability per district over all draws.

    The draw matrix is counted first.  Within ``draw_limit`` every task holds
    it and multiplies its districts against it a slice at a time, so nothing
    is shuffled.  Beyond, draws and districts meet block by block and the
    quantiles come from the distributed ranking; both ways are exact.  A draw
    with a NULL, NaN or infinite support is an error in either.
    """
    require_finite(draws, list(groups), "draws")
    if has_more_rows(draws, draw_limit):
        out = _project_blocks(composition, draws, list(groups))
    else:
        out = _project_held(composition, draws, list(groups))
    win = F.col("win") if dem_is_minority_preferred else F.lit(1.0) - F.col("win")
    return out.select("plan_id", "district_id", win.alias("minority_preferred_win_prob"),
                      "dem_share_pred_mean", "dem_share_pred_q05", "dem_share_pred_q95")


def _project_held(composition: DataFrame, draws: DataFrame, g: list[str]) -> DataFrame:
    matrix = draws.select(*g).toPandas().to_numpy(float).T          # counted by the caller
    held = composition.sparkSession.sparkContext.broadcast(matrix)
    rows = max(1, 4_000_000 // max(1, matrix.shape[1]))

    def run(batches):
        m = held.value
        for pdf in batches:
            for i in range(0, len(pdf), rows):
                part = pdf.iloc[i:i + rows]
                p = part[g].to_numpy(float) @ m
                q = np.quantile(p, [0.05, 0.95], axis=1)
                yield pd.DataFrame({
                    "plan_id": part["plan_id"].to_numpy(), "district_id": part["district_id"].to_numpy(),
                    "win": (p > 0.5).mean(axis=1), "dem_share_pred_mean": p.mean(axis=1),
                    "dem_share_pred_q05": q[0], "dem_share_pred_q95": q[1]})

    # little data, much work per row: keep it on as many tasks as a shuffle has
    parts = int(composition.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return composition.repartition(parts, "plan_id", "district_id").mapInPandas(run, "plan_id string, district_id string, win double, dem_share_pred_mean double, "
                                        "dem_share_pred_q05 double, dem_share_pred_q95 double")


_RANGES = 512                                            # Fixed value: ranges a district's draws are counted in


def _project_blocks(composition: DataFrame, draws: DataFrame, g: list[str], block_rows: int = 4096) -> DataFrame:
    """The same for more draws than a task holds: blocks of draws meet blocks of districts, by hash of the keys.

    Values never leave their task as rows.  A first pass takes range, sum and
    wins of every district, a second counts values in equal ranges of it, and a
    third hands over only the values of the ranges that hold a wanted rank.
    What is shuffled grows with districts x ranges, and with draws only through
    the two or three ranges that are looked into.
    """
    keys = ["plan_id", "district_id"]
    blocks, chunks = (max(1, -(-df.count() // block_rows)) for df in (draws, composition))
    kinds = ", ".join(f"{k} {dict(composition.dtypes)[k]}" for k in keys)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = draws.select(F.pmod(F.xxhash64("draw_id"), F.lit(blocks)).cast("int").alias("_b"), every(chunks, "_c"), *g)

    def over(rows: DataFrame, each, schema: str) -> DataFrame:
        """``each`` turns one district's values of one block into a frame without keys."""
        names = [c.strip().split(" ")[0] for c in f"{kinds}, {schema}".split(",")]

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            m, made = right.sort_values(g)[g].to_numpy(float).T, []
            if m.shape[1]:
                for row in left.itertuples(index=False):
                    p = np.zeros(m.shape[1])
                    for i, c in enumerate(g):               # one order of additions, whatever the batch
                        p += getattr(row, c) * m[i]
                    found = each(row, p)
                    for k in keys:
                        found.insert(0, k, getattr(row, k))
                    made.append(found)
            return pd.concat(made)[names] if made else pd.DataFrame({n: [] for n in names})

        mine = rows.select("*", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int").alias("_c"), every(blocks, "_b"))
        return mine.groupBy("_b", "_c").cogroup(part.groupBy("_b", "_c")).applyInPandas(run, f"{kinds}, {schema}")

    def extent(row, p):
        return pd.DataFrame({"lo": [p.min()], "hi": [p.max()], "total": [p.sum()], "above": [int((p > 0.5).sum())], "n": [len(p)]})

    def place(row, p):
        wide = row.hi - row.lo
        return np.minimum((p - row.lo) / wide * _RANGES, _RANGES - 1).astype(int) if wide > 0 else np.zeros(len(p), int)

    def counts(row, p):
        n = np.bincount(place(row, p), minlength=_RANGES)
        return pd.DataFrame({"r": np.flatnonzero(n), "cnt": n[n > 0]})

    def wanted(row, p):
        value, cnt = np.unique(p[np.isin(place(row, p), row.wanted)], return_counts=True)
        return pd.DataFrame({"value": value, "cnt": cnt}) if len(value) else pd.DataFrame({"value": np.zeros(0), "cnt": np.zeros(0, int)})

    whole = F.lit(True)
    for c in g:
        whole = whole & is_finite(c)
    rows = composition.where(whole)                         # a district without people has no shares
    spans = materialize(over(rows, extent, "lo double, hi double, total double, above bigint, n bigint").groupBy(*keys).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("above").alias("above"), F.sum("n").alias("n")))
    sized = materialize(rows.join(spans, keys))
    ranges = over(sized, counts, "r int, cnt bigint").groupBy(*keys, "r").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)          # at most _RANGES rows
    probs = {"q05": 0.05, "q95": 0.95}
    at = {f"{side}_{q}": f(F.lit(v) * (F.col("n") - 1)) for q, v in probs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    below = ranges.withColumn("below", F.coalesce(F.sum("cnt").over(w), F.lit(0))).join(spans.select(*keys, "n"), keys)
    hit = F.lit(False)
    for pos in at.values():
        hit = hit | ((F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt")))
    looked = materialize(below.where(hit))
    chosen = looked.groupBy(*keys).agg(F.sort_array(F.collect_set("r")).alias("wanted"))
    values = over(sized.join(chosen, keys), wanted, "value double, cnt bigint").groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))
    first = spans.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    r = F.when(F.col("_hi") > F.col("_lo"), F.least((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _RANGES, F.lit(_RANGES - 1.0)).cast("int")).otherwise(0)
    inside = Window.partitionBy(*keys, "r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.join(first, keys).withColumn("r", r).join(looked.select(*keys, "r", "below", "n"), [*keys, "r"]).withColumn(
        "below", F.col("below") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    picks = ranked.groupBy(*keys).agg(*[F.max(F.when((F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt")), F.col("value"))).alias(name)
                                        for name, pos in at.items()])
    out = [((F.col(f"lo_{q}") + (F.col(f"hi_{q}") - F.col(f"lo_{q}")) * (F.lit(v) * (F.col("n") - 1) - F.floor(F.lit(v) * (F.col("n") - 1)))))
           .alias(f"dem_share_pred_{q}") for q, v in probs.items()]
    spread = spans.join(picks, keys).select(*keys, (F.col("above") / F.col("n")).alias("win"), (F.col("total") / F.col("n")).alias("dem_share_pred_mean"), *out)
    # a district without people stays, with NULL predictions
    return composition.select(*keys).join(spread, keys, "left").select(
        *keys, F.coalesce("win", F.lit(0.0)).alias("win"), "dem_share_pred_mean", "dem_share_pred_q05", "dem_share_pred_q95")


def project_ensemble(demo: DataFrame, plans: DataFrame, draws: DataFrame, ei_run_id: str, ensemble_id: str,
                     **options) -> DataFrame:
    """Projection on the districts of every plan of an ensemble."""
    split = options.pop("residual_split", False)
    ids = plans.where(F.col("ensemble_id") == ensemble_id).select("plan_id")
    scope = demo.join(dimension(ids), "plan_id", "left_semi")
    if scope.isEmpty():
        raise ValueError(f"no districts for ensemble {ensemble_id!r}")
    out = project_draws(district_composition(scope, residual_split=split), draws, **options)
    return out.select(F.lit(ei_run_id).alias("ei_run_id"), *out.columns)


def posterior_summary(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sd and the 2.5, 25, 50, 75 and 97.5 % quantiles per parameter."""
    return distribution(draws, by, value, {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975})


def split_rhat(draws: DataFrame, param: str, order: str, value: str) -> DataFrame:
    """Split R-hat per parameter: first half of a chain against the second.

    The half a draw falls in comes from the distributed ranking of its
    iteration, which carries the value along; no chain is sorted in one task.
    An odd last draw is dropped.  Fewer than 20 draws, or an iteration twice,
    is an error.
    """
    ranked = ranked_values(draws, [param], order, carry=[F.max(value).alias("_x")])
    half = F.floor(F.col("n") / 2)
    used = ranked.where(F.col("below") < 2 * half).withColumn("_second", F.col("below") >= half)
    halves = used.groupBy(param, "_second").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m"), F.var_samp("_x").alias("_v"),
        F.max("n").alias("n"), F.max("cnt").alias("_rep"))
    one = halves.groupBy(param).agg(
        F.max("n").alias("n_draws"), F.max("_n").alias("_n"), F.max("_rep").alias("_rep"),
        F.avg("_v").alias("_w"), (F.var_samp("_m")).alias("_b"))
    rhat = F.sqrt(F.try_divide((F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b"), "_w"))
    checked: Column = (
        F.when(F.col("n_draws") < 20, F.raise_error(F.lit("split R-hat needs at least 20 draws per parameter")).cast("double"))
        .when(F.col("_rep") > 1, F.raise_error(F.lit("an iteration occurs twice in a parameter's draws")).cast("double"))
        .otherwise(rhat))
    return one.select(param, F.col("n_draws").cast("bigint").alias("n_draws"), checked.alias("rhat"))
