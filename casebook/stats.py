"""Inference, clustering, regression, correlation and posterior queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wardatlas.operators import clustering, inference, mixture, profile, regression, rollup
from wardatlas.operators.order_stats import ranked_values
from wardatlas.functions.scalars import normalize_row
from wardatlas.tables import GROUP_VAP

from wardatlas.storage import materialize

from . import views as V
from .registry import case, r6

G = inference.GROUPS
QS = """round(avg(v),6) AS mean, round(stddev_samp(v),6) AS sd, round(quantile_cont(v,0.025),6) AS q025, round(quantile_cont(v,0.25),6) AS q25,
 round(quantile_cont(v,0.5),6) AS q50, round(quantile_cont(v,0.75),6) AS q75, round(quantile_cont(v,0.975),6) AS q975"""

# shares of the valid rows of the inference design
V_DESIGN = """
SELECT vtd_geoid, votes_total, votes_dem, vap_nh_white/cast(s AS double) AS "WHITE_NH", vap_nh_black/cast(s AS double) AS "BLACK_NH", vap_hisp/cast(s AS double) AS "HISP",
 vap_nh_asian/cast(s AS double) AS "ASIAN_NH", vap_nh_native/cast(s AS double) AS "NATIVE_NH", vap_other/cast(s AS double) AS "OTHER"
FROM (SELECT u.*, votes_total, votes_dem, vap_nh_white+vap_nh_black+vap_hisp+vap_nh_asian+vap_nh_native+vap_other AS s
      FROM fx_unit u JOIN fx_unit_returns r USING (vtd_geoid) WHERE votes_total > 0 AND vap_total > 0 AND votes_dem BETWEEN 0 AND votes_total) t"""


def _demo(spark, d):
    return rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))


def _design(spark, d):
    return inference.design(V.unit(spark, d), V.unit_returns(spark, d), "E1")


# ---- ecological inference ---------------------------------------------------------------------

@case("p16_valid_rows", "SELECT vtd_geoid, votes_total, votes_dem FROM fx_unit_returns WHERE votes_total > 0 AND votes_dem BETWEEN 0 AND votes_total", ("fx_unit_returns",))
def p16(spark, d):
    return _design(spark, d).select("vtd_geoid", "votes_total", "votes_dem")


@case("p17_normalized_shares", """
SELECT vtd_geoid, round(CASE WHEN a+n+o > 0 THEN a/(a+n+o) ELSE 0e0 END,6) AS a, round(CASE WHEN a+n+o > 0 THEN n/(a+n+o) ELSE 0e0 END,6) AS n, round(CASE WHEN a+n+o > 0 THEN o/(a+n+o) ELSE 0e0 END,6) AS o
FROM (SELECT vtd_geoid, cast(vap_nh_asian AS double) AS a, cast(vap_nh_native AS double) AS n, cast(vap_other AS double) AS o FROM fx_unit) t""", ("fx_unit",))
def p17(spark, d):
    """Rows of three groups scaled to sum one; rows without any give zeros."""
    u = V.unit(spark, d).select("vtd_geoid", F.col("vap_nh_asian").cast("double").alias("a"), F.col("vap_nh_native").cast("double").alias("n"), F.col("vap_other").cast("double").alias("o"))
    return r6(u.select("vtd_geoid", *[e.alias(c) for e, c in zip(normalize_row(["a", "n", "o"]), ["a", "n", "o"])]))


@case("j8_units_with_one_election", "SELECT vtd_geoid, vap_total, votes_total FROM fx_unit JOIN fx_unit_returns USING (vtd_geoid) WHERE election_id = 'E1'", ("fx_unit_returns",))
def j8(spark, d):
    r = V.unit_returns(spark, d).where("election_id = 'E1'").select("vtd_geoid", "votes_total")
    return V.unit(spark, d).select("vtd_geoid", "vap_total").join(r, "vtd_geoid")


@case("m21_inference_design", "SELECT vtd_geoid, votes_total, votes_dem, " + ", ".join(f'round("{g}",6) AS "{g}"' for g in G) + f" FROM ({V_DESIGN}) t", ("fx_unit_returns",))
def m21(spark, d):
    return r6(_design(spark, d))


PAIRS = [(a, b) for i, a in enumerate(G) for b in G[i:]]


@case("m22_normal_equations",
      "WITH x AS (" + V_DESIGN + ") " + " UNION ALL ".join(
          [f"SELECT '{a}' AS row_term, '{b}' AS col_term, round(sum(votes_total*\"{a}\"*\"{b}\"),6) AS value FROM x" for a, b in PAIRS]
          + [f"SELECT '{a}', 'y', round(sum(votes_dem*\"{a}\"),6) FROM x" for a in G]), ("fx_unit_returns",))
def m22n(spark, d):
    """Weighted cross products of the group-support regression."""
    return r6(inference.normal_equations(_design(spark, d)))


@case("m22_support_draws")
def m22(spark, d):
    """Bootstrap draws of group support; draw 0 is the estimate."""
    return r6(inference.support_draws(_design(spark, d)))


@case("m22_two_group_support", """
WITH x AS (""" + V_DESIGN + """), s AS (SELECT sum(votes_total*"WHITE_NH"*"WHITE_NH") AS a, sum(votes_total*"WHITE_NH"*(1-"WHITE_NH")) AS b, sum(votes_total*(1-"WHITE_NH")*(1-"WHITE_NH")) AS c,
 sum(votes_dem*"WHITE_NH") AS u, sum(votes_dem*(1-"WHITE_NH")) AS v FROM x)
SELECT round(least(greatest((c*u-b*v)/(a*c-b*b),0e0),1e0),6) AS "WHITE_NH", round(least(greatest((a*v-b*u)/(a*c-b*b),0e0),1e0),6) AS "REST" FROM s""", ("fx_unit_returns",))
def m22t(spark, d):
    """The estimate for two groups has a closed form."""
    rows = _design(spark, d).withColumn("REST", 1 - F.col("WHITE_NH"))
    return r6(inference.support_draws(rows, 10, groups=("WHITE_NH", "REST")).where("draw_id = 0").drop("draw_id"))


@case("m22_group_posterior")
def m22g(spark, d):
    from wardatlas.storage import materialize
    return r6(inference.group_posterior(materialize(inference.support_draws(_design(spark, d))), "RUN1"))


@case("m22_posterior_of_given_draws", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{g}' AS group_id, coalesce(max(CASE WHEN g = {i} THEN support END), 0.5e0) AS v FROM fx_support GROUP BY draw_id" for i, g in enumerate(G)) + """)
SELECT 'RUN1' AS ei_run_id, group_id, 'support_dem' AS param_name, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS sd, round(quantile_cont(v,0.05),6) AS q05,
 round(quantile_cont(v,0.5),6) AS q50, round(quantile_cont(v,0.95),6) AS q95 FROM t GROUP BY group_id""", ("fx_support",))
def m22p(spark, d):
    """The posterior table of draws that both sides know."""
    return r6(inference.group_posterior(V.support_draws(spark, d, G), "RUN1"))


COMP = """SELECT plan_id, district_id, w/s AS s0, b/s AS s1, h/s AS s2, r/s AS s3 FROM (SELECT plan_id, district_id, share_white_vap AS w, share_black_vap AS b, share_hisp_vap AS h,
 least(greatest(share_minority_vap-share_black_vap-share_hisp_vap,0e0),1e0) AS r, share_white_vap+share_black_vap+share_hisp_vap+3*least(greatest(share_minority_vap-share_black_vap-share_hisp_vap,0e0),1e0) AS s FROM fx_demo) t"""
DRAWS = "SELECT draw_id, " + ", ".join(f"max(CASE WHEN g = {i} THEN support END) AS d{i}" for i in range(6)) + " FROM fx_support GROUP BY draw_id"
PROJ = f"""WITH c AS ({COMP}), dr AS ({DRAWS})
SELECT plan_id, district_id, round({{win}},6) AS minority_preferred_win_prob, round(avg(p),6) AS dem_share_pred_mean,
 round(quantile_cont(p,0.05),6) AS dem_share_pred_q05, round(quantile_cont(p,0.95),6) AS dem_share_pred_q95
FROM (SELECT plan_id, district_id, s0*d0+s1*d1+s2*d2+s3*(d3+d4+d5) AS p FROM c CROSS JOIN dr) t GROUP BY 1,2"""
WIN = "avg(CASE WHEN p > 0.5e0 THEN 1e0 ELSE 0e0 END)"


@case("m23_projected_draws", PROJ.format(win=WIN), ("fx_demo", "fx_support"))
def m23(spark, d):
    """All draws projected on every district of every plan."""
    return r6(inference.project_draws(inference.district_composition(_demo(spark, d)), V.support_draws(spark, d, G)))


@case("j20_draws_by_blocks", PROJ.format(win=WIN), ("fx_demo", "fx_support"))
def j20(spark, d):
    """The same by blocks of draws and the distributed ranking, as for a draw matrix no task can hold."""
    from wardatlas.storage import materialize
    comp = materialize(inference.district_composition(_demo(spark, d)))
    return r6(inference.project_draws(comp, V.support_draws(spark, d, G), draw_limit=0))


@case("f9_group_shares", f"SELECT plan_id, district_id, round(s0,6) AS white, round(s1,6) AS black, round(s2,6) AS hisp, round(s3,6) AS other FROM ({COMP}) c", ("fx_demo",))
def f9(spark, d):
    """Groups mapped to their share columns and scaled to sum one."""
    c = inference.district_composition(_demo(spark, d))
    return r6(c.select("plan_id", "district_id", F.col("WHITE_NH").alias("white"), F.col("BLACK_NH").alias("black"),
                       F.col("HISP").alias("hisp"), F.col("OTHER").alias("other")))


@case("m24_complement", PROJ.format(win=f"1e0-{WIN}"), ("fx_demo", "fx_support"))
def m24(spark, d):
    return r6(inference.project_draws(inference.district_composition(_demo(spark, d)), V.support_draws(spark, d, G), dem_is_minority_preferred=False))


@case("j7_ensemble_districts", "SELECT plan_id, district_id, round(share_black_vap,6) AS s FROM fx_demo JOIN fx_plan USING (plan_id) WHERE ensemble_id = 'ENS_B'", ("fx_demo",))
def j7(spark, d):
    ids = V.plan(spark, d).where("ensemble_id = 'ENS_B'").select("plan_id")
    return r6(_demo(spark, d).join(ids, "plan_id", "left_semi").select("plan_id", "district_id", F.col("share_black_vap").alias("s")))


@case("a21_posterior_summary", f"SELECT param, count(v) AS n, {QS}, min(v) AS min, max(v) AS max FROM (SELECT param, value AS v FROM fx_param_draws) t GROUP BY 1", ("fx_param_draws",))
def a21(spark, d):
    return r6(inference.posterior_summary(V.param_draws(spark, d), ["param"], "value"))


@case("a22_split_rhat", """
SELECT param, max(n) AS n_draws, round(sqrt(((max(h)-1)/cast(max(h) AS double)*avg(v)+var_samp(m))/avg(v)),6) AS rhat FROM (
 SELECT param, rn >= h AS second, max(n) AS n, max(h) AS h, avg(value) AS m, var_samp(value) AS v FROM
  (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY iter)-1 AS rn, count(*) OVER (PARTITION BY param) AS n, (count(*) OVER (PARTITION BY param))//2 AS h FROM fx_param_draws) t
 WHERE rn < 2*h GROUP BY 1,2) u GROUP BY 1""", ("fx_param_draws",))
def a22(spark, d):
    """Split R-hat of each event type's values in event order."""
    return r6(inference.split_rhat(V.param_draws(spark, d), "param", "iter", "value"))


@case("w5_chain_halves", """
SELECT param, second, count(*) AS n, max(iter) AS last_iter FROM (SELECT param, iter, row_number() OVER (PARTITION BY param ORDER BY iter)-1 >= (count(*) OVER (PARTITION BY param))//2 AS second FROM fx_param_draws) t GROUP BY 1,2""", ("fx_param_draws",))
def w5(spark, d):
    r = ranked_values(V.param_draws(spark, d), ["param"], "iter")
    return r.groupBy("param", (F.col("below") >= F.floor(F.col("n") / 2)).alias("second")).agg(
        F.sum("cnt").alias("n"), F.max("iter").alias("last_iter"))


# ---- correlation and group means -----------------------------------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@case("a18_pearson", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a},{b}),6)+0e0 AS corr FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1:]))
def a18(spark, d):
    return r6(profile.pearson(V.table(spark, d, "lineitem"), NUM))


RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2e0)"
FE = ["polsby_popper", "convex_hull_ratio", "pct_black", "dem_share"]


@case("a19_spearman", "WITH r AS (SELECT " + ", ".join(f"{RANK.format(c=c)} AS {c}" for c in FE) + " FROM fx_features) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a},{b}),6)+0e0 AS corr FROM r" for i, a in enumerate(FE) for b in FE[i + 1:]), ("fx_features",))
def a19(spark, d):
    """Rank correlation of feature columns, many of whose rows share a value."""
    return r6(profile.spearman(V.features(spark, d), "district_id", FE))


@case("w4_average_ranks", "SELECT event_id, round(" + RANK.format(c="value") + ",6) AS value FROM events")
def w4(spark, d):
    return r6(profile.average_ranks(V.table(spark, d, "events").select("event_id", "value"), "event_id", ["value"]))


@case("a17_group_means", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT district_id % 2 AS grp, '{c}' AS \"column\", round(avg({c}),6) AS mean FROM fx_features GROUP BY 1" for c in V.RACE) + ") t", ("fx_features",))
def a17(spark, d):
    return r6(profile.group_means(V.features(spark, d).withColumn("grp", F.col("district_id") % 2), "grp", V.RACE))


# ---- clustering ------------------------------------------------------------------------------------

@case("m1_feature_matrix", "SELECT district_id, round(polsby_popper+schwartzberg+convex_hull_ratio+reock+dem_share+rep_share,6) AS total, 6 AS n FROM fx_features", ("fx_features",))
def m1(spark, d):
    """Feature array without the race columns."""
    f = V.features(spark, d)
    cols = clustering.feature_columns(f.columns, "district_id", V.RACE, drop_race=True)
    return r6(clustering.as_features(f, cols).select("district_id", F.aggregate("features", F.lit(0.0), lambda s, v: s + v).alias("total"), F.size("features").alias("n")))


@case("m2_standardized", "SELECT district_id, round((reock - avg(reock) OVER ())/stddev_pop(reock) OVER (),6)+0e0 AS reock FROM fx_features", ("fx_features",))
def m2(spark, d):
    out, _ = clustering.standardize(V.features(spark, d), ["reock"])
    return r6(out.select("district_id", (F.round("reock", 6) + 0.0).alias("reock")))


@case("m3_pca_two_metrics", "SELECT round((1+abs(corr(convex_hull_ratio, reock)))/2,6) AS explained, round(sqrt(0.5e0),6) AS w0, round(sqrt(0.5e0),6) AS w1 FROM fx_features", ("fx_features",))
def m3(spark, d):
    """Two standardized metrics have a component in closed form."""
    _, meta = clustering.compactness_pca(V.features(spark, d), ["convex_hull_ratio", "reock"])
    return r6(spark.createDataFrame([(meta["explained_variance_ratio"], *meta["pca_components"])], "explained double, w0 double, w1 double"))


@case("m3_compactness_scores", "SELECT district_id, round((z0+z1)/sqrt(2e0),6)+0e0 AS score FROM (SELECT district_id, (convex_hull_ratio-avg(convex_hull_ratio) OVER ())/stddev_pop(convex_hull_ratio) OVER () AS z0, (reock-avg(reock) OVER ())/stddev_pop(reock) OVER () AS z1 FROM fx_features) t", ("fx_features",))
def m3s(spark, d):
    scored, _ = clustering.compactness_pca(V.features(spark, d), ["convex_hull_ratio", "reock"])
    return scored.select("district_id", (F.round("compactness_pca_score", 6) + 0.0).alias("score"))


@case("m4_compactness_index", "SELECT district_id, round((s-min(s) OVER ())/(max(s) OVER () - min(s) OVER ()),6)+0e0 AS compactness_index FROM (SELECT district_id, z0+z1 AS s FROM (SELECT district_id, (polsby_popper-avg(polsby_popper) OVER ())/stddev_pop(polsby_popper) OVER () AS z0, (reock-avg(reock) OVER ())/stddev_pop(reock) OVER () AS z1 FROM fx_features) t) u", ("fx_features",))
def m4(spark, d):
    out = clustering.compactness_index(V.features(spark, d), ["polsby_popper", "reock"])
    return out.select("district_id", (F.round("compactness_index", 6) + 0.0).alias("compactness_index"))


@case("m3_four_metric_components")
def m3f(spark, d):
    _, meta = clustering.compactness_pca(V.features(spark, d), V.METRICS)
    return r6(spark.createDataFrame(list(zip(meta["metrics"], meta["scaler_mean"], meta["scaler_scale"], meta["pca_components"])),
                                    "metric string, mean double, scale double, component double"))


@case("m5_kmeans")
def m5(spark, d):
    """Cluster sizes of the best of ten fits on the vectors."""
    v = V.vectors(spark, d)
    return clustering.cluster_sizes(clustering.predict(v, clustering.fit_kmeans(v, 10, 42, 10)[0]), "cluster")


@case("m6_k_search")
def m6(spark, d):
    """Means per k over seeds, best k first."""
    return r6(clustering.k_search_summary(clustering.k_search(V.vectors(spark, d), "vec_id", range(2, 13), range(10))))


def _round(i: int) -> str:
    """One plain round: every vector to its nearest centre, the lower number of equal ones, and the new means."""
    return f"""a{i} AS (SELECT vec_id, v, arg_min(c, {{'d': list_distance(v, m), 'c': c}}) AS c, min(pow(list_distance(v, m), 2)) AS d2 FROM x CROSS JOIN c{i} GROUP BY 1, 2),
c{i + 1} AS (SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, avg(e) AS m FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{i}) t GROUP BY 1, 2) u GROUP BY 1)"""


@case("m5_kmeans_rounds_from_fixed_start", f"""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v AS m FROM x QUALIFY c < 10),
{_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
SELECT cast(c AS int) AS cluster, count(*) AS size, round(sum(d2),6) AS within FROM a3 GROUP BY 1""")
def m5r(spark, d):
    """Three rounds from the ten vectors of the lowest ids: sizes and squared distances of the clusters."""
    v = V.vectors(spark, d)
    start = np.array([r["features"] for r in v.orderBy("vec_id").limit(10).collect()])
    centers, *_ = clustering.lloyd(v.select("features"), [start], max_iter=3, tol=0.0)[0]
    far = F.lit(None).cast("double")
    for i, c in enumerate(centers):
        far = F.when(F.col("cluster") == i, clustering.squared_distance(F.col("features"), F.array(*[F.lit(float(x)) for x in c]))).otherwise(far)
    found = clustering.predict(v, centers).withColumn("far", far)
    return r6(found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("far").alias("within")))


def _apart(spark, d):
    """Vectors moved so far by label that the labels are the best clustering; the moves leave distances inside a label alone."""
    far = F.transform("features", lambda x, i: F.when(i == F.col("label"), x + F.lit(1e6)).otherwise(x))
    return V.vectors(spark, d).withColumn("features", far)


@case("m5_kmeans_of_known_clusters", "SELECT label AS low, label AS high, count(*) AS size FROM embeddings GROUP BY label")
def m5k(spark, d):
    """The fit on vectors far apart by label finds the labels."""
    v = materialize(_apart(spark, d))
    k = v.select("label").distinct().count()
    found = clustering.predict(v, clustering.fit_kmeans(v, k, 42, 10)[0])
    return found.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).drop("cluster")


@case("m6_k_search_of_known_clusters", """
WITH pts AS (SELECT vec_id, label, unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), cen AS (SELECT label, i, avg(x) AS m FROM pts GROUP BY 1,2)
SELECT cast(count(DISTINCT label) AS int) AS best_k, round(sum((x-m)*(x-m))/1000,3) AS thousand_inertia FROM pts JOIN cen USING (label, i)""")
def m6k(spark, d):
    """The search over k around the number of labels ends at that number, with the labels' own inertia."""
    v = materialize(_apart(spark, d))
    k = v.select("label").distinct().count()
    fits = clustering.k_search(v, "vec_id", range(max(2, k - 2), k + 2), (0, 1))
    best = clustering.best_k(clustering.k_search_summary(fits))
    return fits.where(F.col("k") == best).agg(F.max("k").alias("best_k"), F.round(F.avg("inertia") / 1000, 3).alias("thousand_inertia"))


CENT = """cen AS (SELECT label, i, avg(x) AS m FROM pts GROUP BY 1,2)"""
PTS = "pts AS (SELECT vec_id, label, unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
DIST2 = "d2 AS (SELECT vec_id, label, sum((x-m)*(x-m)) AS d2 FROM pts JOIN cen USING (label, i) GROUP BY 1,2)"


@case("m7_cluster_scores", f"""
WITH {PTS}, {CENT}, {DIST2}, sz AS (SELECT label, count(*) AS n, sum(d2) AS within, avg(sqrt(d2)) AS sc FROM d2 GROUP BY 1),
gm AS (SELECT i, avg(x) AS g FROM pts GROUP BY 1), bt AS (SELECT sum(n*b) AS between_ss FROM (SELECT label, sum((m-g)*(m-g)) AS b FROM cen JOIN gm USING (i) GROUP BY 1) t JOIN sz USING (label)),
rr AS (SELECT a.label, max((sa.sc+sb.sc)/dist) AS r FROM (SELECT a.label, b.label AS other, sqrt(sum((a.m-b.m)*(a.m-b.m))) AS dist FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY 1,2) a
 JOIN sz sa ON sa.label = a.label JOIN sz sb ON sb.label = a.other GROUP BY 1)
SELECT round((SELECT sum(within) FROM sz),6) AS inertia, round((SELECT between_ss FROM bt)/((SELECT count(*) FROM sz)-1)/((SELECT sum(within) FROM sz)/((SELECT sum(n) FROM sz)-(SELECT count(*) FROM sz))),6) AS calinski_harabasz,
 round((SELECT avg(r) FROM rr),6) AS davies_bouldin""")
def m7(spark, d):
    """Inertia, Calinski-Harabasz and Davies-Bouldin of the given labels."""
    s = clustering.cluster_scores(V.vectors(spark, d), "label", 64)
    return r6(spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} double" for k in s)))


@case("m7_euclidean_silhouette", """
WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1,2,3),
q AS (SELECT vec_id, max(CASE WHEN own = other THEN s/nullif(n-1,0) END) AS a, min(CASE WHEN own <> other THEN s/n END) AS b FROM p GROUP BY 1)
SELECT vec_id, 0 AS labeling, round(coalesce((b-a)/greatest(a,b),0),6)+0e0 AS silhouette FROM q""")
def m7s(spark, d):
    """Silhouette of every vector for the given labels, block by block."""
    v = V.vectors(spark, d).withColumn("labels", F.array("label"))
    s = clustering.silhouettes(v, "vec_id", "labels")
    return s.select("vec_id", "labeling", (F.round("silhouette", 6) + 0.0).alias("silhouette"))


@case("m7_linear_silhouette", """
WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),2)) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1,2,3),
q AS (SELECT vec_id, max(CASE WHEN own = other THEN s/nullif(n-1,0) END) AS a, min(CASE WHEN own <> other THEN s/n END) AS b FROM p GROUP BY 1)
SELECT vec_id, round(coalesce((b-a)/greatest(a,b),0),6)+0e0 AS silhouette FROM q""")
def m7l(spark, d):
    """Squared-distance silhouette in one pass over the rows."""
    s = clustering.linear_silhouette(V.vectors(spark, d), "label", 64)
    return s.select("vec_id", (F.round("silhouette", 6) + 0.0).alias("silhouette"))


@case("m8_centroid_profiles", """
WITH c AS (SELECT cast(district_id % 3 AS int) AS cluster, avg(pct_white) AS pct_white, avg(reock) AS reock FROM fx_features GROUP BY 1)
SELECT cluster, round(pct_white,6) AS pct_white, round(reock,6) AS reock, round((pct_white-(SELECT avg(pct_white) FROM c))/(SELECT stddev_samp(pct_white) FROM c),4)+0e0 AS z_pct_white,
 round((reock-(SELECT avg(reock) FROM c))/(SELECT stddev_samp(reock) FROM c),4)+0e0 AS z_reock FROM c""", ("fx_features",))
def m8(spark, d):
    f = V.features(spark, d).withColumn("cluster", (F.col("district_id") % 3).cast("int"))
    out = r6(clustering.centroid_profiles(f, "cluster", ["pct_white", "reock"]))
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("z_pct_white", "z_reock")})


@case("m9_center_distance", f"WITH {PTS}, {CENT}, {DIST2} SELECT vec_id, round(sqrt(d2),6) AS dist_to_centroid FROM d2")
def m9(spark, d):
    return r6(clustering.center_distances(V.vectors(spark, d), "label", 64).select("vec_id", "dist_to_centroid"))


@case("j21_labels_on_rows", "SELECT district_id, round(pct_white,6) AS pct_white, CASE WHEN dem_share > 0.45e0 THEN 1 END AS cluster FROM fx_features", ("fx_features",))
def j21(spark, d):
    """Cluster labels of some rows joined back to all."""
    f = V.features(spark, d)
    labels = f.where("dem_share > 0.45").select("district_id", F.lit(1).alias("cluster"))
    return r6(f.select("district_id", "pct_white").join(labels, "district_id", "left"))


@case("a20_search_summary", "SELECT cast(c_nationkey AS int) AS k, round(avg(c_acctbal),6) AS silhouette_mean, round(stddev_samp(c_acctbal),6) AS silhouette_std, round(avg(c_acctbal*2),6) AS ch_mean, round(avg(c_acctbal/2),6) AS db_mean, round(avg(c_custkey),6) AS inertia_mean FROM customer GROUP BY 1")
def a20(spark, d):
    """Summary of a table of fits, each customer standing for one."""
    b = F.col("c_acctbal")
    fits = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), b.alias("silhouette"), (b * 2).alias("calinski_harabasz"),
                                                (b / 2).alias("davies_bouldin"), F.col("c_custkey").cast("double").alias("inertia"))
    return r6(clustering.k_search_summary(fits))


# ---- regression ------------------------------------------------------------------------------------

X = ["compactness_pca_score", "pct_black", "pct_asian", "pct_hispanic"]


def _labeled(spark, d):
    """Features with a party label that depends on them, and the majority group."""
    f, _ = clustering.compactness_pca(V.features(spark, d), V.METRICS)
    noise = ((F.col("district_id") * 37) % 101) / 101.0
    y = (F.col("pct_black") + 0.4 * F.col("pct_hispanic") + 0.1 * F.col("polsby_popper") + 0.25 * noise > 0.49).cast("int")
    return f.withColumns({"party": y, "majority_race": F.greatest(*[F.struct(F.col(c).alias("v"), F.lit(c).alias("n")) for c in V.RACE])["n"]})


@case("m11_stratified_split", "SELECT cast(district_id % 3 AS int) AS cls, round(0.25e0*count(*)) AS n_test, count(*) AS n FROM fx_features GROUP BY 1", ("fx_features",))
def m11(spark, d):
    """A quarter of every class goes to the test side."""
    f = V.features(spark, d).select("district_id", (F.col("district_id") % 3).cast("int").alias("cls"))
    return regression.stratified_split(f, "district_id", "cls").groupBy("cls").agg(
        F.count_if("is_test").cast("double").alias("n_test"), F.count(F.lit(1)).alias("n"))


@case("m12_penalised_fits")
def m12(spark, d):
    """Coefficients of the candidates fitted on all rows from the same cross products."""
    rows = _labeled(spark, d)
    basis = regression.Basis(X, "majority_race", sorted(r[0] for r in rows.select("majority_race").distinct().collect()))
    cols = basis.columns()
    table = rows.select(*[e.alias(n) for n, e in cols.items()], F.col("party").cast("double").alias("_y"),
                        regression.fold_of(F.col("district_id"), 5, 42).alias("_g"))
    parts = list(regression.grams(table, [*cols, "_y"], "_g").values())
    out = []
    for spec in regression.CANDIDATES:
        fit = regression.fit_from_grams(basis, spec, parts)
        out += [(spec.name, n, float(c)) for n, c in zip(fit.names, fit.coef)]
    return r6(spark.createDataFrame(out, "candidate string, feature string, coef double"))


@case("m12_ols_one_feature", "SELECT round(regr_slope(dem_share, pct_black),6) AS slope, round(regr_intercept(dem_share, pct_black),6) AS intercept FROM fx_features", ("fx_features",))
def m12o(spark, d):
    """Least squares on one feature has a closed form."""
    g = regression.grams(V.features(spark, d).withColumn("_one", F.lit(1.0)), ["_one", "pct_black", "dem_share"])[0]
    b = regression.penalised(g, "ols")
    return r6(spark.createDataFrame([(float(b[1]), float(b[0]))], "slope double, intercept double"))


@case("m12_one_feature_penalties", """
SELECT family, round(CASE family WHEN 'ridge' THEN sxy/(sxx+3e0) WHEN 'lasso' THEN sign(sxy)*greatest(abs(sxy)/n-0.001e0,0)/(sxx/n) ELSE sign(sxy)*greatest(abs(sxy)/n-0.0005e0,0)/(sxx/n+0.0005e0) END,6)+0e0 AS slope
FROM (SELECT regr_sxx(dem_share,pct_black) AS sxx, regr_sxy(dem_share,pct_black) AS sxy, count(*) AS n FROM fx_features) t JOIN (VALUES ('ridge'),('lasso'),('elasticnet')) v(family) ON true""", ("fx_features",))
def m12p(spark, d):
    """Penalised slopes on one feature have closed forms."""
    g = regression.grams(V.features(spark, d).withColumn("_one", F.lit(1.0)), ["_one", "pct_black", "dem_share"])[0]
    fits = [("ridge", 3.0, 1.0), ("lasso", 0.001, 1.0), ("elasticnet", 0.001, 0.5)]
    return spark.createDataFrame([(f, float(round(regression.penalised(g, f, a, r)[1], 6)) + 0.0) for f, a, r in fits], "family string, slope double")


@case("m10_design_columns", """
SELECT district_id, CASE WHEN majority = 'pct_hispanic' THEN 1e0 ELSE 0e0 END AS h, CASE WHEN majority = 'pct_white' THEN 1e0 ELSE 0e0 END AS w, round(pct_black*pct_black,6) AS b2, round(pct_black*pct_asian,6) AS ba, round(pct_asian*pct_asian,6) AS a2
FROM (SELECT *, CASE greatest(pct_white,pct_hispanic) WHEN pct_white THEN 'pct_white' ELSE 'pct_hispanic' END AS majority FROM fx_features) t""", ("fx_features",))
def m10(spark, d):
    """Category indicators and degree-two terms of the design."""
    f = V.features(spark, d).withColumn("majority", F.when(F.col("pct_white") >= F.col("pct_hispanic"), "pct_white").otherwise("pct_hispanic"))
    c = regression.Basis(["pct_black", "pct_asian"], "majority", ["pct_hispanic", "pct_white"]).columns()
    return r6(f.select("district_id", c["_l0"].alias("h"), c["_l1"].alias("w"), c["_q0_0"].alias("b2"), c["_q0_1"].alias("ba"), c["_q1_1"].alias("a2")))


@case("m13_cross_validation")
def m13(spark, d):
    """Balanced accuracy of every candidate over five folds."""
    results, _, _ = regression.search(_labeled(spark, d), "district_id", "party", X, "majority_race")
    return r6(spark.createDataFrame([tuple(r.values()) for r in results], "candidate string, poly boolean, cv_mean double, cv_std double"))


def _given_folds(spark, d):
    f = V.features(spark, d).withColumns({"y": (F.col("dem_share") > 0.45).cast("int"), "fold": (F.col("district_id") % 5).cast("int")})
    return regression.search(f, "district_id", "y", ["pct_black"], candidates=(regression.Spec("ols"),), fold="fold")


@case("m13_given_folds", """
WITH r AS (SELECT district_id % 5 AS f, pct_black AS x, CASE WHEN dem_share > 0.45e0 THEN 1 ELSE 0 END AS y FROM fx_features),
fit AS (SELECT o.f, regr_slope(r.y, r.x) AS b, regr_intercept(r.y, r.x) AS a FROM (SELECT DISTINCT f FROM r) o JOIN r ON r.f <> o.f GROUP BY o.f),
s AS (SELECT fit.f, r.f = fit.f AS held, y, least(greatest(a + b * x, 0e0), 1e0) AS score FROM fit JOIN r ON true),
c AS (SELECT f, held, i, count(*) FILTER (y = 1 AND score >= i / 200e0) AS tp, count(*) FILTER (y = 0 AND score < i / 200e0) AS tn, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
      FROM s JOIN (SELECT unnest(range(201)) AS i) g ON true GROUP BY 1, 2, 3),
b AS (SELECT f, held, i, (tp / cast(p AS double) + tn / cast(n AS double)) / 2 AS acc FROM c),
best AS (SELECT f, arg_min(i, {'a': -round(acc, 12), 'i': i}) AS i FROM b WHERE NOT held GROUP BY 1)
SELECT 'ols' AS candidate, round(avg(acc), 6) AS cv_mean, round(stddev_pop(acc), 6) AS cv_std FROM b JOIN best USING (f, i) WHERE held""", ("fx_features",))
def m13g(spark, d):
    """Least squares on one feature over folds by id: threshold from the training rows, accuracy on the others."""
    results, _, _ = _given_folds(spark, d)
    return r6(spark.createDataFrame([(r["candidate"], r["cv_balanced_accuracy_mean"], r["cv_balanced_accuracy_std"]) for r in results], "candidate string, cv_mean double, cv_std double"))


THR = """
WITH s AS (SELECT least(greatest(pct_white,0e0),1e0) AS score, CASE WHEN dem_share > 0.45e0 THEN 1 ELSE 0 END AS y FROM fx_features), g AS (SELECT i/200e0 AS threshold FROM (SELECT unnest(range(201)) AS i) t),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM g JOIN s ON true GROUP BY 1),
b AS (SELECT threshold, tp, fp, (tp/cast(p AS double) + 1e0 - fp/cast(n AS double))/2 AS balanced_accuracy FROM c)"""


def _scored(spark, d):
    return V.features(spark, d).select(F.col("pct_white").alias("score"), (F.col("dem_share") > 0.45).cast("int").alias("y"))


@case("m14_threshold_curve", THR + " SELECT round(threshold,6) AS threshold, tp, fp, round(balanced_accuracy,6) AS balanced_accuracy FROM b", ("fx_features",))
def m14(spark, d):
    return r6(regression.threshold_curve(_scored(spark, d), "score", "y"))


@case("m14_best_threshold", THR + " SELECT round(threshold,6) AS threshold, round(balanced_accuracy,6) AS balanced_accuracy FROM b ORDER BY round(balanced_accuracy,12) DESC, threshold LIMIT 1", ("fx_features",))
def m14b(spark, d):
    return r6(regression.best_threshold(_scored(spark, d), "score", "y"))


@case("m15_classification_metrics", """
WITH s AS (SELECT pct_white AS score, pct_white >= 0.35e0 AS hit, CASE WHEN dem_share > 0.45e0 THEN 1 ELSE 0 END AS y FROM fx_features),
c AS (SELECT count(*) FILTER (hit AND y=1) AS tp, count(*) FILTER (hit AND y=0) AS fp, count(*) FILTER (NOT hit AND y=1) AS fn, count(*) FILTER (NOT hit AND y=0) AS tn, avg((y-score)*(y-score)) AS mse, var_pop(y) AS vy FROM s)
SELECT tp, fp, fn, tn, round((tp+tn)/cast(tp+fp+fn+tn AS double),6) AS accuracy, round((tp/cast(tp+fn AS double)+tn/cast(tn+fp AS double))/2,6) AS balanced_accuracy, round(2*tp/cast(2*tp+fp+fn AS double),6) AS f1, round(mse,6) AS mse, round(1-mse/vy,6) AS r2 FROM c""", ("fx_features",))
def m15(spark, d):
    return r6(regression.classification_metrics(_scored(spark, d), "score", "y", 0.35))


@case("m15_class_report", """
WITH s AS (SELECT CASE WHEN pct_white >= 0.35e0 THEN 1 ELSE 0 END AS p, CASE WHEN dem_share > 0.45e0 THEN 1 ELSE 0 END AS y FROM fx_features)
SELECT k AS class, round(coalesce(count(*) FILTER (p=k AND y=k)/cast(nullif(count(*) FILTER (p=k),0) AS double),0),6) AS "precision", round(count(*) FILTER (p=k AND y=k)/cast(count(*) FILTER (y=k) AS double),6) AS recall,
 round(2*count(*) FILTER (p=k AND y=k)/cast(count(*) FILTER (p=k)+count(*) FILTER (y=k) AS double),6) AS f1, count(*) FILTER (y=k) AS support FROM s JOIN (VALUES (0),(1)) v(k) ON true GROUP BY k""", ("fx_features",))
def m15c(spark, d):
    s = _scored(spark, d).withColumn("p", (F.col("score") >= 0.35).cast("int"))
    return r6(regression.class_report(s, "p", "y"))


@case("m16_coefficients")
def m16(spark, d):
    """Coefficients of the chosen model, largest first."""
    rows = _labeled(spark, d)
    _, fit, _ = regression.search(rows, "district_id", "party", X, "majority_race")
    return r6(regression.coefficient_table(rows, fit))


@case("m16_coefficient_of_one_feature", """
SELECT 'pct_black' AS feature, round(regr_slope(y, pct_black) * stddev_pop(pct_black), 6) AS coef
FROM (SELECT pct_black, CASE WHEN dem_share > 0.45e0 THEN 1 ELSE 0 END AS y FROM fx_features) t""", ("fx_features",))
def m16o(spark, d):
    """The refitted model's coefficient, on the scaled feature."""
    _, fit, _ = _given_folds(spark, d)
    return r6(regression.coefficient_table(V.features(spark, d), fit))


@case("m17_ols_summary", """
SELECT 'pct_black' AS term, round(b,6) AS coef, round(sqrt(s2/sxx),6) AS std_error, round(b/sqrt(s2/sxx),4)+0e0 AS t_value FROM (SELECT regr_slope(dem_share,pct_black) AS b, regr_sxx(dem_share,pct_black) AS sxx,
 (regr_syy(dem_share,pct_black)-regr_slope(dem_share,pct_black)*regr_sxy(dem_share,pct_black))/(count(*)-2) AS s2 FROM fx_features) t""", ("fx_features",))
def m17(spark, d):
    """Standard error and t of the slope."""
    s = regression.ols_summary(V.features(spark, d), ["pct_black"], "dem_share").where("term = 'pct_black'")
    return r6(s.drop("p_value")).withColumn("t_value", F.round("t_value", 4) + 0.0)


@case("m17_p_values")
def m17p(spark, d):
    return r6(regression.ols_summary(_labeled(spark, d), X, "party"))


@case("m18_variance_inflation", """
SELECT c AS feature, round(aa*bb/(aa*bb-ab*ab),6) AS vif FROM (SELECT sum(pct_black*pct_black) AS aa, sum(pct_hispanic*pct_hispanic) AS bb, sum(pct_black*pct_hispanic) AS ab FROM fx_features) t JOIN (VALUES ('pct_black'),('pct_hispanic')) v(c) ON true""", ("fx_features",))
def m18(spark, d):
    """Uncentred inflation of two columns has a closed form."""
    return r6(regression.variance_inflation(V.features(spark, d), ["pct_black", "pct_hispanic"]))


@case("m19_influence", """
WITH m AS (SELECT avg(pct_black) AS mx, regr_sxx(dem_share,pct_black) AS sxx, regr_slope(dem_share,pct_black) AS b, regr_intercept(dem_share,pct_black) AS a, count(*) AS n,
 (regr_syy(dem_share,pct_black)-regr_slope(dem_share,pct_black)*regr_sxy(dem_share,pct_black))/(count(*)-2) AS s2 FROM fx_features),
r AS (SELECT district_id, 1e0/n+(pct_black-mx)*(pct_black-mx)/sxx AS h, dem_share-a-b*pct_black AS e, s2 FROM fx_features JOIN m ON true)
SELECT district_id, round(h,6) AS leverage, round(e,6)+0e0 AS residual, round(e*e*h/(2*s2*(1-h)*(1-h)),6) AS cooks_d FROM r""", ("fx_features",))
def m19(spark, d):
    """Leverage, residual and Cook's distance of every row."""
    out = regression.influence(V.features(spark, d), ["pct_black"], "dem_share")
    return r6(out.select("district_id", "leverage", (F.round("residual", 6) + 0.0).alias("residual"), "cooks_d"))


# ---- mixture -----------------------------------------------------------------------------------------

@case("m20_mixture_membership")
def m20(spark, d):
    """Membership of the less compact component for every unit."""
    ix = clustering.compactness_index(V.features(spark, d), V.METRICS)
    out = mixture.low_component_membership(ix.select("district_id", "compactness_index"), "compactness_index")
    return r6(out)


@case("m20_two_groups_apart", "SELECT district_id, CASE WHEN district_id % 2 = 0 THEN 1 ELSE 0 END AS low_cluster FROM fx_features", ("fx_features",))
def m20t(spark, d):
    """Two groups far apart: the fitted mixture puts each district in its own."""
    f = V.features(spark, d).select("district_id", (F.col("reock") + 100 * (F.col("district_id").cast("bigint") % 2)).alias("x"))
    return mixture.low_component_membership(f, "x").select("district_id", "low_cluster")


@case("m20_membership_from_draws", """
SELECT user_id, round(avg(CASE WHEN z = low THEN 1e0 ELSE 0e0 END),6) AS post_prob, CASE WHEN avg(CASE WHEN z = low THEN 1e0 ELSE 0e0 END) >= 0.5e0 THEN 1 ELSE 0 END AS low_cluster
FROM (SELECT user_id, CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END AS z, CASE WHEN value < 12e0 THEN 1 ELSE 0 END AS low FROM events) t GROUP BY 1""")
def m20d(spark, d):
    """Share of draws in the low component, named anew in each draw."""
    e = V.table(spark, d, "events")
    z = e.select("user_id", F.col("event_id").alias("iter"), F.col("event_type").isin("view", "click").cast("int").alias("component"))
    mu = e.select(F.col("event_id").alias("iter"), F.col("value").alias("mu_1"), F.lit(12.0).alias("mu_2"))
    return r6(mixture.membership_from_draws(z, mu, "user_id"))


@case("o2_most_likely_units", """
SELECT user_id, post_prob, low_cluster FROM (SELECT user_id, round(avg(CASE WHEN value < 12e0 THEN 1e0 ELSE 0e0 END),6) AS post_prob, CASE WHEN avg(CASE WHEN value < 12e0 THEN 1e0 ELSE 0e0 END) >= 0.5e0 THEN 1 ELSE 0 END AS low_cluster
FROM events GROUP BY 1) t ORDER BY post_prob DESC, user_id LIMIT 20""")
def o2m(spark, d):
    p = V.table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("value") < 12, 1.0).otherwise(0.0)).alias("post_prob"))
    return mixture.most_likely(r6(mixture.flag(p)), "user_id")
