"""Study tables derived from the driver's tables by Spark, and the same in SQL.

Every view reads whole tables.  ``SQL`` holds the twin text of each view; its
names match the functions here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardatlas.functions.geometry import box_rings
from wardatlas.functions.scalars import logistic, zfill
from wardatlas.operators.joins import shuffled
from wardatlas.operators.opportunity import definitions

DEFS = (("BVAP", "BLACK", "share_black_vap", 0.185), ("HVAP", "HISP", "share_hisp_vap", 0.3),
        ("MINVAP", "MINORITY", "share_minority_vap", 0.562))
METRICS = ["polsby_popper", "schwartzberg", "convex_hull_ratio", "reock"]
RACE = ["pct_white", "pct_black", "pct_asian", "pct_hispanic"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def unit(spark, d) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", (20 + (k * 7) % 61 + 3 * (n % 10)).cast("bigint").alias("w"),
        (5 + (k * 11) % 43).cast("bigint").alias("b"), (10 + (k * 13) % 53 + 2 * (n % 7)).cast("bigint").alias("h"),
        ((k * 5) % 17).cast("bigint").alias("a"), (k % 3).cast("bigint").alias("n"), (k % 5).cast("bigint").alias("o"))
    return c.select(
        F.concat(F.lit("48"), zfill(n, 3), zfill(k, 6)).alias("vtd_geoid"), k.alias("vtdkey"),
        F.lit("48").alias("state_fips"), zfill(n, 3).alias("county_fips"),
        (F.col("w") + F.col("b") + F.col("h") + F.col("a") + F.col("n") + F.col("o")).alias("vap_total"),
        F.col("w").alias("vap_nh_white"), F.col("b").alias("vap_nh_black"), F.col("h").alias("vap_hisp"),
        F.col("a").alias("vap_nh_asian"), F.col("n").alias("vap_nh_native"), F.col("o").alias("vap_other"))


def returns_tall(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("vtdkeyvalue"), F.col("o_orderpriority").alias("office"),
        F.when(s == "F", "D").when(s == "O", " rep ").otherwise("I").alias("party"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("votes"))


def plan(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.concat(F.lit("P"), zfill(n, 3)).alias("plan_id"), n.alias("plan_no"),
        F.when(n < 2, "ENACTED").otherwise("ENSEMBLE").alias("plan_type"),
        F.when(n % 2 == 0, "ENS_A").otherwise("ENS_B").alias("ensemble_id"))


UNFOLDED_ROWS = 1_000_000                                # rows that a task unfolds a small file to


def _tasks(df: DataFrame, each: int) -> int:
    """Tasks over which rows are dealt that unfold to ``each`` rows apiece: files of one row group would be one task."""
    return -(-df.count() * each // UNFOLDED_ROWS) or 1


MAX_PLANS = 10_000                                       # plan numbers that fit into one literal array


def plan_map(spark, d) -> DataFrame:
    """Every unit in every plan of ``nation``: the plan numbers are unfolded on each unit."""
    plans = [r[0] for r in table(spark, d, "nation").select("n_nationkey").distinct().orderBy("n_nationkey").limit(MAX_PLANS + 1).collect()]
    if len(plans) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans")
    u, plain = unit(spark, d).select("vtd_geoid", "vtdkey", "county_fips"), table(spark, d, "customer")
    if (tasks := _tasks(plain, len(plans))) > 1:
        u = u.repartition(tasks, "vtdkey")
    u = u.withColumn("plan_no", F.explode(F.array(*[F.lit(n) for n in plans])))
    district = 1 + ((F.col("vtdkey") % 97) * (F.col("plan_no") + 1) + F.col("county_fips").cast("int")) % 37
    return u.select(F.concat(F.lit("P"), zfill("plan_no", 3)).alias("plan_id"), "vtd_geoid",
                    district.cast("string").alias("district_id"))


CHAIN = 450                                              # plans of the chain


def chain_map(spark, d) -> DataFrame:
    """A chain of plans, long: a unit moves on by seven districts in each plan that an order of its customer names."""
    u, key = unit(spark, d).select("vtd_geoid", "vtdkey"), F.col("o_custkey").alias("vtdkey")
    tasks = _tasks(table(spark, d, "customer"), CHAIN)
    u = u.repartition(tasks, "vtdkey")
    flips = table(spark, d, "orders").select(key, (F.col("o_orderkey") % CHAIN).alias("plan_no"), F.lit(1).alias("n")).where("plan_no >= 0")
    # the changes of a unit, and its first plan, each stand for the plans up to the next one: only they are shuffled
    marks = flips.unionByName(u.select("vtdkey", F.lit(0).cast("bigint").alias("plan_no"), F.lit(0).alias("n")))
    marks = marks.repartition(tasks, "vtdkey").groupBy("vtdkey", "plan_no").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("vtdkey").orderBy("plan_no")
    stays = marks.select("vtdkey", F.sum("n").over(order).alias("so_far"), F.col("plan_no").alias("low"),
                         (F.lead("plan_no", 1, CHAIN).over(order) - 1).alias("high"))
    return stays.join(shuffled(u), "vtdkey").withColumn("plan_no", F.explode(F.sequence("low", "high"))).select(
        "vtd_geoid", "plan_no", (1 + (F.col("vtdkey") + 7 * F.col("so_far")) % 37).cast("string").alias("district_id"))


def opp_def(spark, d=None) -> DataFrame:
    return definitions(spark, DEFS)


def unit_box(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k % 40).cast("double"), F.floor(k / 40).cast("double")
    return table(spark, d, "customer").select(k.alias("unit_idx"), x.alias("x0"), y.alias("y0"),
                                              (x + 1.0).alias("x1"), (y + 1.0).alias("y1"))


def block_box(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 50) * F.lit(0.8), F.floor(k / 50) * F.lit(0.9)
    return table(spark, d, "part").select(
        k.alias("block_idx"), x.alias("x0"), y.alias("y0"), (x + 0.8).alias("x1"), (y + 0.9).alias("y1"),
        F.col("p_size").cast("bigint").alias("pop"))


def with_rings(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", box_rings("x0", "y0", "x1", "y1"))


def param_draws(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("param"), F.col("event_id").alias("iter"), "value")


def support_draws(spark, d, groups) -> DataFrame:
    """Draws of six groups from the whole event stream, wide; an open last draw is filled with 0.5."""
    e = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 6).cast("bigint").alias("draw_id"), (F.col("event_id") % 6).alias("g"),
        logistic((F.col("value") - 10.0) / 10.0).alias("support"))
    return e.groupBy("draw_id").agg(*[
        F.coalesce(F.max(F.when(F.col("g") == i, F.col("support"))), F.lit(0.5)).alias(n) for i, n in enumerate(groups)])


def unit_returns(spark, d) -> DataFrame:
    """Wide votes of one office on the unit universe."""
    from wardatlas.operators import elections
    wide = elections.clean_returns(returns_tall(spark, d), "1-urgent")
    return elections.returns_by_unit(unit(spark, d), wide, "E1")


def features(spark, d) -> DataFrame:
    """Feature row per unit: four related shape measures, group shares, party shares."""
    k, a = F.col("c_custkey"), (F.col("c_acctbal") + 1000.0) / 11000.0
    shape = table(spark, d, "customer").select(
        k.alias("vtdkey"), (0.1 + 0.4 * a).alias("polsby_popper"), F.sqrt(0.1 + 0.4 * a).alias("schwartzberg"),
        (0.5 + 0.3 * a + 0.002 * ((k * 17) % 53)).alias("convex_hull_ratio"),
        (0.2 + 0.2 * a + 0.004 * ((k * 29) % 41)).alias("reock"))
    u = unit(spark, d)
    pct = [(F.col(c) / F.col("vap_total")).alias(n) for c, n in
           zip(("vap_nh_white", "vap_nh_black", "vap_nh_asian", "vap_hisp"), RACE)]
    r = unit_returns(spark, d).select(
        "vtd_geoid", F.coalesce("dem_share", F.lit(0.5)).alias("dem_share"),
        F.coalesce(F.try_divide("votes_rep", "votes_total"), F.lit(0.5)).alias("rep_share"))
    return u.select("vtd_geoid", "vtdkey", *pct).join(shuffled(shape), "vtdkey").join(shuffled(r), "vtd_geoid").select(
        F.col("vtdkey").alias("district_id"), *METRICS, *RACE, "dem_share", "rep_share")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


SQL: dict[str, str] = {
    "fx_unit": """
SELECT concat('48', lpad(cast(c_nationkey AS varchar),3,'0'), lpad(cast(c_custkey AS varchar),6,'0')) AS vtd_geoid,
       c_custkey AS vtdkey, '48' AS state_fips, lpad(cast(c_nationkey AS varchar),3,'0') AS county_fips,
       w+b+h+a+n+o AS vap_total, w AS vap_nh_white, b AS vap_nh_black, h AS vap_hisp, a AS vap_nh_asian, n AS vap_nh_native, o AS vap_other
FROM (SELECT c_custkey, c_nationkey, cast(20 + (c_custkey*7) % 61 + 3*(c_nationkey % 10) AS bigint) AS w,
             cast(5 + (c_custkey*11) % 43 AS bigint) AS b, cast(10 + (c_custkey*13) % 53 + 2*(c_nationkey % 7) AS bigint) AS h,
             cast((c_custkey*5) % 17 AS bigint) AS a, cast(c_custkey % 3 AS bigint) AS n, cast(c_custkey % 5 AS bigint) AS o FROM customer) t""",
    "fx_returns_tall": """
SELECT o_orderkey, cast(o_custkey AS varchar) AS vtdkeyvalue, o_orderpriority AS office,
       CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN ' rep ' ELSE 'I' END AS party,
       cast(floor(o_totalprice/1000) AS bigint) AS votes FROM orders""",
    "fx_plan": """
SELECT concat('P', lpad(cast(n_nationkey AS varchar),3,'0')) AS plan_id, n_nationkey AS plan_no,
       CASE WHEN n_nationkey < 2 THEN 'ENACTED' ELSE 'ENSEMBLE' END AS plan_type,
       CASE WHEN n_nationkey % 2 = 0 THEN 'ENS_A' ELSE 'ENS_B' END AS ensemble_id FROM nation""",
    "fx_plan_map": """
SELECT p.plan_id, u.vtd_geoid, cast(1 + ((u.vtdkey % 97) * (p.plan_no + 1) + cast(u.county_fips AS int)) % 37 AS varchar) AS district_id
FROM fx_unit u CROSS JOIN fx_plan p""",
    "fx_chain": """
SELECT u.vtd_geoid, p AS plan_no, cast(1 + (u.vtdkey + 7*sum(coalesce(n,0)) OVER (PARTITION BY u.vtdkey ORDER BY p)) % 37 AS varchar) AS district_id
FROM fx_unit u CROSS JOIN (SELECT unnest(range(450)) AS p) r
LEFT JOIN (SELECT o_custkey, o_orderkey % 450 AS plan_no, count(*) AS n FROM orders GROUP BY 1,2) f ON f.o_custkey = u.vtdkey AND f.plan_no = p""",
    "fx_opp_def": """
SELECT * FROM (VALUES ('BVAP','share_black_vap',0.185e0),('HVAP','share_hisp_vap',0.3e0),('MINVAP','share_minority_vap',0.562e0))
 AS t(opp_def_id, group_share_col, threshold)""",
    "fx_unit_box": """
SELECT c_custkey AS unit_idx, cast(c_custkey % 40 AS double) AS x0, cast(floor(c_custkey/40) AS double) AS y0,
       cast(c_custkey % 40 AS double)+1.0 AS x1, cast(floor(c_custkey/40) AS double)+1.0 AS y1 FROM customer""",
    "fx_block_box": """
SELECT p_partkey AS block_idx, (p_partkey % 50)*0.8e0 AS x0, floor(p_partkey/50)*0.9e0 AS y0,
       (p_partkey % 50)*0.8e0+0.8e0 AS x1, floor(p_partkey/50)*0.9e0+0.9e0 AS y1, cast(p_size AS bigint) AS pop FROM part""",
    "fx_param_draws": "SELECT event_type AS param, event_id AS iter, value FROM events",
    "fx_support": """
SELECT draw_id, g, coalesce(max(s), 0.5e0) AS support FROM (
  SELECT draws.draw_id, gs.g, e.s FROM (SELECT DISTINCT cast(floor(event_id/6) AS bigint) AS draw_id FROM events) draws
  CROSS JOIN (SELECT unnest(range(6)) AS g) gs
  LEFT JOIN (SELECT cast(floor(event_id/6) AS bigint) AS draw_id, event_id % 6 AS g, 1e0/(1e0+exp(-((value-10e0)/10e0))) AS s FROM events) e
    ON e.draw_id = draws.draw_id AND e.g = gs.g) t GROUP BY draw_id, g""",
    "fx_wide": """
SELECT cast(vtdkeyvalue AS bigint) AS vtdkey,
       cast(sum(CASE WHEN upper(trim(party)) IN ('D','DEM') THEN votes ELSE 0 END) AS bigint) AS dem_votes,
       cast(sum(CASE WHEN upper(trim(party)) IN ('R','REP') THEN votes ELSE 0 END) AS bigint) AS rep_votes,
       cast(sum(CASE WHEN upper(trim(party)) NOT IN ('D','DEM','R','REP') THEN votes ELSE 0 END) AS bigint) AS third_party_votes,
       cast(sum(votes) AS bigint) AS total_votes
FROM fx_returns_tall WHERE lower(trim(office)) = '1-urgent' GROUP BY 1""",
    "fx_unit_returns": """
SELECT 'E1' AS election_id, vtd_geoid, total_votes AS votes_total, dem_votes AS votes_dem, rep_votes AS votes_rep,
       third_party_votes AS votes_other, CASE WHEN total_votes > 0 THEN dem_votes / cast(total_votes AS double) END AS dem_share
FROM fx_unit LEFT JOIN fx_wide USING (vtdkey)""",
    "fx_features": """
SELECT u.vtdkey AS district_id, 0.1e0+0.4e0*a AS polsby_popper, sqrt(0.1e0+0.4e0*a) AS schwartzberg,
       0.5e0+0.3e0*a+0.002e0*((u.vtdkey*17)%53) AS convex_hull_ratio, 0.2e0+0.2e0*a+0.004e0*((u.vtdkey*29)%41) AS reock,
       vap_nh_white/cast(vap_total AS double) AS pct_white, vap_nh_black/cast(vap_total AS double) AS pct_black,
       vap_nh_asian/cast(vap_total AS double) AS pct_asian, vap_hisp/cast(vap_total AS double) AS pct_hispanic,
       coalesce(dem_share, 0.5e0) AS dem_share, coalesce(CASE WHEN votes_total > 0 THEN votes_rep/cast(votes_total AS double) END, 0.5e0) AS rep_share
FROM fx_unit u JOIN (SELECT c_custkey, (c_acctbal+1000e0)/11000e0 AS a FROM customer) c ON c.c_custkey = u.vtdkey
JOIN fx_unit_returns r USING (vtd_geoid)""",
    "fx_demo": """
SELECT plan_id, district_id, cast(sum(vap_total) AS bigint) AS vap_total, cast(sum(vap_nh_white) AS bigint) AS vap_nh_white,
       cast(sum(vap_nh_black) AS bigint) AS vap_nh_black, cast(sum(vap_hisp) AS bigint) AS vap_hisp,
       cast(sum(vap_nh_asian) AS bigint) AS vap_nh_asian, cast(sum(vap_nh_native) AS bigint) AS vap_nh_native,
       cast(sum(vap_other) AS bigint) AS vap_other,
       sum(vap_nh_white)/cast(sum(vap_total) AS double) AS share_white_vap, sum(vap_nh_black)/cast(sum(vap_total) AS double) AS share_black_vap,
       sum(vap_hisp)/cast(sum(vap_total) AS double) AS share_hisp_vap, 1e0-sum(vap_nh_white)/cast(sum(vap_total) AS double) AS share_minority_vap
FROM fx_plan_map JOIN fx_unit USING (vtd_geoid) GROUP BY plan_id, district_id""",
    "fx_opp": """
SELECT plan_id, district_id, opp_def_id, v AS opp_value, coalesce(v >= threshold, false) AS is_opportunity, share_minority_vap
FROM (SELECT *, CASE group_share_col WHEN 'share_black_vap' THEN share_black_vap WHEN 'share_hisp_vap' THEN share_hisp_vap
              ELSE share_minority_vap END AS v FROM fx_demo CROSS JOIN fx_opp_def) t""",
    "fx_metrics": """
SELECT plan_id, opp_def_id, cast(sum(CASE WHEN is_opportunity THEN 1 ELSE 0 END) AS bigint) AS n_opportunity_districts,
       avg(share_minority_vap) AS mean_minority_share FROM fx_opp GROUP BY plan_id, opp_def_id""",
    "fx_overlay": """
SELECT block_idx, unit_idx, (b.x1-b.x0)*(b.y1-b.y0) AS src_area,
       (least(b.x1,u.x1)-greatest(b.x0,u.x0))*(least(b.y1,u.y1)-greatest(b.y0,u.y0)) AS inter_area, pop
FROM fx_block_box b JOIN fx_unit_box u ON greatest(b.x0,u.x0) < least(b.x1,u.x1) AND greatest(b.y0,u.y0) < least(b.y1,u.y1)""",
    "fx_edges": """
SELECT a.unit_idx AS src, b.unit_idx AS dst, 1e0 AS shared_length FROM fx_unit_box a JOIN fx_unit_box b
  ON (b.x0 = a.x0 + 1 AND b.y0 = a.y0) OR (b.x0 = a.x0 AND b.y0 = a.y0 + 1)""",
}

NEEDS = {
    "fx_plan_map": ("fx_unit", "fx_plan"), "fx_chain": ("fx_unit",), "fx_wide": ("fx_returns_tall",), "fx_unit_returns": ("fx_unit", "fx_wide"),
    "fx_features": ("fx_unit_returns",), "fx_demo": ("fx_plan_map",), "fx_opp": ("fx_demo", "fx_opp_def"),
    "fx_metrics": ("fx_opp",), "fx_overlay": ("fx_block_box", "fx_unit_box"), "fx_edges": ("fx_unit_box",),
}


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views, and those they need, as common table expressions."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, ()):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    head = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)
    if head and body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body.strip()}" if head else body.strip()
