"""Sources, cleaning, joins, roll-ups, opportunity and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardatlas.functions import scalars as S
from wardatlas.operators import chain, elections, ensemble, keyed, opportunity, profile, rollup
from wardatlas.operators.joins import dimension, salted_join
from wardatlas.operators.order_stats import ecdf_positions, row_index
from wardatlas.plans import build_inputs
from wardatlas.sources import loaders, readers, writers
from wardatlas.storage import scratch_path
from wardatlas.tables import standard_names

from . import views as V
from .registry import case, r6

DEMO = ("vap_total, vap_nh_white, vap_nh_black, vap_hisp, vap_nh_asian, vap_nh_native, vap_other, "
        "round(share_white_vap,6) AS share_white_vap, round(share_black_vap,6) AS share_black_vap, "
        "round(share_hisp_vap,6) AS share_hisp_vap, round(share_minority_vap,6) AS share_minority_vap")


# ---- sources and sinks --------------------------------------------------------------------

@case("s1_read_by_extension", "SELECT p_partkey, p_name, p_size FROM part")
def s1(spark, d):
    """A table read through the extension dispatch."""
    return readers.read_table(spark, f"{d}/part.parquet").select("p_partkey", "p_name", "p_size")


@case("s2_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def s2(spark, d):
    """CSV written and scanned back with types found by whole-column checks."""
    path = scratch_path(spark, "customer") + ".csv"
    writers.write_artifact(V.table(spark, d, "customer").drop("c_acctbal"), path, "csv")
    return readers.read_table(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@case("s2_tsv_scan", "SELECT s_suppkey, s_name FROM supplier")
def s2t(spark, d):
    path = scratch_path(spark, "supplier") + ".tsv"
    V.table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_table(spark, path)


@case("s3_guessed_delimiter", "SELECT p_partkey, p_brand, p_size FROM part")
def s3(spark, d):
    """A .txt file whose delimiter is found from its head."""
    path = scratch_path(spark, "part") + ".txt"
    V.table(spark, d, "part").select("p_partkey", "p_brand", "p_size").write.option("sep", "|").option("header", True).csv(path)
    return readers.read_table(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@case("s4_fixed_width", "SELECT s_suppkey, s_nationkey FROM supplier")
def s4(spark, d):
    path = scratch_path(spark, "supplier") + ".txt"
    V.table(spark, d, "supplier").select(F.concat(
        F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad(F.col("s_nationkey").cast("string"), 4, " "))).write.text(path)
    df = readers.read_table(spark, path, widths=[("s_suppkey", 12), ("s_nationkey", 4)])
    return df.withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@case("s5_projected_scan", "SELECT DISTINCT c_mktsegment FROM customer")
def s5(spark, d):
    """Only the selected column leaves the parquet scan."""
    return V.table(spark, d, "customer").select("c_mktsegment").distinct()


@case("s6_auto_numeric", "SELECT lpad(cast(c_nationkey AS varchar),3,'0') AS county_fips, c_custkey AS n, round(c_acctbal,6) AS bal, c_name AS label FROM customer")
def s6(spark, d):
    """All-text table with numeric columns found and cast, ids left as text."""
    text = V.table(spark, d, "customer").select(
        S.zfill("c_nationkey", 3).alias("county_fips"), F.col("c_custkey").cast("string").alias("n"),
        F.col("c_acctbal").cast("string").alias("bal"), F.col("c_name").alias("label"))
    return r6(readers.auto_numeric(text))


@case("s7_typed_and_text_views", "SELECT count(*) AS n, cast(sum(n_nationkey) AS bigint) AS total, max(length(cast(n_nationkey AS varchar))) AS widest FROM nation, customer WHERE c_nationkey = n_nationkey")
def s7(spark, d):
    """Two views on one CSV: inferred types and all text."""
    path = scratch_path(spark, "nation")
    V.table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).write.option("header", True).csv(path)
    readers.register_views(spark, path, "raw_view")
    return spark.sql("SELECT count(*) AS n, sum(n_nationkey) AS total, "
                     "(SELECT CAST(max(length(n_nationkey)) AS bigint) FROM raw_view_str) AS widest FROM raw_view")


@case("s8_geojson_scan", "SELECT unit_idx, round(1e0,6) AS area FROM fx_unit_box", ("fx_unit_box",))
def s8(spark, d):
    """Polygons written as GeoJSON lines and read back as rings."""
    from wardatlas.functions import geometry as G
    path = scratch_path(spark, "units") + ".geojson"
    ring = F.transform(F.flatten("rings"), lambda p: F.array(p["x"], p["y"]))
    V.with_rings(V.unit_box(spark, d)).select(
        F.lit("Feature").alias("type"), F.struct("unit_idx").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).write.json(path)
    df = readers.read_table(spark, path)
    return r6(df.select(F.col("unit_idx").cast("bigint").alias("unit_idx"), G.area("rings").alias("area")))


@case("s9_file_corpus", "SELECT o_orderpriority AS contest, 2024 AS year, count(*) AS n, cast(sum(floor(o_totalprice/1000)) AS bigint) AS votes FROM orders GROUP BY 1")
def s9(spark, d):
    """Many CSV files in one folder; contest and year come from the file names."""
    base = scratch_path(spark, "corpus")
    rows = V.returns_tall(spark, d).select("office", "vtdkeyvalue", "party", "votes")
    rows.write.partitionBy("office").option("header", True).csv(base)           # one write, a folder per contest
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.Path(base + "/office=*")):
        name = f.getPath().getName().removeprefix("office=")
        fs.rename(f.getPath(), jvm.Path(f"{base}/2024_{name}_Election_Returns.csv"))
    df = readers.read_returns_corpus(spark, base)
    return df.groupBy("contest", "year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("votes").cast("bigint")).alias("votes"))


@case("s10_parquet_sink", "SELECT p_partkey, p_size FROM part")
def s10(spark, d):
    path = writers.write_parquet(V.table(spark, d, "part").select("p_partkey", "p_size"), scratch_path(spark, "part") + ".parquet")
    return spark.read.parquet(path)


@case("s11_export_csv", "SELECT plan_id, n_vtd FROM (SELECT plan_id, count(*) AS n_vtd FROM fx_plan_map GROUP BY plan_id) t", ("fx_plan_map",))
def s11(spark, d):
    path = writers.export_table(rollup.units_per_plan(V.plan_map(spark, d)), "unit_counts", scratch_path(spark, "export"), "csv")
    return readers.read_table(spark, path)


@case("s12_export_outputs", "SELECT 'district_demo_vap' AS written, count(*) AS n FROM fx_demo", ("fx_demo",))
def s12(spark, d):
    """Export of the result tables; the empty one is skipped."""
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    paths = writers.export_outputs({"district_demo_vap": demo, "district_returns": demo.where("vap_total < 0")}, scratch_path(spark, "out"))
    return spark.read.parquet(*paths).groupBy(F.lit("district_demo_vap").alias("written")).agg(F.count(F.lit(1)).alias("n"))


@case("s13_plan_map_sink", "SELECT ensemble_id, count(*) AS n, count(DISTINCT district_id) AS n_districts FROM fx_plan_map JOIN fx_plan USING (plan_id) WHERE ensemble_id = 'ENS_A' GROUP BY ensemble_id", ("fx_plan_map",))
def s13(spark, d):
    """Assignments as zstd parquet by ensemble; reading one ensemble prunes the rest."""
    rows = V.plan_map(spark, d).join(V.plan(spark, d).select("plan_id", "ensemble_id"), "plan_id")
    path = writers.write_plan_map(rows, scratch_path(spark, "plan_map"))
    return spark.read.parquet(path).where("ensemble_id = 'ENS_A'").groupBy("ensemble_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("district_id").alias("n_districts"))


@case("s14_geo_sink", "SELECT unit_idx, unit_idx % 50 AS vap_total, round(4e0,6) AS perimeter FROM fx_unit_box", ("fx_unit_box",))
def s14(spark, d):
    from wardatlas.functions import geometry as G
    rows = V.with_rings(V.unit_box(spark, d)).select("unit_idx", "rings", (F.col("unit_idx") % 50).alias("vap_total"))
    back = readers.read_geo_parquet(spark, writers.write_geo(rows, scratch_path(spark, "geo") + ".parquet"))
    return r6(back.select("unit_idx", "vap_total", G.perimeter("rings").alias("perimeter")))


@case("s15_metadata_rows", "SELECT plan_id, plan_type, 'CONGRESS' AS chamber, count(*) AS n_vtd FROM fx_plan_map JOIN fx_plan USING (plan_id) WHERE plan_type = 'ENACTED' GROUP BY plan_id, plan_type", ("fx_plan_map",))
def s15(spark, d):
    """Enacted-plan metadata rows joined to their assignment counts."""
    rows = writers.enacted_plan_row(spark, "P000", "2024", "CONGRESS", "ENS_A").unionByName(
        writers.enacted_plan_row(spark, "P001", "2024", "CONGRESS", "ENS_B"))
    return rows.select("plan_id", "plan_type", "chamber").join(rollup.units_per_plan(V.plan_map(spark, d)), "plan_id")


@case("s16_json_artifact", "SELECT count(*) AS n, round(avg(value),6) AS mean FROM events")
def s16(spark, d):
    """Summary written as JSON and read back."""
    m = r6(V.table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))
    return spark.read.schema("n bigint, mean double").json(writers.write_artifact(m, scratch_path(spark, "metrics")))


# ---- cleaning ------------------------------------------------------------------------------

@case("p1_standard_names", "SELECT c_custkey AS cust_id, c_name AS name FROM customer")
def p1(spark, d):
    return standard_names(V.table(spark, d, "customer").select(F.col("c_custkey").alias(" Cust_ID "), F.col("c_name").alias("NAME")))


@case("p5_block_geoid", "SELECT p_partkey, concat('48', lpad(cast(p_size AS varchar),3,'0'), lpad(cast(p_partkey AS varchar),6,'0'), lpad(cast(p_partkey % 10000 AS varchar),4,'0')) AS geoid20 FROM part")
def p5(spark, d):
    """15-digit block ids from their parts."""
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(
        k, F.lit("48").alias("state"), F.col("p_size").alias("fips"), k.alias("trt"), (k % 10000).alias("blk"))
    return build_inputs.with_geoid20(rows).select("p_partkey", "geoid20")


@case("p6_unit_geoid", "SELECT vtdkey, vtd_geoid FROM fx_unit", ("fx_unit",))
def p6(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("cntykey"), F.col("c_custkey").alias("vtdkey"))
    return build_inputs.with_unit_keys(rows).select("vtdkey", "vtd_geoid")


@case("p7_party", "SELECT CASE WHEN upper(trim(party)) = 'D' THEN 'DEM' WHEN upper(trim(party)) = 'REP' THEN 'REP' ELSE 'OTHER' END AS p, count(*) AS n FROM fx_returns_tall GROUP BY 1", ("fx_returns_tall",))
def p7(spark, d):
    return V.returns_tall(spark, d).groupBy(S.normalize_party("party").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@case("p8_office_filter", "SELECT o_orderkey, votes FROM fx_returns_tall WHERE lower(trim(office)) = '2-high'", ("fx_returns_tall",))
def p8(spark, d):
    return elections.one_office(V.returns_tall(spark, d), " 2-HIGH ").select("o_orderkey", "votes")


@case("p9_join_key_choice", "SELECT cast(vtdkeyvalue AS bigint) AS vtdkey, count(*) AS n FROM fx_returns_tall GROUP BY 1", ("fx_returns_tall",))
def p9(spark, d):
    rows, key = elections.unit_key(V.returns_tall(spark, d))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@case("p10_numeric_coercion", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE round(value,6) END AS v FROM events""")
def p10(spark, d):
    """Text that is no number, blank text and padded numbers."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "x").when(k == 1, "").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return r6(V.table(spark, d, "events").select("event_id", S.to_number(raw).alias("v")))


@case("p11_defaults", "SELECT vtd_geoid, county_fips, state_fips, cast(NULL AS varchar) AS county_name, cast(NULL AS double) AS area_km2, cast(NULL AS bigint) AS total_pop, vap_total, vap_nh_white, vap_nh_black, vap_hisp, vap_nh_asian, cast(0 AS bigint) AS vap_nh_native, vap_other FROM fx_unit", ("fx_unit",))
def p11(spark, d):
    """Unit loader: absent columns take their defaults, the county comes from the key."""
    return loaders.load_geo_vtd(spark, V.unit(spark, d).drop("vap_nh_native", "county_fips", "state_fips", "vtdkey"))


@case("p13_round_half_even", "SELECT p_partkey, cast(CASE WHEN abs(x - floor(x) - 0.5e0) < 1e-9 THEN 2*round(x/2) ELSE round(x) END AS bigint) AS n FROM (SELECT p_partkey, p_size / 2e0 AS x FROM part) t")
def p13(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.to_count(F.col("p_size") / 2.0).alias("n"))


@case("p14_share", "SELECT vtd_geoid, CASE WHEN vap_nh_asian > 0 THEN round(vap_other/cast(vap_nh_asian AS double),6) END AS s FROM fx_unit", ("fx_unit",))
def p14(spark, d):
    return r6(V.unit(spark, d).select("vtd_geoid", S.share("vap_other", "vap_nh_asian").alias("s")))


@case("p15_residual", "SELECT vtd_geoid, greatest(0, vap_total - vap_nh_white - 2*vap_hisp) AS rest FROM fx_unit", ("fx_unit",))
def p15(spark, d):
    return V.unit(spark, d).select("vtd_geoid", S.residual_count("vap_total", ["vap_nh_white", "vap_hisp", "vap_hisp"]).alias("rest"))


@case("p18_flags", "SELECT district_id, pct_white < 0.5e0 AS majority_minority, dem_share > rep_share AS democratic FROM fx_features", ("fx_features",))
def p18(spark, d):
    return V.features(spark, d).select("district_id", (F.col("pct_white") < 0.5).alias("majority_minority"),
                                       (F.col("dem_share") > F.col("rep_share")).alias("democratic"))


@case("p19_majority_group", """
SELECT vtd_geoid, CASE greatest(vap_nh_white, vap_nh_black, vap_nh_asian, vap_hisp) WHEN vap_nh_white THEN 'vap_nh_white' WHEN vap_nh_black THEN 'vap_nh_black'
 WHEN vap_nh_asian THEN 'vap_nh_asian' ELSE 'vap_hisp' END AS majority FROM fx_unit""", ("fx_unit",))
def p19(spark, d):
    return V.unit(spark, d).select("vtd_geoid", S.argmax_name(["vap_nh_white", "vap_nh_black", "vap_nh_asian", "vap_hisp"]).alias("majority"))


@case("p20_party_label", """
SELECT district_id, CASE WHEN dem_share > (SELECT quantile_cont(dem_share, 0.5) FROM fx_features) THEN 1 ELSE 0 END AS party FROM fx_features""", ("fx_features",))
def p20(spark, d):
    """No unit is democratic by count, so the median decides."""
    return profile.party_labels(V.features(spark, d).withColumn("rep_share", F.lit(2.0)), "district_id").select("district_id", "party")


@case("p20_tied_party_label", "SELECT 1 AS party, count(*)//2 AS n FROM customer UNION ALL SELECT 0, count(*) - count(*)//2 FROM customer")
def p20t(spark, d):
    """All shares equal: the upper half of the rows by a hash of the key."""
    rows = V.features(spark, d).withColumns({"dem_share": F.lit(0.4), "rep_share": F.lit(0.6)})
    return profile.party_labels(rows, "district_id").groupBy("party").agg(F.count(F.lit(1)).alias("n"))


@case("w7_median_split", "SELECT 1 AS party, count(*)//2 AS n, cast(0 AS bigint) AS n_low FROM events UNION ALL SELECT 0, count(*) - count(*)//2, count(*) FILTER (value < 5) FROM events")
def w7(spark, d):
    """More than half the rows share the largest value: the upper half is taken among them by a hash of the key."""
    e = V.table(spark, d, "events").select("event_id", "value", (F.least("value", F.lit(5.0)) / 100).alias("dem_share"), F.lit(0.9).alias("rep_share"))
    return profile.party_labels(e, "event_id").groupBy("party").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("n_low"))


@case("p21_percent_scale", "SELECT district_id, round(pct_white*100e0,6) AS pct_white, round(pct_black*100e0,6) AS pct_black FROM fx_features", ("fx_features",))
def p21(spark, d):
    return r6(profile.to_percent(V.features(spark, d).select("district_id", "pct_white", "pct_black"), ["pct_white", "pct_black"]))


@case("p22_district_number", "SELECT p_partkey, CASE WHEN p_partkey % 100 BETWEEN 1 AND 38 THEN cast(p_partkey % 100 AS int) END AS n FROM part")
def p22(spark, d):
    text = F.concat(F.lit("CD-"), S.zfill(F.col("p_partkey") % 100, 2))
    return V.table(spark, d, "part").select("p_partkey", S.district_number(text, 1, 38).alias("n"))


@case("p23_missing_profile", """
SELECT 'dem_share' AS "column", count(*) FILTER (dem_share IS NULL) AS missing_count FROM fx_unit_returns
UNION ALL SELECT 'votes_total', count(*) FILTER (votes_total IS NULL) FROM fx_unit_returns
UNION ALL SELECT 'vtd_geoid', count(*) FILTER (vtd_geoid IS NULL) FROM fx_unit_returns""", ("fx_unit_returns",))
def p23(spark, d):
    return profile.missing_profile(V.unit_returns(spark, d).select("vtd_geoid", "votes_total", "dem_share"))


@case("p24_describe", """
SELECT "column", count(v) AS n, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS sd, min(v) AS min, max(v) AS max,
 round(quantile_cont(v,0.25),6) AS p25, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.75),6) AS p75
FROM (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
 UNION ALL SELECT 'l_discount', l_discount FROM lineitem) t GROUP BY 1""")
def p24(spark, d):
    return r6(profile.describe(V.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@case("p24_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def p24s(spark, d):
    return profile.shape(V.table(spark, d, "lineitem"))


@case("p26_guards", "SELECT count(*) AS n, count(DISTINCT vtd_geoid) AS n_keys FROM fx_unit", ("fx_unit",))
def p26(spark, d):
    """Key and value guards passed before the counts are given out."""
    u = V.unit(spark, d)
    keyed.assert_keys(u, ["vtd_geoid"], "units")
    keyed.assert_none(u, S.to_number("vap_total").isNull(), "population that is no number", ["vtd_geoid"])
    return u.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vtd_geoid").alias("n_keys"))


@case("p27_enacted_map", "SELECT vtd_geoid, district_id FROM fx_plan_map WHERE plan_id = 'P000'", ("fx_plan_map",))
def p27(spark, d):
    rows = V.plan_map(spark, d).where("plan_id = 'P000'").withColumnRenamed("district_id", "district")
    return loaders.read_enacted_map(spark, rows)


@case("f2_cntyvtd", "SELECT c_custkey, concat(lpad(cast(c_nationkey AS varchar),3,'0'), lpad(cast(c_custkey AS varchar),6,'0')) AS cntyvtd FROM customer")
def f2(spark, d):
    rows = V.table(spark, d, "customer").select(
        "c_custkey", F.concat(S.zfill("c_nationkey", 3), F.lit("-"), S.zfill("c_custkey", 6)).alias("raw"))
    return elections.with_cntyvtd(rows, "raw").select("c_custkey", "cntyvtd")


@case("f7_json", """SELECT plan_id, n_vtd AS back, concat('{"plan_id":"', plan_id, '","n_vtd":', n_vtd, '}') AS doc
FROM (SELECT plan_id, count(*) AS n_vtd FROM fx_plan_map GROUP BY plan_id) t""", ("fx_plan_map",))
def f7(spark, d):
    rows = rollup.units_per_plan(V.plan_map(spark, d)).select("plan_id", F.to_json(F.struct("plan_id", "n_vtd")).alias("doc"))
    return rows.select("plan_id", F.from_json("doc", "plan_id string, n_vtd bigint")["n_vtd"].alias("back"), "doc")


@case("f1_text_functions", "SELECT p_partkey, upper(trim(p_brand)) AS up, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, starts_with(p_type, 'E') AS e FROM part")
def f1(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.upper(F.trim("p_brand")).alias("up"), S.digits_only("p_brand").alias("digits"),
                                            F.startswith("p_type", F.lit("E")).alias("e"))


@case("f4_math_functions", """
SELECT event_id, round(1e0/(1e0+exp(-(value/50e0))),6) AS sig, round(exp(-((value-20e0)/10e0)*((value-20e0)/10e0)/2e0)/(10e0*sqrt(2e0*pi())),6) AS dens,
 least(greatest(value,5e0),25e0) AS clipped, round(sqrt(abs(value)),6) AS root FROM events""")
def f4(spark, d):
    v = F.col("value")
    return r6(V.table(spark, d, "events").select("event_id", S.logistic(v / 50.0).alias("sig"), S.normal_density(v, 20.0, 10.0).alias("dens"),
                                                 S.clip(v, 5.0, 25.0).alias("clipped"), F.sqrt(F.abs(v)).alias("root")))


@case("f3_timestamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events")
def f3(spark, d):
    return V.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))


@case("f8_array_dot", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]),6)+0e0 AS total, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]),6) AS norm2 FROM embeddings")
def f8(spark, d):
    f = F.col("features")
    dot = F.aggregate(F.zip_with(f, f, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return r6(V.vectors(spark, d).select("vec_id", F.aggregate(f, F.lit(0.0), lambda s, v: s + v).alias("total"), dot.alias("norm2")))


@case("f5_conditionals_and_nulls", "SELECT vtd_geoid, coalesce(votes_total, 0) AS votes, CASE WHEN votes_total IS NULL THEN 'none' WHEN dem_share > 0.4e0 THEN 'dem' ELSE 'other' END AS lean FROM fx_unit_returns", ("fx_unit_returns",))
def f5(spark, d):
    return V.unit_returns(spark, d).select(
        "vtd_geoid", F.coalesce("votes_total", F.lit(0)).alias("votes"),
        F.when(F.col("votes_total").isNull(), "none").when(F.col("dem_share") > 0.4, "dem").otherwise("other").alias("lean"))


@case("f6_casts", "SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS whole, cast(o_custkey AS double) AS cust, cast(o_orderkey AS varchar) AS key FROM orders")
def f6(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("whole"),
                                              F.col("o_custkey").cast("double").alias("cust"), F.col("o_orderkey").cast("string").alias("key"))


@case("w2_row_index", "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def w2(spark, d):
    """Rows numbered in key order by the distributed ranking."""
    return row_index(V.table(spark, d, "events").select("event_id", "user_id"), "event_id")


@case("x6_load_returns", """SELECT 'E1' AS election_id, vtd_geoid, votes_total, votes_dem, votes_rep, cast(0 AS bigint) AS votes_other,
 round(CASE WHEN votes_total > 0 THEN votes_dem/cast(votes_total AS double) END,6) AS dem_share FROM fx_unit_returns""", ("fx_unit_returns",))
def x6r(spark, d):
    """Returns loader on text votes without the other-party column."""
    text = V.unit_returns(spark, d).select("election_id", "vtd_geoid", *[F.col(c).cast("string").alias(c) for c in ("votes_total", "votes_dem", "votes_rep")])
    return r6(loaders.load_election_returns(spark, text))


@case("x6_load_plans", "SELECT plan_id, plan_type, '2024' AS cycle, 'CONGRESS' AS chamber, ensemble_id, cast(NULL AS varchar) AS generator, cast(NULL AS bigint) AS seed, cast(NULL AS varchar) AS constraints_json, cast(NULL AS varchar) AS created_at FROM fx_plan WHERE plan_id IN (SELECT plan_id FROM fx_plan_map)", ("fx_plan_map",))
def x6p(spark, d):
    """Plan loader for the plans that hold assignments."""
    used = V.plan_map(spark, d).select("plan_id").distinct()
    p = V.plan(spark, d).join(used, "plan_id", "left_semi").select(
        "plan_id", "plan_type", F.lit("2024").alias("cycle"), F.lit("CONGRESS").alias("chamber"), "ensemble_id")
    return loaders.load_plan(spark, p)


@case("x6_load_plan_map", "SELECT plan_id, vtd_geoid, CASE WHEN plan_id = 'P003' THEN '1' ELSE district_id END AS district_id FROM fx_plan_map", ("fx_plan_map",))
def x6m(spark, d):
    """Assignments upserted over stored ones."""
    m = V.plan_map(spark, d)
    return loaders.load_plan_map(spark, m.where("plan_id = 'P003'").withColumn("district_id", F.lit("1")), base=m)


# ---- returns -------------------------------------------------------------------------------

@case("a1_votes_tall_to_wide", "SELECT vtdkey, dem_votes, rep_votes, third_party_votes, total_votes FROM fx_wide", ("fx_wide",))
def a1(spark, d):
    return elections.clean_returns(V.returns_tall(spark, d), "1-urgent")


@case("a2_sum_duplicate_keys", """
SELECT cast(vtdkeyvalue AS bigint) AS vtdkey, cast(sum(votes) AS bigint) AS dem_votes, cast(sum(2*votes) AS bigint) AS rep_votes, cast(0 AS bigint) AS third_party_votes,
 cast(sum(3*votes) AS bigint) AS total_votes FROM fx_returns_tall GROUP BY 1""", ("fx_returns_tall",))
def a2(spark, d):
    """Wide returns with repeated keys."""
    v = F.col("votes")
    rows = V.returns_tall(spark, d).select("vtdkeyvalue", v.alias("dem_votes"), (2 * v).alias("rep_votes"), (3 * v).alias("total_votes"))
    return elections.sum_by_key(elections.clean_returns(rows))


@case("j1_returns_on_units", "SELECT election_id, vtd_geoid, votes_total, votes_dem, votes_rep, votes_other, round(dem_share,6) AS dem_share FROM fx_unit_returns", ("fx_unit_returns",))
def j1(spark, d):
    return r6(V.unit_returns(spark, d))


@case("a14_offices", "SELECT DISTINCT trim(office) AS office FROM fx_returns_tall", ("fx_returns_tall",))
def a14(spark, d):
    return elections.offices(V.returns_tall(spark, d))


@case("a3_district_demo_vap", f"SELECT plan_id, district_id, {DEMO} FROM fx_demo", ("fx_demo",))
def a3(spark, d):
    return r6(rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d)))


RETURNS_SQL = """
SELECT plan_id, district_id, election_id, cast(sum(votes_total) AS bigint) AS votes_total, cast(sum(votes_dem) AS bigint) AS votes_dem,
 cast(sum(votes_rep) AS bigint) AS votes_rep, cast(sum(votes_other) AS bigint) AS votes_other,
 round(CASE WHEN sum(votes_total) > 0 THEN sum(votes_dem)/cast(sum(votes_total) AS double) END,6) AS dem_share
FROM fx_plan_map JOIN fx_unit_returns USING (vtd_geoid) GROUP BY 1,2,3"""


@case("a4_district_returns", RETURNS_SQL, ("fx_plan_map", "fx_unit_returns"))
def a4(spark, d):
    return r6(rollup.district_returns(V.plan_map(spark, d), V.unit_returns(spark, d)))


@case("j4_returns_of_reported_elections", RETURNS_SQL.replace("GROUP BY", "WHERE votes_total IS NOT NULL GROUP BY"), ("fx_plan_map", "fx_unit_returns"))
def j4(spark, d):
    """Units without a row in the returns drop out, as in a left join filtered on the right."""
    reported = V.unit_returns(spark, d).where("votes_total is not null")
    return r6(rollup.district_returns(V.plan_map(spark, d), reported))


@case("a11_returns_coverage", """
SELECT plan_id, district_id, election_id, count(*) AS n_vtd_assigned, count(votes_total) AS n_vtd_with_returns, round(count(votes_total)/cast(count(*) AS double),6) AS coverage
FROM fx_plan_map JOIN fx_unit_returns USING (vtd_geoid) GROUP BY 1,2,3""", ("fx_plan_map", "fx_unit_returns"))
def a11(spark, d):
    return r6(rollup.returns_coverage(V.plan_map(spark, d), V.unit_returns(spark, d)))


@case("a10_unit_counts", """SELECT count(*) AS n_plans, min(n) AS min_vtd, max(n) AS max_vtd, min(n) <> max(n) AS uneven
FROM (SELECT plan_id, count(*) AS n FROM fx_plan_map GROUP BY plan_id) t""", ("fx_plan_map",))
def a10(spark, d):
    return rollup.check_assignments(V.plan_map(spark, d), V.unit(spark, d))


@case("a15_population_deviation", """
SELECT plan_id, count(*) AS n_districts, cast(sum(p) AS bigint) AS total_pop, round(avg(p),6) AS ideal_pop, round(max(abs(p-m)/m),6) AS max_dev,
 round(CASE WHEN max(abs(p-m)/m) > 0.01e0 THEN max(abs(p-m)/m)+1e-6 ELSE 0.01e0 END,6) AS epsilon_used
FROM (SELECT plan_id, p, avg(p) OVER (PARTITION BY plan_id) AS m FROM (SELECT plan_id, district_id, sum(vap_total) AS p FROM fx_plan_map JOIN fx_unit USING (vtd_geoid) GROUP BY 1,2) t) u
GROUP BY plan_id""", ("fx_plan_map",))
def a15(spark, d):
    return r6(rollup.population_deviation(V.plan_map(spark, d), V.unit(spark, d)))


@case("j3_map_with_demographics", "SELECT plan_id, vtd_geoid, district_id, vap_total FROM fx_plan_map JOIN fx_unit USING (vtd_geoid)", ("fx_plan_map",))
def j3(spark, d):
    return V.plan_map(spark, d).join(dimension(V.unit(spark, d).select("vtd_geoid", "vap_total")), "vtd_geoid")


@case("j9_orphan_units", "SELECT vtd_geoid, plan_id, district_id FROM fx_plan_map WHERE vtd_geoid NOT IN (SELECT vtd_geoid FROM fx_unit WHERE vap_total >= 110)", ("fx_plan_map",))
def j9(spark, d):
    """Assignments whose unit is not among those with enough people."""
    return keyed.orphan_rows(V.plan_map(spark, d), V.unit(spark, d).where("vap_total >= 110"))


@case("j10_missing_nodes", "SELECT vtd_geoid FROM fx_unit WHERE vtdkey NOT IN (SELECT vtdkey FROM fx_wide)", ("fx_unit", "fx_wide"))
def j10(spark, d):
    """Units without a key in the returns."""
    voted = V.unit_returns(spark, d).where("votes_total is not null")
    return keyed.missing_keys(V.unit(spark, d), voted, ["vtd_geoid"])


@case("j12_checked_merge", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j12(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return keyed.checked_join(o, V.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


@case("j13_key_overlap", """
SELECT l.k AS left_key, r.k AS right_key, count(DISTINCT l.n) AS n_ids, count(DISTINCT r.n) AS n_matched, round(count(DISTINCT r.n)/cast(count(DISTINCT l.n) AS double),6) AS overlap
FROM (SELECT DISTINCT 's_suppkey' AS k, s_suppkey AS n FROM supplier UNION SELECT DISTINCT 's_nationkey', s_nationkey FROM supplier) l
CROSS JOIN (SELECT DISTINCT 'c_nationkey' AS k FROM customer) k2
LEFT JOIN (SELECT DISTINCT 'c_nationkey' AS k, c_nationkey AS n FROM customer) r0 ON r0.k = k2.k AND r0.n = l.n
CROSS JOIN LATERAL (SELECT k2.k AS k, r0.n AS n) r GROUP BY 1,2""")
def j13(spark, d):
    """How well two candidate keys of a table meet the key of another."""
    out = keyed.key_overlap(V.table(spark, d, "supplier"), V.table(spark, d, "customer"), ["s_suppkey", "s_nationkey"], ["c_nationkey"])
    return r6(out.select("left_key", "right_key", "n_ids", "n_matched", "overlap"))


@case("j14_join_quality", "SELECT count(*) AS total, count(votes_total) AS matched, round(count(votes_total)/cast(count(*) AS double),6) AS match_share, count(votes_total)/cast(count(*) AS double) < 0.8e0 AS low_match FROM fx_unit_returns", ("fx_unit_returns",))
def j14(spark, d):
    return r6(keyed.join_quality(V.unit_returns(spark, d), "votes_total"))


@case("j15_reindex_zero", "SELECT vtdkey, coalesce(total_votes,0) AS total_votes FROM fx_unit LEFT JOIN fx_wide USING (vtdkey)", ("fx_unit", "fx_wide"))
def j15(spark, d):
    totals = elections.clean_returns(V.returns_tall(spark, d), "1-urgent").select("vtdkey", "total_votes")
    return keyed.reindex_zero(V.unit(spark, d), totals, ["vtdkey"])


@case("j2_attribute_join", "SELECT p_partkey, p_brand, cast(sum(l_quantity) AS double) AS qty FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1,2")
def j2(spark, d):
    """Attributes left-joined to their base rows after being summed per key."""
    attrs = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"))
    return keyed.checked_join(V.table(spark, d, "part").select("p_partkey", "p_brand"), attrs, ["p_partkey"])


@case("a16_mean_per_key", "SELECT o_custkey, round(avg(o_totalprice),6) AS o_totalprice FROM orders GROUP BY 1")
def a16(spark, d):
    return r6(keyed.mean_per_key(V.table(spark, d, "orders").select("o_custkey", "o_totalprice"), "o_custkey"))


# ---- opportunity and ensembles ----------------------------------------------------------------

def _opp(spark, d):
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    return opportunity.district_opportunity(demo, V.opp_def(spark))


def _metrics(spark, d):
    return opportunity.plan_metrics(_opp(spark, d))


@case("j17_district_opportunity", "SELECT plan_id, district_id, opp_def_id, round(opp_value,6) AS opp_value, is_opportunity FROM fx_opp", ("fx_opp",))
def j17(spark, d):
    return r6(_opp(spark, d).drop("share_minority_vap"))


@case("a5_plan_metrics", "SELECT plan_id, opp_def_id, n_opportunity_districts, round(mean_minority_share,6) AS mean_minority_share FROM fx_metrics", ("fx_metrics",))
def a5(spark, d):
    return r6(_metrics(spark, d))


@case("j5_stored_opportunity_metrics", "SELECT plan_id, opp_def_id, n_opportunity_districts, round(mean_minority_share,6) AS mean_minority_share FROM fx_metrics", ("fx_metrics",))
def j5(spark, d):
    """The same from a stored opportunity table joined back to the district table."""
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    return r6(opportunity.plan_metrics(_opp(spark, d).drop("share_minority_vap"), demo))


DIST = """count(v) AS n_plans, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS sd, round(quantile_cont(v,0.01),6) AS p01, round(quantile_cont(v,0.05),6) AS p05,
 round(quantile_cont(v,0.10),6) AS p10, round(quantile_cont(v,0.25),6) AS p25, round(quantile_cont(v,0.50),6) AS p50, round(quantile_cont(v,0.75),6) AS p75,
 round(quantile_cont(v,0.90),6) AS p90, round(quantile_cont(v,0.95),6) AS p95, round(quantile_cont(v,0.99),6) AS p99, round(min(v),6) AS min, round(max(v),6) AS max"""
J = "(SELECT m.*, plan_type, ensemble_id, cast({m} AS double) AS v FROM fx_metrics m JOIN fx_plan USING (plan_id)) j"


@case("a6_ensemble_distribution", f"SELECT ensemble_id, opp_def_id, 'n_opportunity_districts' AS metric_name, {DIST} FROM {J.format(m='n_opportunity_districts')} WHERE plan_type = 'ENSEMBLE' GROUP BY 1,2", ("fx_metrics",))
def a6(spark, d):
    return r6(ensemble.ensemble_distribution(_metrics(spark, d), V.plan(spark, d)))


@case("a6_ensemble_distribution_pooled", f"SELECT ensemble_id, 'n_opportunity_districts' AS metric_name, {DIST} FROM {J.format(m='n_opportunity_districts')} WHERE plan_type = 'ENSEMBLE' GROUP BY 1", ("fx_metrics",))
def a6p(spark, d):
    """All definitions of an ensemble pooled."""
    return r6(ensemble.ensemble_distribution(_metrics(spark, d), V.plan(spark, d), by=()))


@case("a6_ensemble_distribution_share", f"SELECT ensemble_id, opp_def_id, 'mean_minority_share' AS metric_name, {DIST} FROM {J.format(m='mean_minority_share')} WHERE plan_type = 'ENSEMBLE' GROUP BY 1,2", ("fx_metrics",))
def a6s(spark, d):
    """A continuous metric, through the range-cut ranking."""
    return r6(ensemble.ensemble_distribution(_metrics(spark, d), V.plan(spark, d), "mean_minority_share"))


@case("a7_ensemble_draws", f"SELECT ensemble_id, plan_id, opp_def_id, v AS metric_value FROM {J.format(m='n_opportunity_districts')} WHERE plan_type = 'ENSEMBLE'", ("fx_metrics",))
def a7(spark, d):
    return ensemble.ensemble_draws(_metrics(spark, d), V.plan(spark, d))


@case("j6_metrics_with_plan", f"SELECT plan_id, opp_def_id, v AS metric_value, plan_type, ensemble_id FROM {J.format(m='n_opportunity_districts')}", ("fx_metrics",))
def j6(spark, d):
    return ensemble.metric_values(_metrics(spark, d), V.plan(spark, d), "n_opportunity_districts")


VERSUS = """
WITH j AS (SELECT * FROM {j}), e AS (SELECT * FROM j WHERE plan_type = 'ENSEMBLE'), t AS (SELECT * FROM j WHERE plan_type <> 'ENSEMBLE')
SELECT t.plan_id, t.plan_type, t.ensemble_id, t.opp_def_id, '{m}' AS metric_name, round(t.v,6) AS plan_value, count(*) AS n_draws,
 round(avg(CASE WHEN e.v <= t.v THEN 1e0 ELSE 0e0 END),6) AS percentile, round((t.v-avg(e.v))/nullif(stddev_samp(e.v),0e0),6)+0e0 AS z_score,
 round(avg(CASE WHEN e.v <= t.v THEN 1e0 ELSE 0e0 END),6) AS tail_prob_low, round(avg(CASE WHEN e.v >= t.v THEN 1e0 ELSE 0e0 END),6) AS tail_prob_high,
 round(t.v-avg(e.v),6)+0e0 AS delta_from_mean
FROM t JOIN e ON e.ensemble_id = t.ensemble_id AND e.opp_def_id = t.opp_def_id GROUP BY t.plan_id, t.plan_type, t.ensemble_id, t.opp_def_id, t.v"""


@case("a8_plan_vs_ensemble", VERSUS.format(j=J.format(m="n_opportunity_districts"), m="n_opportunity_districts"), ("fx_metrics",))
def a8(spark, d):
    """Where the enacted plans fall among their ensemble."""
    return r6(ensemble.plan_vs_ensemble(_metrics(spark, d), V.plan(spark, d)))


@case("a9_plan_vs_ensemble_share", VERSUS.format(j=J.format(m="mean_minority_share"), m="mean_minority_share"), ("fx_metrics",))
def a9(spark, d):
    return r6(ensemble.plan_vs_ensemble(_metrics(spark, d), V.plan(spark, d), "mean_minority_share"))


@case("j16_share_of_draws_at_most", """
SELECT event_type, event_id, value, round(count(*) FILTER (ev <= value) / cast(count(*) AS double), 6) AS percentile
FROM (SELECT a.event_type, a.event_id, a.value, b.value AS ev FROM events a JOIN events b USING (event_type)) t GROUP BY 1,2,3""")
def j16(spark, d):
    """Every event placed among all events of its type: as many targets as draws."""
    e = V.table(spark, d, "events").select("event_type", "event_id", "value")
    placed = ecdf_positions(e, e, ["event_type"], "value")
    return r6(salted_join(e, placed, ["event_type", "value"]).select(
        "event_type", "event_id", "value", (F.col("n_le") / F.col("n_draws")).alias("percentile")))


@case("w6_ecdf_positions", """
SELECT l_returnflag, l_quantity, round(max(cd),6) AS ecdf FROM (SELECT l_returnflag, l_quantity, cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS cd FROM lineitem) t GROUP BY 1,2""")
def w6(spark, d):
    """Empirical distribution at every value of a group that holds a large part of the rows."""
    e = V.table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    placed = ecdf_positions(e, e, ["l_returnflag"], "l_quantity")
    return r6(placed.select("l_returnflag", "l_quantity", (F.col("n_le") / F.col("n_draws")).alias("ecdf")))


@case("w3_chain_thinning", """
SELECT step, ensemble_id, concat(ensemble_id, '_', lpad(cast((step-5)//3 + 1 AS varchar), 6, '0')) AS plan_id, n_rows FROM
 (SELECT n_nationkey AS step, 'CH' AS ensemble_id, count(c_custkey) AS n_rows FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) t
WHERE step >= 5 AND (step-5) % 3 = 0""")
def w3(spark, d):
    """Burn-in and thinning of a chain whose steps are the nations, with their customer counts."""
    steps = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("step"), F.lit("CH").alias("ensemble_id"))
    rows = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return ensemble.thin_chain(steps, 5, 3).join(rows, "step", "left").select(
        "step", "ensemble_id", "plan_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@case("a13_plan_ids", "SELECT DISTINCT plan_id FROM fx_plan_map", ("fx_plan_map",))
def a13(spark, d):
    return ensemble.ensemble_plan_ids(V.plan_map(spark, d)).orderBy("plan_id")


@case("m25_ensemble_plan_rows", "SELECT DISTINCT plan_id, 'ENSEMBLE' AS plan_type, '2024' AS cycle, cast(NULL AS varchar) AS chamber, 'ENS_A' AS ensemble_id, 'recom' AS generator, cast(NULL AS bigint) AS seed, cast(NULL AS varchar) AS constraints_json, cast(NULL AS varchar) AS created_at FROM fx_plan_map", ("fx_plan_map",))
def m25(spark, d):
    return ensemble.ensemble_plans(V.plan_map(spark, d), "ENS_A", cycle="2024")


@case("x5_chain_metadata", """
SELECT plan_id, n AS n_districts, round(i,6) AS ideal_pop FROM (SELECT plan_id, count(*) AS n, avg(p) AS i FROM
 (SELECT plan_id, district_id, sum(vap_total) AS p FROM fx_plan_map JOIN fx_unit USING (vtd_geoid) GROUP BY 1,2) t GROUP BY 1) u""", ("fx_plan_map",))
def x5(spark, d):
    """Constraint record as JSON, read back, after the guard that the ensemble is not empty."""
    ensemble.require_ensemble(V.plan(spark, d), "ENS_A")
    dev = rollup.population_deviation(V.plan_map(spark, d), V.unit(spark, d))
    meta = ensemble.chain_metadata(dev, "ENS_A", epsilon=0.01, burnin=500, thin=10, n_steps=5000, pop_col="vap_total")
    back = F.from_json("constraints_json", "n_districts bigint, ideal_pop double")
    return r6(meta.select("plan_id", back["n_districts"].alias("n_districts"), back["ideal_pop"].alias("ideal_pop")))


@case("x3_definitions_applied", "SELECT opp_def_id, count(*) FILTER (is_opportunity) AS n FROM fx_opp GROUP BY 1", ("fx_opp",))
def x3(spark, d):
    return _opp(spark, d).groupBy("opp_def_id").agg(F.count_if("is_opportunity").alias("n"))


# ---- set operations and order -------------------------------------------------------------------

@case("u1_stacked_definitions", "SELECT plan_id, district_id, 'BVAP' AS opp_def_id, round(share_black_vap,6) AS v FROM fx_demo UNION ALL SELECT plan_id, district_id, 'HVAP', round(share_hisp_vap,6) FROM fx_demo", ("fx_demo",))
def u1(spark, d):
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    one = lambda i, c: demo.select("plan_id", "district_id", F.lit(i).alias("opp_def_id"), F.col(c).alias("v"))
    return r6(one("BVAP", "share_black_vap").unionByName(one("HVAP", "share_hisp_vap")))


@case("u2_all_plans", "SELECT plan_id, plan_type, CASE WHEN plan_type = 'ENACTED' THEN plan_no END AS plan_no FROM fx_plan p WHERE EXISTS (SELECT 1 FROM customer)", ("fx_plan",))
def u2(spark, d):
    p = V.plan(spark, d).select("plan_id", "plan_type", "plan_no")
    return keyed.stack_plans(p.where("plan_type = 'ENACTED'"), p.where("plan_type = 'ENSEMBLE'").drop("plan_no"))


@case("u3_missing_districts", "SELECT n AS district_id FROM (SELECT unnest(range(1,39)) AS n) t WHERE n NOT IN (SELECT cast(district_id AS bigint) FROM fx_plan_map)", ("fx_plan_map",))
def u3(spark, d):
    """Expected district numbers that no plan uses."""
    want = spark.range(1, 39).select(F.col("id").alias("district_id"))
    return keyed.missing_keys(want, V.plan_map(spark, d).select(F.col("district_id").cast("bigint").alias("district_id")), ["district_id"])


@case("u4_upsert", """
SELECT vtd_geoid, CASE WHEN vap_total >= 150 THEN cast(-1 AS bigint) ELSE vap_total END AS vap_total FROM fx_unit""", ("fx_unit",))
def u4(spark, d):
    base = V.unit(spark, d).select("vtd_geoid", "vap_total")
    new = base.where("vap_total >= 150").withColumn("vap_total", F.lit(-1).cast("bigint"))
    return keyed.upsert(base, new, ["vtd_geoid"])


@case("u4_bucketed_upsert", """
SELECT vtd_geoid, CASE WHEN vap_total >= 150 THEN cast(-1 AS bigint) ELSE vap_total END AS vap_total FROM fx_unit
UNION ALL SELECT concat('49', substr(vtd_geoid, 3)), vap_total FROM fx_unit WHERE vap_total < 60""", ("fx_unit",))
def u4b(spark, d):
    """Changed and new units upserted into a stored table, bucket by bucket."""
    base = V.unit(spark, d).select("vtd_geoid", "vap_total")
    path = keyed.write_buckets(base, scratch_path(spark, "units"), ["vtd_geoid"], 16)
    keyed.upsert_buckets(path, base.where("vap_total >= 150").withColumn("vap_total", F.lit(-1).cast("bigint")))
    keyed.upsert_buckets(path, base.where("vap_total < 60").withColumn("vtd_geoid", F.concat(F.lit("49"), F.substring("vtd_geoid", 3, 100))))
    return keyed.read_buckets(spark, path)


# ---- a chain of plans as runs --------------------------------------------------------------------

def _runs(spark, d):
    path = chain.write_runs(chain.to_runs(V.chain_map(spark, d)), scratch_path(spark, "runs"))
    return chain.read_runs(spark, path)


@case("s13_plan_runs", """
SELECT vtd_geoid, district_id, min(plan_no) AS first_plan, max(plan_no) AS last_plan FROM
 (SELECT *, plan_no - row_number() OVER (PARTITION BY vtd_geoid, district_id ORDER BY plan_no) AS g FROM fx_chain) t GROUP BY vtd_geoid, district_id, g""", ("fx_chain",))
def s13r(spark, d):
    """A chain written and read back as runs."""
    return _runs(spark, d)


@case("p1_runs_of_some_plans", "SELECT plan_no, vtd_geoid, district_id FROM fx_chain WHERE plan_no BETWEEN 100 AND 109", ("fx_chain",))
def p1r(spark, d):
    """Ten plans of the chain, long again."""
    path = chain.write_runs(chain.to_runs(V.chain_map(spark, d)), scratch_path(spark, "runs"))
    return chain.each_plan(chain.read_runs(spark, path, (100, 109)))


@case("a3_chain_demo_vap", """
SELECT plan_no, district_id, cast(sum(vap_total) AS bigint) AS vap_total, cast(sum(vap_nh_black) AS bigint) AS vap_nh_black, cast(sum(vap_hisp) AS bigint) AS vap_hisp,
 round(1e0-sum(vap_nh_white)/cast(sum(vap_total) AS double),6) AS share_minority_vap FROM fx_chain JOIN fx_unit USING (vtd_geoid) GROUP BY 1,2""", ("fx_chain", "fx_unit"))
def a3r(spark, d):
    """Demographics of every district of every plan of the chain, from the ends of runs."""
    out = chain.each_plan(chain.district_demo_vap(_runs(spark, d), V.unit(spark, d)))
    return r6(out.select("plan_no", "district_id", "vap_total", "vap_nh_black", "vap_hisp", "share_minority_vap"))


@case("a4_chain_returns", RETURNS_SQL.replace("plan_id", "plan_no").replace("fx_plan_map", "fx_chain"), ("fx_chain", "fx_unit_returns"))
def a4r(spark, d):
    """Votes of every district of the chain; NULL where no unit of a district has any."""
    return r6(chain.each_plan(chain.district_returns(_runs(spark, d), V.unit_returns(spark, d))))


@case("a15_chain_deviation", """
SELECT plan_no, count(*) AS n_districts, cast(sum(p) AS bigint) AS total_pop, round(avg(p),6) AS ideal_pop, round(max(abs(p-m)/m),6) AS max_dev,
 round(CASE WHEN max(abs(p-m)/m) > 0.01e0 THEN max(abs(p-m)/m)+1e-6 ELSE 0.01e0 END,6) AS epsilon_used
FROM (SELECT plan_no, p, avg(p) OVER (PARTITION BY plan_no) AS m FROM (SELECT plan_no, district_id, sum(vap_total) AS p FROM fx_chain JOIN fx_unit USING (vtd_geoid) GROUP BY 1,2) t) u
GROUP BY plan_no""", ("fx_chain", "fx_unit"))
def a15r(spark, d):
    """Population deviation of every plan of the chain."""
    return r6(chain.population_deviation(_runs(spark, d), V.unit(spark, d)))


@case("a10_chain_unit_counts", "SELECT plan_no, count(*) AS n_vtd FROM fx_chain GROUP BY 1", ("fx_chain",))
def a10r(spark, d):
    """Units per plan of the chain."""
    return chain.each_plan(chain.units_per_plan(_runs(spark, d)))


@case("u5_replace_where", "SELECT plan_id, n_opportunity_districts AS n FROM fx_metrics WHERE opp_def_id <> 'BVAP' UNION ALL SELECT plan_id, cast(0 AS bigint) FROM fx_metrics WHERE opp_def_id = 'BVAP'", ("fx_metrics",))
def u5(spark, d):
    m = _metrics(spark, d).select("plan_id", "opp_def_id", F.col("n_opportunity_districts").alias("n"))
    fresh = m.where("opp_def_id = 'BVAP'").withColumn("n", F.lit(0).cast("bigint"))
    return keyed.replace_where(m, fresh, F.col("opp_def_id") == "BVAP").drop("opp_def_id")


@case("o1_sorted_counts", "SELECT plan_id, count(*) AS n_vtd FROM fx_plan_map GROUP BY 1", ("fx_plan_map",))
def o1(spark, d):
    return rollup.units_per_plan(V.plan_map(spark, d)).orderBy("n_vtd", "plan_id")


@case("o2_top_districts", "SELECT plan_id, district_id, round(share_black_vap,6) AS s FROM fx_demo ORDER BY share_black_vap DESC, plan_id, district_id LIMIT 20", ("fx_demo",))
def o2(spark, d):
    """The twenty districts with the largest share."""
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    return r6(demo.select("plan_id", "district_id", F.col("share_black_vap").alias("s")).orderBy(F.desc("s"), "plan_id", "district_id").limit(20))


@case("o3_sorted_by_size", "SELECT vtd_geoid, vap_hisp - vap_nh_white AS diff FROM fx_unit", ("fx_unit",))
def o3(spark, d):
    return V.unit(spark, d).select("vtd_geoid", (F.col("vap_hisp") - F.col("vap_nh_white")).alias("diff")).orderBy(F.abs("diff").desc(), "vtd_geoid")


@case("o4_best_per_group", "SELECT plan_id, arg_max(district_id, (vap_total, -cast(district_id AS int))) AS district_id, max(vap_total) AS vap_total FROM fx_demo GROUP BY 1", ("fx_demo",))
def o4(spark, d):
    """Largest district of each plan, the lower number on a tie."""
    demo = rollup.district_demo_vap(V.plan_map(spark, d), V.unit(spark, d))
    return demo.groupBy("plan_id").agg(
        F.max_by("district_id", F.struct("vap_total", -F.col("district_id").cast("int"))).alias("district_id"), F.max("vap_total").alias("vap_total"))


@case("a23_value_counts", "SELECT district_id, count(*) AS n FROM fx_plan_map GROUP BY 1", ("fx_plan_map",))
def a23(spark, d):
    return V.plan_map(spark, d).groupBy("district_id").agg(F.count(F.lit(1)).alias("n"))


# ---- staged analysis ------------------------------------------------------------------------------

@case("x2_staged_analysis", VERSUS.format(j=J.format(m="n_opportunity_districts").replace(") j", " WHERE ensemble_id = 'ENS_A') j"), m="n_opportunity_districts"), ("fx_metrics",))
def x2(spark, d):
    """Load, sanity, aggregates, metrics and ensemble stages, each stored in a shared work folder."""
    from wardatlas.plans import analysis
    cfg, t = _analysis(spark, d), {}
    for stage in ("schema", "load", "sanity", "aggregates", "metrics", "ensemble"):
        t = analysis.run(spark, cfg, stage, t)
    return r6(t["plan_vs_ensemble"])


@case("x2_exported", VERSUS.format(j=J.format(m="n_opportunity_districts").replace(") j", " WHERE ensemble_id = 'ENS_A') j"), m="n_opportunity_districts"), ("fx_metrics",))
def x2e(spark, d):
    """All stages, with inference and export; the result is read back from the export folder."""
    from wardatlas.plans import analysis
    cfg = _analysis(spark, d, ei_election_id="E1", out_dir=scratch_path(spark, "exported"))
    t = analysis.run(spark, cfg, "all")
    if t["ei_posterior_district"].isEmpty():
        raise ValueError("the inference stage gave no districts")
    return r6(spark.read.parquet(f"{cfg.out_dir}/plan_vs_ensemble.parquet"))


def _analysis(spark, d, **more):
    """The study's tables as one analysis, with a work folder of its own."""
    from wardatlas.plans import analysis
    none = F.lit(None).cast("string")
    p = V.plan(spark, d).select("plan_id", "plan_type", none.alias("cycle"), none.alias("chamber"), "ensemble_id")
    elections_meta = writers.election_row(spark, "E1", 2024, "1-URGENT", "GENERAL")
    is_enacted = F.col("plan_id").isin("P000", "P001")
    m = V.plan_map(spark, d)
    cfg = analysis.AnalysisConfig(
        geo_vtd=V.unit(spark, d).drop("vtdkey"), elections=elections_meta, returns=V.unit_returns(spark, d),
        plans=p.where("plan_type = 'ENACTED'"), plan_map=m.where(is_enacted), ensemble_plans=p.where("plan_type = 'ENSEMBLE'"),
        ensemble_plan_map=m.where(~is_enacted), ensemble_id="ENS_A", work_dir=scratch_path(spark, "analysis"), definitions=V.DEFS, **more)
    return cfg
