import duckdb
import pytest
from pyspark.sql import functions as F

from casebook import ORACLES, QUERIES
from casebook import views as V
from wardatlas.functions.geometry import box_rings
from wardatlas.operators import inference
from wardatlas.plans import analysis, build_inputs
from wardatlas.sources import writers


def boxes(spark, rows, names):
    df = spark.createDataFrame(rows, names + ", x0 double, y0 double, x1 double, y1 double")
    return df.select(*[c for c in df.columns if c not in ("x0", "y0", "x1", "y1")], box_rings("x0", "y0", "x1", "y1").alias("rings"))


def test_build_inputs_small(spark, tmp_path):
    units = boxes(spark, [(1, 10, 0.0, 0.0, 2.0, 2.0), (1, 11, 2.0, 0.0, 4.0, 2.0), (1, 12, 9.0, 9.0, 10.0, 10.0)], "CNTYKEY int, VTDKEY int")
    districts = boxes(spark, [("7", 0.0, 0.0, 2.5, 2.0), ("8", 2.5, 0.0, 4.0, 2.0)], "District string")
    blocks = boxes(spark, [("1", 0.0, 0.0, 1.0, 1.0), ("2", 1.5, 0.0, 2.5, 1.0)], "GEOID20 string")
    pl = spark.createDataFrame([("1", "10", "5", "2", "1", "1"), ("000000000000002", "8", "8", "0", "x", "0")],
                               "geoid20 string, vap string, anglovap string, blackvap string, hispanicvap string, asianvap string")
    votes = spark.createDataFrame([("Gov", "D", "5", "10"), ("Gov", "R", "3", "10"), ("Gov", "", "2", "11")], "Office string, Party string, Votes string, vtdkeyvalue string")
    cfg = build_inputs.InputConfig(districts, blocks, units, pl, votes, str(tmp_path / "out"), "ENACTED", "E", "2024", "CONGRESS", "G24", 2024, "Gov", "GENERAL", "gov")
    t = build_inputs.build_inputs(spark, cfg)
    assert {r["vtd_geoid"]: r["district_id"] for r in t["plan_district_vtd"].collect()} == {"48001000010": "7", "48001000011": "8", "48001000012": None}
    g = {r["vtd_geoid"]: r for r in t["geo_vtd"].collect()}
    assert (g["48001000010"]["vap_total"], g["48001000011"]["vap_total"], g["48001000012"]["vap_total"]) == (14, 4, 0)
    assert g["48001000010"]["vap_other"] == 1 and g["48001000010"]["vap_nh_native"] == 0
    r = {x["vtd_geoid"]: (x["votes_total"], x["dem_share"]) for x in t["election_returns_vtd"].collect()}
    assert r == {"48001000010": (8, 0.625), "48001000011": (2, 0.0), "48001000012": (None, None)}
    assert t["vtds_geo"].count() == 3 and t["plans"].first()["plan_type"] == "ENACTED"
    with pytest.raises(ValueError, match="lack the groups"):
        build_inputs.group_columns(pl.drop("asianvap"))
    assert build_inputs.group_columns(pl.drop("asianvap"), allow_total_only=True) == ("vap", {})
    with pytest.raises(ValueError, match="unreadable"):
        build_inputs.with_unit_keys(units.withColumn("VTDKEY", F.lit("x")))


def test_stages_one_by_one_and_all(spark, data, tmp_path):
    none = F.lit(None).cast("string")
    p = V.plan(spark, data).select("plan_id", "plan_type", none.alias("cycle"), none.alias("chamber"), "ensemble_id")
    m = V.plan_map(spark, data)
    base = dict(geo_vtd=V.unit(spark, data).drop("vtdkey"), elections=writers.election_row(spark, "E1", 2024, "x", "GEN"),
                returns=V.unit_returns(spark, data), plans=p, plan_map=m, ensemble_id="ENS_A", ei_election_id="E1", replicates=50, definitions=V.DEFS)
    cfg = analysis.AnalysisConfig(**base, work_dir=str(tmp_path / "work"), out_dir=str(tmp_path / "out"))
    t = analysis.run(spark, cfg)
    assert t["ei_posterior_district"].count() == t["district_demo_vap"].join(p.where("ensemble_id = 'ENS_A'"), "plan_id").count()
    assert spark.read.parquet(str(tmp_path / "out" / "plan_vs_ensemble.parquet")).count() == 3
    first = sorted(tuple(r) for r in t["plan_vs_ensemble"].collect())
    again = analysis.run(spark, cfg, "ensemble")                     # a later session: tables come from the work folder
    assert sorted(tuple(r) for r in again["plan_vs_ensemble"].collect()) == first
    assert t["ei_posterior_group"].count() == len(inference.GROUPS)
    with pytest.raises(ValueError):
        analysis.run(spark, cfg, "nonsense")
    with pytest.raises(ValueError, match="needs geo_vtd"):
        analysis.run(spark, analysis.AnalysisConfig(), "load")


def test_district_features(spark, data):
    from wardatlas.operators import rollup
    m, u, r = V.plan_map(spark, data).where("plan_id = 'P000'"), V.unit(spark, data), V.unit_returns(spark, data)
    demo, ret = rollup.district_demo_vap(m, u), rollup.district_returns(m, r)
    shapes = demo.select("district_id", box_rings(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("rings"))
    f = build_inputs.district_features(demo, ret, shapes)
    assert f.count() == demo.count() and f.where("reock is null or pct_white is null").count() == 0


FAST = ["a3_district_demo_vap", "a4_district_returns", "a6_ensemble_distribution", "a8_plan_vs_ensemble", "g1_overlay_boxes", "g8_cut_edges",
        "m21_inference_design", "m23_projected_draws", "a22_split_rhat", "m7_cluster_scores", "j16_share_of_draws_at_most"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(repr(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
    df = QUERIES[name](spark, data)
    got = sorted(tuple(repr(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert sorted(df.columns) == sorted(cols) and got == want


def test_every_query_but_the_random_ones_has_a_twin():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(QUERIES) - len(ORACLES) <= 11             # the corpus queries are held against brute force in their own tests
