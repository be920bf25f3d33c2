import pytest
from pyspark.sql import functions as F

from wardatlas import tables as T
from wardatlas.operators import elections as E
from wardatlas.operators import ensemble, keyed, opportunity, profile, rollup
from wardatlas.sources import loaders, readers, writers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_standard_names_collision(spark):
    with pytest.raises(ValueError):
        T.standard_names(spark.range(1).selectExpr("id AS a", "id AS ` A `"))


def test_upsert_replaces_adds_and_rejects_duplicates(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(keyed.upsert(base, new, ["k"]), "k") == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError, match="1 repeated keys"):
        keyed.upsert(base, new.unionAll(new.where("k = 'b'")), ["k"])


def test_checked_join_and_guards(spark):
    l = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    r = spark.createDataFrame([("a", "x")], "k string, w string")
    assert keyed.checked_join(l, r, ["k"], validate="m:1").count() == 2
    with pytest.raises(ValueError):
        keyed.checked_join(l, r, ["k"], validate="one_to_one")
    with pytest.raises(ValueError):
        keyed.assert_keys(spark.createDataFrame([(None,)], "k string"), ["k"], "t")
    with pytest.raises(ValueError, match="2 rows"):
        keyed.assert_none(l, F.col("v") > 0, "bad")
    with pytest.raises(ValueError, match="lacks 1 units"):
        keyed.require_full_cover(spark.createDataFrame([("z",)], "vtd_geoid string"), spark.createDataFrame([("a",)], "vtd_geoid string"))


def test_detect_join_key_order(spark):
    left = spark.createDataFrame([("x", "CD-01"), ("y", "CD-02")], "name string, district string")
    right = spark.createDataFrame([("4801",), ("4802",)], "geoid string")
    assert keyed.detect_join_key(left, right, ["name", "district"], ["geoid"]) == ("district", "geoid")
    with pytest.raises(KeyError):
        keyed.detect_join_key(left, right, ["name"], ["geoid"])
    assert keyed.find_district_column(right, ["geoid"], 1, 38) == "geoid"
    whole = spark.createDataFrame([(4801,), (4802,)], "geoid int")            # numbers are compared whole
    with pytest.raises(KeyError):
        keyed.detect_join_key(left, whole, ["district"], ["geoid"])


def test_offices(spark):
    df = spark.createDataFrame([("Gov", "D", "5", "1"), ("Sen", "R", "x", "1"), ("gov ", "R", None, "2")],
                               "office string, party string, votes string, vtdkeyvalue string")
    with pytest.raises(ValueError, match="several offices"):
        E.one_office(df)
    with pytest.raises(ValueError, match="no rows for office"):
        E.one_office(df, "mayor")
    got = rows(E.clean_returns(df, "GOV"), "vtdkey")
    assert got == [(1, 5, 0, 0, 5), (2, 0, 0, 0, 0)]


def test_tall_returns_drop_rows_without_key(spark):
    df = spark.createDataFrame([("D", "5", "x"), ("L", "2", "1"), ("", "3", "1")], "Party string, Votes string, VTDkeyvalue string")
    assert rows(E.clean_returns(df)) == [(1, 0, 0, 5, 5)]


def test_wide_returns_and_keys(spark):
    wide = spark.createDataFrame([("1", "3", "4", "7"), ("1", "1", None, "1")], "vtdkey string, dem_votes string, rep_votes string, total_votes string")
    assert rows(E.sum_by_key(E.clean_returns(wide))) == [(1, 4, 4, 0, 8)]
    with pytest.raises(ValueError):
        E.clean_returns(wide.drop("total_votes"))
    with pytest.raises(ValueError):
        E.unit_key(spark.range(1).toDF("a"))
    mixed = spark.createDataFrame([("x", " 9 ", "3", "4", "7")], "vtdkey string, cntyvtd string, dem_votes string, rep_votes string, total_votes string")
    assert E.unit_key(mixed)[1] == "cntyvtd" and rows(E.clean_returns(mixed)) == [(None, "9", 3, 4, 0, 7)]
    both = spark.createDataFrame([("1", " 3 ")], "vtdkeyvalue string, cntyvtd string")
    assert E.unit_key(both)[1] == "vtdkey" and E.unit_key(both, "cntyvtd")[1] == "cntyvtd"


def test_units_without_returns_keep_null(spark):
    units = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "vtd_geoid string, vtdkey bigint")
    wide = spark.createDataFrame([(1, 3, 1, 0, 4), (3, 0, 0, 0, 0)], "vtdkey bigint, dem_votes bigint, rep_votes bigint, third_party_votes bigint, total_votes bigint")
    got = rows(E.returns_by_unit(units, wide, "e"), "vtd_geoid")
    assert got == [("e", "u1", 4, 3, 1, 0, 0.75), ("e", "u2", None, None, None, None, None), ("e", "u3", 0, 0, 0, 0, None)]


def test_cntyvtd_width(spark):
    w = lambda v: E.cntyvtd_width(spark.createDataFrame([(x,) for x in v], "c string"), "c")
    assert (w(["1234567"]), w(["12-345"]), w(["12"]), w([None])) == (6, 5, 6, 6)


@pytest.fixture
def small(spark):
    units = spark.createDataFrame([("u1", 10, 5, 5, 0, 0, 0, 0), ("u2", 10, 2, 0, 8, 0, 0, 0), ("u3", 0, 0, 0, 0, 0, 0, 0)],
                                  "vtd_geoid string, vap_total bigint, vap_nh_white bigint, vap_nh_black bigint, vap_hisp bigint, "
                                  "vap_nh_asian bigint, vap_nh_native bigint, vap_other bigint")
    m = spark.createDataFrame([("p", "u1", "1"), ("p", "u2", "2"), ("p", "u3", "3"), ("q", "u1", "1"), ("q", "u2", "1")],
                              "plan_id string, vtd_geoid string, district_id string")
    return units, m


def test_rollup_and_flags(spark, small):
    units, m = small
    demo = rollup.district_demo_vap(m, units)
    by = {(r["plan_id"], r["district_id"]): r for r in demo.collect()}
    assert by[("p", "3")]["share_minority_vap"] is None and by[("q", "1")]["share_black_vap"] == 0.25
    opp = opportunity.district_opportunity(demo, opportunity.definitions(spark))
    flags = {(r["plan_id"], r["district_id"], r["opp_def_id"]): r["is_opportunity"] for r in opp.collect()}
    assert flags[("p", "1", "BVAP50")] and flags[("p", "2", "HVAP50")] and not flags[("p", "3", "MINVAP50")]
    metrics = {(r["plan_id"], r["opp_def_id"]): tuple(r)[2:] for r in opportunity.plan_metrics(opp).collect()}
    assert metrics[("p", "MINVAP50")] == (2, pytest.approx(0.65)) and metrics[("q", "BVAP50")] == (0, pytest.approx(0.65))
    stored = opportunity.plan_metrics(opp.drop("share_minority_vap"), demo)
    assert {(r["plan_id"], r["opp_def_id"]): tuple(r)[2:] for r in stored.collect()} == metrics
    with pytest.raises(ValueError, match="lacks"):
        opportunity.district_opportunity(demo, opportunity.definitions(spark, [("X", "X", "share_none", 0.5)]))


def test_sanity(spark, small):
    units, m = small
    assert tuple(rollup.check_assignments(m, units).first()) == (2, 2, 3, True)
    with pytest.raises(ValueError, match="1 assignment rows"):
        rollup.check_assignments(m, units.where("vtd_geoid <> 'u3'"))
    with pytest.raises(ValueError, match="empty"):
        rollup.check_assignments(m.where("false"), units)
    dev = {r["plan_id"]: r for r in rollup.population_deviation(m, units).collect()}
    assert dev["p"]["max_dev"] == pytest.approx(1.0) and dev["p"]["epsilon_used"] == pytest.approx(1.000001)
    assert dev["q"]["max_dev"] == 0 and dev["q"]["epsilon_used"] == 0.01


def test_returns_keep_partial_districts(spark, small):
    _, m = small
    ret = spark.createDataFrame([("e", "u1", 10, 4, 6, 0), ("e", "u2", None, None, None, None)],
                                "election_id string, vtd_geoid string, votes_total bigint, votes_dem bigint, votes_rep bigint, votes_other bigint")
    got = {(r["plan_id"], r["district_id"]): (r["votes_total"], r["dem_share"]) for r in rollup.district_returns(m, ret).collect()}
    assert got == {("p", "1"): (10, 0.4), ("p", "2"): (None, None), ("q", "1"): (10, 0.4)}
    cov = {(r["plan_id"], r["district_id"]): tuple(r)[3:] for r in rollup.returns_coverage(m, ret).collect()}
    assert cov[("q", "1")] == (2, 1, 0.5)


def test_ensemble_edge_cases(spark):
    plans = spark.createDataFrame([("e", "ENACTED", "A"), ("a", "ENSEMBLE", "A"), ("b", "ENSEMBLE", "A"), ("n", None, "A"), ("c", "ENSEMBLE", "B"), ("f", "ENACTED", "C")],
                                  "plan_id string, plan_type string, ensemble_id string")
    m = spark.createDataFrame([(p, "D", v) for p, v in (("e", 2), ("a", 2), ("b", 2), ("n", 9), ("c", 1), ("f", 3))],
                              "plan_id string, opp_def_id string, n_opportunity_districts bigint")
    got = {r["plan_id"]: r for r in ensemble.plan_vs_ensemble(m, plans).collect()}
    assert set(got) == {"e", "f"}
    assert (got["e"]["n_draws"], got["e"]["percentile"], got["e"]["tail_prob_high"], got["e"]["z_score"], got["e"]["delta_from_mean"]) == (2, 1.0, 1.0, None, 0.0)
    assert got["f"]["n_draws"] == 0 and got["f"]["percentile"] is None
    dist = {r["ensemble_id"]: r for r in ensemble.ensemble_distribution(m, plans).collect()}
    assert set(dist) == {"A", "B"} and dist["A"]["sd"] == 0 and dist["B"]["sd"] is None and dist["B"]["p99"] == 1
    with pytest.raises(ValueError):
        ensemble.require_ensemble(plans, "ZZ")
    with pytest.raises(ValueError):
        ensemble.metric_values(m, plans, "nothing")


def test_thinning(spark):
    steps = spark.range(0, 30).select(F.lit("E").alias("ensemble_id"), F.col("id").alias("step"))
    assert rows(ensemble.thin_chain(steps, 5, 10).select("step", "plan_id"), "step") == [(5, "E_000001"), (15, "E_000002"), (25, "E_000003")]


def test_loaders(spark, tmp_path):
    p = str(tmp_path / "geo.csv")
    spark.createDataFrame([("4800100001", "10", "1", "2", "3", "4", "0.6")], "vtd_geoid string, vap_total string, vap_nh_white string, "
                          "vap_nh_black string, vap_hisp string, vap_nh_asian string, vap_other string").write.option("header", True).csv(p)
    r = loaders.load_geo_vtd(spark, p).first()
    assert (r["vtd_geoid"], r["county_fips"], r["state_fips"], r["vap_other"], r["vap_nh_native"], r["area_km2"]) == ("4800100001", "001", "48", 1, 0, None)
    ret = spark.createDataFrame([("e", "u", "x", "3", "4")], "election_id string, vtd_geoid string, votes_total string, votes_dem string, votes_rep string")
    assert tuple(loaders.load_election_returns(spark, ret).first()) == ("e", "u", None, 3, 4, 0, None)
    with pytest.raises(ValueError, match="missing columns"):
        loaders.load_plan(spark, spark.range(1))
    enacted = loaders.read_enacted_map(spark, spark.createDataFrame([("u", 7)], "vtd_geoid string, district int"))
    assert tuple(enacted.first()) == ("u", "7")


def test_auto_numeric(spark):
    df = spark.createDataFrame([("01", "1", "1.5", "x", None), ("02", None, "2", "3", None)], "a_geoid string, b string, c string, d string, e string")
    assert dict(readers.auto_numeric(df).dtypes) == {"a_geoid": "string", "b": "bigint", "c": "double", "d": "string", "e": "string"}


def test_readers_and_writers(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.feather")
    txt = tmp_path / "a.txt"
    txt.write_text("a;b\n1;x\n2;y\n")
    assert rows(readers.read_table(spark, str(txt)), "a") == [(1, "x"), (2, "y")]
    fixed = tmp_path / "f.txt"
    fixed.write_text("id  nm \n1   ab \n22  c  \n")
    assert rows(readers.read_table(spark, str(fixed), widths=[("id", 4), ("nm", 3)]), "id") == [(1, "ab"), (22, "c")]
    with pytest.raises(ValueError, match="widths"):
        readers.read_table(spark, str(fixed))
    with pytest.raises(ValueError, match="format"):
        writers.export_table(spark.range(1), "t", str(tmp_path), "xml")
    with pytest.raises(ValueError, match="without a value"):
        writers.write_geo(spark.range(1).selectExpr("NULL AS rings", "1 AS vap_total"), str(tmp_path / "g"))
    corpus = tmp_path / "c"
    corpus.mkdir()
    (corpus / "2024_House_Dist_2_(2nd)_Election_Returns.csv").write_text("County,vtdkeyvalue,Party,Votes\nA,1,D,5\n")
    (corpus / "2023_House_District_2_Election_VRTO.csv").write_text("County,vtdkey,TotalTO\nA,1,9\n")
    got = readers.read_corpus(spark, str(corpus)).select("kind", "contest", "year", "vtdkeyvalue", "votes", "totalto")
    assert rows(got, "kind") == [("returns", "House_Dist_2_(2nd)", 2024, "1", "5", None), ("turnout", "House_District_2", 2023, "1", None, "9")]


def test_profile(spark):
    df = spark.createDataFrame([(1, "", 0.2), (2, None, None), (3, "x", 1.0)], "id int, s string, v double")
    assert rows(profile.missing_profile(df)) == [("s", 2), ("v", 1), ("id", 0)]
    assert profile.value_scale(df, ["v"]) == "0-1" and profile.value_scale(df, ["id"]) == "0-100"
    assert profile.value_scale(df.where("false"), ["v"]) == "0-100"
    assert rows(profile.schema_listing(df))[2] == (2, "v", "double")


@pytest.mark.parametrize("n", [10, 11])
def test_party_labels_have_two_classes(spark, n):
    tied = spark.range(n).select(F.col("id"), F.lit(0.4).alias("dem_share"), F.lit(0.6).alias("rep_share"))
    assert profile.party_labels(tied, "id").agg(F.sum("party")).first()[0] == n // 2
    mixed = spark.createDataFrame([(i, 0.1 if i < 3 else 0.4, 0.9) for i in range(n)], "id bigint, dem_share double, rep_share double")
    out = profile.party_labels(mixed, "id").where("dem_share = 0.1").agg(F.max("party")).first()[0]
    assert out == 0 and profile.party_labels(mixed, "id").agg(F.sum("party")).first()[0] == n // 2
    plain = mixed.withColumn("dem_share", F.when(F.col("id") == 0, 0.95).otherwise(F.col("dem_share")))
    assert profile.party_labels(plain, "id").agg(F.sum("party")).first()[0] == 1


def test_missing_keys_shuffles_keys_and_not_rows(spark):
    """Rows in which a key repeats are combined first and never broadcast, however small Spark takes them for."""
    from wardatlas.operators import keyed
    present = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("i"), F.col("id").alias("k"))
    gone = keyed.missing_keys(spark.range(5).select(F.col("id").alias("k")), present, ["k"])
    text = gone._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and text.count("HashAggregate(keys=[k") == 4
    assert sorted(r["k"] for r in gone.collect()) == [3, 4]
