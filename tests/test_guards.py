"""Inputs that must stop a job, or must not change its answer."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardatlas.functions import geometry as G
from wardatlas.operators import clustering as C
from wardatlas.operators import inference, moments, order_stats, overlay, profile, regression
from wardatlas.sources import readers


@pytest.fixture(scope="module")
def holes(spark):
    """Forty rows in four tasks, one NULL in each."""
    rows = [(i, None if i % 10 == 3 else float(i % 7), float(i % 3), float(i % 2)) for i in range(40)]
    return spark.createDataFrame(rows, "id int, a double, b double, y double").repartitionByRange(4, "id")


def test_a_missing_value_stops_every_model(spark, holes):
    with pytest.raises(ValueError, match="4 rows"):
        moments.grams(holes, ["a", "b"])
    with pytest.raises(ValueError, match="4 rows"):
        regression.search(holes, "id", "y", ["a", "b"], folds=2)
    with pytest.raises(ValueError, match="4 rows"):
        regression.influence(holes, ["a", "b"], "y")
    with pytest.raises(ValueError, match="4 of 40"):
        C.fit_kmeans(C.as_features(holes, ["a", "b"]), 2)
    with pytest.raises(Exception, match="NULL, NaN or infinite"):
        C.predict(C.as_features(holes, ["a", "b"]), np.zeros((2, 2))).collect()
    design = holes.selectExpr("cast(id as string) as vtd_geoid", "10 as votes_total", "5 as votes_dem", "a as WHITE_NH", "b as HISP")
    with pytest.raises(Exception, match="NULL, NaN or infinite"):
        inference.support_draws(design, 5, groups=("WHITE_NH", "HISP")).collect()
    whole = holes.where("a is not null")
    assert moments.grams(whole, ["a", "b"])[0][0, 0] == pytest.approx(sum(float(i % 7) ** 2 for i in range(40) if i % 10 != 3))


def test_both_ways_over_draws_agree(spark):
    comp = spark.createDataFrame([("P", str(i), 0.1 * i, 1 - 0.1 * i) for i in range(11)], "plan_id string, district_id string, W double, H double")
    draws = spark.createDataFrame([(i, 0.4 + 0.02 * i, 0.5) for i in range(12)], "draw_id int, W double, H double")
    one, two = ({r["district_id"]: [round(v, 9) for v in r[2:]] for r in inference.project_draws(comp, draws, ("W", "H"), draw_limit=n).collect()} for n in (100, 0))
    assert one == two and one["0"][0] == 0.0                          # 0.5 is no win in either
    bad = draws.union(spark.createDataFrame([(99, None, 0.5)], draws.schema))
    for n in (100, 0):
        with pytest.raises(ValueError, match="draws: 1 rows"):
            inference.project_draws(comp, bad, ("W", "H"), draw_limit=n)


def test_seeds_come_from_all_rows(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (200, 2)) for c in ((0, 0), (9, 0), (0, 9))] + [[[500.0, 500.0]]])
    df = C.as_features(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, u double, v double"), ["u", "v"])
    found, weights = C.seed_rows(df, 4)
    assert weights.sum() == len(x) and len(found) < 120 and [500.0, 500.0] in found.tolist()
    assert C.seed_rows(df.repartition(7), 4)[0].tolist() == found.tolist()                 # no matter how rows fall on tasks
    centers, _ = C.fit_kmeans(df, 4, 1, 2)
    assert sorted(np.round(centers).astype(int).tolist()) == [[0, 0], [0, 9], [9, 0], [500, 500]]


def test_squared_silhouette_of_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    df = C.as_features(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double"), list("abc"))
    models = [x[:3], x[5:10]]
    got = C.model_silhouettes(df, models)
    for m, value in zip(models, got):
        want = C.linear_silhouette(C.predict(df, m), "cluster", 3).agg(F.avg("silhouette")).first()[0]
        assert value == pytest.approx(want)


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in (*pts, pts[0])]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4))


def outlines(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("turn", [False, True])
def test_outlines_drawn_either_way(spark, turn):
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1))
    a = [SQUARE, hole]
    a = [r[::-1] for r in a] if turn else a
    src = outlines(spark, (1, a)).withColumnRenamed("id", "s")
    dst = outlines(spark, (2, [ring((0, 0), (2, 0), (2, 4), (0, 4))])).withColumnRenamed("id", "t")
    pair = overlay.overlay_polygons(src, dst, "s", "t").first()
    assert pair["inter_area"] == pytest.approx(7.0) and pair["src_area"] == pytest.approx(15.0)
    both = outlines(spark, (1, a), (2, [ring((4, 0), (8, 0), (8, 4), (4, 4))]))
    assert [tuple(r) for r in overlay.adjacency(both, "id").collect()] == [(1, 2, 4.0)]


def test_hole_wound_like_its_shell_is_reported(spark):
    hole, island = ring((1, 1), (3, 1), (3, 3), (1, 3)), ring((1.5, 1.5), (2, 1.5), (2, 2), (1.5, 2))
    got = {r["id"]: r["reason"] for r in outlines(spark, (1, [SQUARE, hole]), (2, [SQUARE, hole[::-1]]), (3, [SQUARE, hole[::-1], island])).select(
        "id", G.invalid_reason("rings").alias("reason")).collect()}
    assert got == {1: "hole wound like its shell", 2: None, 3: None}


def test_borders_shared_in_part(spark):
    units = outlines(spark, (1, [SQUARE]), (2, [ring((4, 0), (6, 0), (6, 1.5), (4, 1.5))]), (3, [ring((4, 1.5), (6, 1.5), (6, 4), (4, 4))]),
                     (4, [ring((0, 4), (6, 4), (6, 5), (0, 5))]), (5, [ring((10, 0), (14, 0), (14, 4), (10, 4))]))
    got = {(r["src"], r["dst"]): r["shared_length"] for r in overlay.adjacency(units, "id").collect()}
    assert got == pytest.approx({(1, 2): 1.5, (1, 3): 2.5, (2, 3): 2.0, (1, 4): 4.0, (3, 4): 2.0})
    tilted = outlines(spark, (1, [ring((0, 0), (3, 1), (2, 4), (-1, 3))]), (2, [ring((3, 1), (6, 2), (5, 5), (2, 4))]), (3, [ring((2.5, 2.5), (2, 4), (2.4, 3.9))]))
    assert overlay.adjacency(tilted.where("id < 3"), "id").first()["shared_length"] == pytest.approx(np.sqrt(10))


def test_each_pair_is_clipped_once_after_the_deal(spark):
    a, b = outlines(spark, (1, [SQUARE])).withColumnRenamed("id", "s"), outlines(spark, (2, [SQUARE])).withColumnRenamed("id", "t")
    plan = overlay.overlay_polygons(a, b, "s", "t")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_row_index_wants_a_key(spark):
    rows = [(3, "c"), (1, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "k int, v string")
    assert {r["v"]: r["row_index"] for r in order_stats.row_index(df, "k").collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="1 rows have no k"):
        order_stats.row_index(df.union(spark.createDataFrame([(None, "x")], df.schema)), "k")
    with pytest.raises(Exception, match="k occurs twice: 3"):
        order_stats.row_index(df.union(df.limit(1)), "k").collect()


def test_ranks_pair_by_pair(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(50, 3)), 1)
    x[::7, 1] = np.nan
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double")
    import pandas as pd
    want = pd.DataFrame(x, columns=list("abc")).corr(method="spearman")
    for r in profile.spearman(df, "id", list("abc")).collect():
        assert r["corr"] == pytest.approx(want.loc[r["col_a"], r["col_b"]])
    assert profile.describe(df, ["b"]).first()["n"] == int((~np.isnan(x[:, 1])).sum())


FEATURE = {"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}}


def test_geojson_of_any_form(spark, tmp_path):
    (tmp_path / "lines.geojson").write_text("\n".join(json.dumps(FEATURE) for _ in range(2)))
    (tmp_path / "pretty.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [FEATURE] * 3}, indent=1))
    head = json.dumps({"type": "FeatureCollection"})[:-1] + ', "features": [\n'
    (tmp_path / "rows.geojson").write_text(head + ",\n".join(json.dumps(FEATURE) for _ in range(4)) + "\n]}")
    df = readers.read_geojson(spark, str(tmp_path))
    assert df.count() == 9 and df.where("k is null or rings is null").count() == 0
    (tmp_path / "cut.geojson").write_text(json.dumps(FEATURE) + "\n" + json.dumps(FEATURE)[:60])
    with pytest.raises(Exception, match="not a GeoJSON feature"):
        readers.read_geojson(spark, str(tmp_path)).collect()


def test_wkb_both_ways(spark):
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1))
    df = outlines(spark, (1, [SQUARE, hole, ring((9, 9), (10, 9), (10, 10), (9, 10))]), (2, None))
    back = df.select("id", readers.wkb_from_rings("rings").alias("geometry"))
    got = {r["id"]: r["rings"] for r in readers.decode_geometry(back).collect()}
    want = {r["id"]: r["rings"] for r in df.collect()}
    assert got == want
    flat = [(0.0, 0.0, 5.0), (1.0, 0.0, 5.0), (1.0, 1.0, 5.0), (0.0, 0.0, 5.0)]
    body = struct.pack("<I", 1) + struct.pack("<I", 4) + b"".join(struct.pack("<3d", *p) for p in flat)
    forms = [struct.pack("<BI", 1, 1003) + body, struct.pack("<BII", 1, 0xA0000003, 4326) + body]
    for blob in forms:
        one = readers.decode_geometry(spark.createDataFrame([(bytearray(blob),)], "geometry binary")).first()["rings"]
        assert [(p["x"], p["y"]) for p in one[0]] == [p[:2] for p in flat]
    with pytest.raises(Exception, match="kind 1"):
        readers.decode_geometry(spark.createDataFrame([(bytearray(struct.pack("<BI2d", 1, 1, 0, 0)),)], "geometry binary")).collect()


def test_a_cluster_needs_a_named_folder():
    from types import SimpleNamespace

    from wardatlas.storage import shared_folder
    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
