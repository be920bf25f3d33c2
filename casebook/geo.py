"""Overlay, assignment, interpolation, compactness and adjacency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardatlas.functions import geometry as G
from wardatlas.operators import overlay
from wardatlas.plans import build_inputs
from wardatlas.storage import materialize

from . import views as V
from .registry import case, r6

OVER = "SELECT block_idx, unit_idx, round(src_area,6) AS src_area, round(inter_area,6) AS inter_area FROM fx_overlay WHERE inter_area > 1e-9"


def _boxes(spark, d):
    pairs = overlay.overlay_boxes(V.block_box(spark, d), V.unit_box(spark, d), "block_idx", "unit_idx")
    return pairs.where("inter_area > 1e-9")          # edges that touch within rounding


def _polygons(spark, d):
    pairs = overlay.overlay_polygons(V.with_rings(V.block_box(spark, d)), V.with_rings(V.unit_box(spark, d)), "block_idx", "unit_idx")
    return pairs.where("inter_area > 1e-9")


def _clockwise(df):
    """The outlines drawn the other way round."""
    return V.with_rings(df).withColumn("rings", F.transform("rings", lambda r: F.reverse(r)))


def _polygons_rounded(spark, d):
    return _polygons(spark, d).withColumn("inter_area", F.round("inter_area", 9))


def _tilted(df, key):
    """Box to a concave five-corner polygon with a square hole, by plain arithmetic."""
    x, y = F.col("x0"), F.col("y0")
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    outer = F.array(p(0.0, 0.0), p(1.5, 0.1), p(1.4, 1.3), p(0.7, 0.8), p(0.1, 1.2), p(0.0, 0.0))
    hole = F.array(p(0.4, 0.3), p(0.4, 0.5), p(0.6, 0.5), p(0.6, 0.3), p(0.4, 0.3))
    return df.select(key, F.array(outer, hole).alias("rings"))


@case("g1_overlay_boxes", OVER, ("fx_overlay",))
def g1(spark, d):
    """Blocks over units: candidates by grid cell, exact shared area in the JVM."""
    return r6(_boxes(spark, d))


@case("g1_overlay_polygons", OVER, ("fx_overlay",))
def g1p(spark, d):
    """The same through the general polygon overlay."""
    return r6(_polygons(spark, d))


@case("g1_overlay_clockwise", OVER, ("fx_overlay",))
def g1w(spark, d):
    """Blocks drawn clockwise over units drawn counter-clockwise."""
    pairs = overlay.overlay_polygons(_clockwise(V.block_box(spark, d)), V.with_rings(V.unit_box(spark, d)), "block_idx", "unit_idx")
    return r6(pairs.where("inter_area > 1e-9"))


@case("g1_overlay_concave_with_holes")
def g1c(spark, d):
    """Concave polygons with holes over boxes; checked against a closed form in the tests."""
    pairs = overlay.overlay_polygons(_tilted(V.block_box(spark, d), "block_idx"), V.with_rings(V.unit_box(spark, d)), "block_idx", "unit_idx")
    return r6(pairs.where("inter_area > 1e-9"))


TILTED_AREA = "abs(0.0*0.1-1.5*0.0 + 1.5*1.3-1.4*0.1 + 1.4*0.8-0.7*1.3 + 0.7*1.2-0.1*0.8 + 0.1*0.0-0.0*1.2)/2 - 0.2*0.2"


@case("g1_pieces_add_up", f"SELECT block_idx, round({TILTED_AREA},6) AS covered FROM fx_block_box WHERE x0 + 1.5e0 <= 40 AND y0 + 1.3e0 <= (SELECT max(y0) FROM fx_unit_box)", ("fx_block_box", "fx_unit_box"))
def g1s(spark, d):
    """Concave polygons with a hole, inside the covered region, cut by the units: the pieces make up the whole."""
    top = V.unit_box(spark, d).agg(F.max("y0")).first()[0]
    blocks = V.block_box(spark, d).where((F.col("x0") + 1.5 <= 40) & (F.col("y0") + 1.3 <= top))
    pairs = overlay.overlay_polygons(_tilted(blocks, "block_idx"), V.with_rings(V.unit_box(spark, d)), "block_idx", "unit_idx")
    return r6(pairs.groupBy("block_idx").agg(F.sum("inter_area").alias("covered")))


BEST = """SELECT block_idx, unit_idx FROM (SELECT block_idx, unit_idx, row_number() OVER (PARTITION BY block_idx ORDER BY round(inter_area,9) DESC, unit_idx) AS rn
 FROM fx_overlay WHERE inter_area > 1e-9) t WHERE rn = 1"""


@case("w1_largest_overlap", f"SELECT block_idx, unit_idx FROM ({BEST}) b", ("fx_overlay",))
def w1(spark, d):
    """Best unit per block by partial aggregation, no sort."""
    pairs = _boxes(spark, d).withColumn("inter_area", F.round("inter_area", 9))
    return overlay.largest_overlap(pairs, "block_idx", "unit_idx").select("block_idx", "unit_idx")


@case("g2_assign_by_area", f"SELECT block_idx, unit_idx FROM fx_block_box LEFT JOIN ({BEST}) b USING (block_idx)", ("fx_overlay",))
def g2(spark, d):
    """Every block with its unit; NULL where it touches none."""
    pairs = _boxes(spark, d).withColumn("inter_area", F.round("inter_area", 9))
    return overlay.assign_by_area(V.block_box(spark, d).select("block_idx"), pairs, "block_idx", "unit_idx")


@case("g2_assign_by_polygon_area", f"SELECT block_idx, unit_idx FROM fx_block_box LEFT JOIN ({BEST}) b USING (block_idx)", ("fx_overlay",))
def g2p(spark, d):
    """The same through the general polygon overlay."""
    return overlay.assign_by_area(V.block_box(spark, d).select("block_idx"), _polygons_rounded(spark, d), "block_idx", "unit_idx").select("block_idx", "unit_idx")


@case("j11_labels_after_overlay", f"SELECT block_idx, vtd_geoid FROM fx_block_box LEFT JOIN ({BEST}) b USING (block_idx) LEFT JOIN fx_unit ON vtdkey = unit_idx", ("fx_overlay", "fx_unit"))
def j11(spark, d):
    """Text ids looked up for the assigned units; blocks without a unit keep NULL."""
    pairs = _boxes(spark, d).withColumn("inter_area", F.round("inter_area", 9))
    best = overlay.assign_by_area(V.block_box(spark, d).select("block_idx"), pairs, "block_idx", "unit_idx")
    return best.join(V.unit(spark, d).select(F.col("vtdkey").alias("unit_idx"), "vtd_geoid"), "unit_idx", "left").select("block_idx", "vtd_geoid")


POP = """SELECT u.unit_idx, cast(round_even(coalesce(t.p,0),0) AS bigint) AS pop FROM fx_unit_box u LEFT JOIN
 (SELECT unit_idx, round(sum(pop * least(greatest(inter_area/src_area,0e0),1e0)),9) AS p FROM fx_overlay GROUP BY 1) t USING (unit_idx)"""


@case("g3_interpolated_counts", POP, ("fx_overlay",))
def g3(spark, d):
    """Block population spread over units by area."""
    return overlay.interpolate_counts(_boxes(spark, d), V.block_box(spark, d), V.unit_box(spark, d).select("unit_idx"),
                                      "block_idx", "unit_idx", ["pop"])


@case("g3_interpolated_counts_of_polygons", POP, ("fx_overlay",))
def g3p(spark, d):
    """The same through the general polygon overlay."""
    return overlay.interpolate_counts(_polygons(spark, d), V.block_box(spark, d), V.unit_box(spark, d).select("unit_idx"), "block_idx", "unit_idx", ["pop"])


@case("a12_weighted_sums", "SELECT unit_idx, round(sum(pop * least(greatest(inter_area/src_area,0e0),1e0)),6) AS pop FROM fx_overlay WHERE inter_area > 1e-9 GROUP BY 1", ("fx_overlay",))
def a12(spark, d):
    rows = overlay.area_weights(_boxes(spark, d)).join(V.block_box(spark, d).select("block_idx", "pop"), "block_idx")
    return r6(rows.groupBy("unit_idx").agg(F.sum(F.col("pop") * F.col("w")).alias("pop")))


@case("j18_units_in_districts", """
SELECT unit_idx, cast(3*floor(y0/25)+floor(x0/14) AS bigint) AS district_idx, round(1e0,6) AS inter_area FROM fx_unit_box
 WHERE floor(x0/14) = floor((x0+1-1e-9)/14) AND floor(y0/25) = floor((y0+1-1e-9)/25)""", ("fx_unit_box",))
def j18(spark, d):
    """Units over districts of 14 x 25 units built from the units' own extent."""
    u = V.unit_box(spark, d)
    x, y = F.floor(F.col("x0") / 14), F.floor(F.col("y0") / 25)
    dist = u.select((3 * y + x).alias("district_idx"), (x * 14.0).alias("x0"), (y * 25.0).alias("y0")).distinct()
    dist = dist.withColumns({"x1": F.col("x0") + 14.0, "y1": F.col("y0") + 25.0})
    return r6(overlay.overlay_boxes(u, dist, "unit_idx", "district_idx").drop("src_area"))


@case("j18_unit_polygons_in_districts", """
SELECT unit_idx, cast(3*floor(y0/25)+floor(x0/14) AS bigint) AS district_idx, round(1e0,6) AS inter_area FROM fx_unit_box
 WHERE floor(x0/14) = floor((x0+1-1e-9)/14) AND floor(y0/25) = floor((y0+1-1e-9)/25)""", ("fx_unit_box",))
def j18p(spark, d):
    """The same with outlines, the districts drawn clockwise."""
    u = V.unit_box(spark, d)
    x, y = F.floor(F.col("x0") / 14), F.floor(F.col("y0") / 25)
    dist = u.select((3 * y + x).alias("district_idx"), (x * 14.0).alias("x0"), (y * 25.0).alias("y0")).distinct()
    dist = dist.withColumns({"x1": F.col("x0") + 14.0, "y1": F.col("y0") + 25.0})
    return r6(overlay.overlay_polygons(V.with_rings(u), _clockwise(dist), "unit_idx", "district_idx").drop("src_area"))


@case("j19_block_polygons_in_units", "SELECT unit_idx, count(*) AS n_blocks, round(sum(inter_area),6) AS covered FROM fx_overlay WHERE inter_area > 1e-9 GROUP BY 1", ("fx_overlay",))
def j19p(spark, d):
    return r6(_polygons(spark, d).groupBy("unit_idx").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("inter_area").alias("covered")))


@case("j19_blocks_in_units", "SELECT unit_idx, count(*) AS n_blocks, round(sum(inter_area),6) AS covered FROM fx_overlay WHERE inter_area > 1e-9 GROUP BY 1", ("fx_overlay",))
def j19(spark, d):
    return r6(_boxes(spark, d).groupBy("unit_idx").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("inter_area").alias("covered")))


@case("g4_polygon_area", "SELECT block_idx, round((x1-x0)*(y1-y0),6) AS area FROM fx_block_box", ("fx_block_box",))
def g4(spark, d):
    return r6(V.with_rings(V.block_box(spark, d)).select("block_idx", G.area("rings").alias("area")))


@case("g5_compactness_ratios", """
SELECT block_idx, round(2*(w+h),6) AS perimeter, round(4*pi()*w*h/((2*(w+h))*(2*(w+h))),6) AS polsby_popper, round(sqrt(4*pi()*w*h/((2*(w+h))*(2*(w+h)))),6) AS schwartzberg
FROM (SELECT block_idx, x1-x0 AS w, y1-y0 AS h FROM fx_block_box) t""", ("fx_block_box",))
def g5(spark, d):
    return r6(V.with_rings(V.block_box(spark, d)).select(
        "block_idx", G.perimeter("rings").alias("perimeter"), G.polsby_popper("rings").alias("polsby_popper"), G.schwartzberg("rings").alias("schwartzberg")))


@case("g6_hull_and_circle", "SELECT block_idx, round(1e0,6) AS convex_hull_ratio, round(w*h/(pi()*(w*w+h*h)/4),6) AS reock FROM (SELECT block_idx, x1-x0 AS w, y1-y0 AS h FROM fx_block_box) t", ("fx_block_box",))
def g6(spark, d):
    """A box is its own hull, and its circle runs through the corners."""
    return r6(overlay.compactness(V.with_rings(V.block_box(spark, d)), "block_idx").select("block_idx", "convex_hull_ratio", "reock"))


@case("g7_adjacency", "SELECT least(src,dst) AS src, greatest(src,dst) AS dst, shared_length FROM fx_edges", ("fx_edges",))
def g7(spark, d):
    """Neighbouring units by shared boundary."""
    return r6(overlay.adjacency(V.with_rings(V.unit_box(spark, d)), "unit_idx"))


@case("g7_adjacency_of_split_borders", """
WITH b AS (SELECT unit_idx, x0, y0 + 0.5e0 * (cast(x0 AS bigint) % 2) AS y0 FROM fx_unit_box)
SELECT least(a.unit_idx, c.unit_idx) AS src, greatest(a.unit_idx, c.unit_idx) AS dst,
 round(CASE WHEN c.x0 = a.x0 THEN 1e0 ELSE least(a.y0, c.y0) + 1 - greatest(a.y0, c.y0) END,6) AS shared_length
FROM b a JOIN b c ON (c.x0 = a.x0 AND c.y0 = a.y0 + 1) OR (c.x0 = a.x0 + 1 AND abs(c.y0 - a.y0) < 1)""", ("fx_unit_box",))
def g7s(spark, d):
    """Every second column moved up by half a unit: borders meet in part only."""
    up = 0.5 * (F.col("x0").cast("bigint") % 2)
    units = V.unit_box(spark, d).withColumns({"y0": F.col("y0") + up, "y1": F.col("y1") + up})
    return r6(overlay.adjacency(_clockwise(units), "unit_idx"))


# Units turned by the angle of (3, 4, 5), stretched to 500 and moved to where projected maps lie; every corner is shifted on its own
# by up to 0.02 each way, and a tolerance of 0.2 stands for a survey's.
def _digitised(df):
    k = F.col("unit_idx")

    def corner(x, y, n):
        shift = lambda a, b: ((k * a + n * b) % 41 - 20).cast("double") / 1000.0
        return F.struct((1.0e6 + 100.0 * (3.0 * F.col(x) - 4.0 * F.col(y)) + shift(7, 13)).alias("x"),
                        (7.0e6 + 100.0 * (4.0 * F.col(x) + 3.0 * F.col(y)) + shift(11, 17)).alias("y"))

    ring = F.array(corner("x0", "y0", 0), corner("x1", "y0", 1), corner("x1", "y1", 2), corner("x0", "y1", 3), corner("x0", "y0", 0))
    return df.select("unit_idx", F.array(ring).alias("rings"))


@case("g7_adjacency_of_digitised_borders", """
WITH b AS (SELECT unit_idx, x0, y0 + 0.5e0 * (cast(x0 AS bigint) % 2) AS y0 FROM fx_unit_box)
SELECT least(a.unit_idx, c.unit_idx) AS src, greatest(a.unit_idx, c.unit_idx) AS dst,
 cast(round(CASE WHEN c.x0 = a.x0 THEN 500e0 ELSE 500e0 * (least(a.y0, c.y0) + 1 - greatest(a.y0, c.y0)) END) AS bigint) AS shared_length
FROM b a JOIN b c ON (c.x0 = a.x0 AND c.y0 = a.y0 + 1) OR (c.x0 = a.x0 + 1 AND abs(c.y0 - a.y0) < 1)""", ("fx_unit_box",))
def g7d(spark, d):
    """Slanted borders that meet in part, at projected coordinates, no corner exactly where its neighbour has it."""
    up = 0.5 * (F.col("x0").cast("bigint") % 2)
    units = V.unit_box(spark, d).withColumns({"y0": F.col("y0") + up, "y1": F.col("y1") + up})
    found = overlay.adjacency(_digitised(units), "unit_idx", tolerance=0.2)
    return found.withColumn("shared_length", F.round("shared_length").cast("bigint"))


@case("g8_cut_edges", """
SELECT a.plan_id, count(*) AS n_edges, count(*) FILTER (a.district_id <> b.district_id) AS n_cut_edges
FROM fx_edges e JOIN fx_unit ua ON ua.vtdkey = e.src JOIN fx_unit ub ON ub.vtdkey = e.dst
JOIN fx_plan_map a ON a.vtd_geoid = ua.vtd_geoid JOIN fx_plan_map b ON b.vtd_geoid = ub.vtd_geoid AND b.plan_id = a.plan_id GROUP BY 1""", ("fx_edges", "fx_plan_map"))
def g8(spark, d):
    """Edges cut by each plan."""
    ids = V.unit(spark, d).select(F.col("vtdkey").alias("unit_idx"), "vtd_geoid")
    units = V.with_rings(V.unit_box(spark, d)).join(ids, "unit_idx").select("vtd_geoid", "rings")
    return overlay.cut_edges(materialize(overlay.adjacency(units, "vtd_geoid")), V.plan_map(spark, d))


@case("g9_invalid_geometries", "SELECT p_partkey AS block_idx, CASE WHEN p_partkey % 7 = 0 THEN 'zero area' WHEN p_partkey % 7 = 1 THEN 'ring not closed' ELSE 'ring with fewer than 4 points' END AS reason FROM part WHERE p_partkey % 7 < 3")
def g9(spark, d):
    """Boxes of which some were flattened, opened or cut short."""
    r, k = F.col("rings"), F.col("block_idx") % 7
    flat = F.transform(r, lambda q: F.transform(q, lambda p: F.struct(p["x"].alias("x"), F.lit(0.0).alias("y"))))
    bad = F.when(k == 0, flat).when(k == 1, F.transform(r, lambda q: F.slice(q, 1, 4))).when(
        k == 2, F.transform(r, lambda q: F.slice(q, 1, 3))).otherwise(r)
    return overlay.invalid_geometries(V.with_rings(V.block_box(spark, d)).select("block_idx", bad.alias("rings")), "block_idx")


@case("x1_input_build", """
SELECT vtd_geoid, w.total_votes AS votes_total, cast(round_even(coalesce(t.p,0),0) AS bigint) AS vap_total, cast(cast(floor(b.y0/25) AS bigint) AS varchar) AS district_id
FROM fx_unit u JOIN fx_unit_box b ON b.unit_idx = u.vtdkey LEFT JOIN fx_wide w USING (vtdkey)
LEFT JOIN (SELECT unit_idx, round(sum(pop * least(greatest(inter_area/src_area,0e0),1e0)),9) AS p FROM fx_overlay GROUP BY 1) t ON t.unit_idx = u.vtdkey""", ("fx_unit", "fx_wide", "fx_overlay"))
def x1(spark, d):
    """The whole input build: keys, returns, district assignment and block population."""
    keys = V.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_idx"), F.col("c_nationkey").alias("cntykey"))
    units = V.with_rings(V.unit_box(spark, d)).join(keys, "unit_idx").select(F.col("unit_idx").alias("vtdkey"), "cntykey", "rings")
    y = F.floor(F.col("y0") / 25)
    dist = V.unit_box(spark, d).select(y.alias("district"), F.lit(0.0).alias("x0"), (y * 25.0).alias("y0")).distinct().withColumns(
        {"x1": F.lit(40.0), "y1": F.col("y0") + 25.0})
    blocks = V.with_rings(V.block_box(spark, d)).select(F.col("block_idx").alias("geoid"), "rings", "pop")
    pl = blocks.select("geoid", F.col("pop").alias("vap"), *[F.lit(0).alias(c) for c in ("anglovap", "blackvap", "hispanicvap", "asianvap")])
    t = build_inputs.build_inputs(spark, build_inputs.InputConfig(
        districts=V.with_rings(dist).select("district", "rings"), census_blocks=blocks.drop("pop"), vtds=units, pl94=pl,
        elections=V.returns_tall(spark, d), processed_dir=None, plan_id="ENACTED", ensemble_id="E", cycle="2024", chamber="CONGRESS",
        election_id="E1", election_year=2024, election_office="1-URGENT", election_stage="GENERAL", office_filter="1-urgent"))
    return t["election_returns_vtd"].select("vtd_geoid", "votes_total").join(
        t["vtds_geo"].select("vtd_geoid", "vap_total"), "vtd_geoid").join(t["plan_district_vtd"].select("vtd_geoid", "district_id"), "vtd_geoid")
