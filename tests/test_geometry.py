import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardatlas.functions import geometry as G
from wardatlas.operators import overlay
from wardatlas.sources import readers

RINGS = "array<array<struct<x:double,y:double>>>"
# outer ring counter-clockwise, hole clockwise
CONCAVE = [[(0, 0), (6, 0), (6, 5), (3, 2), (0, 5), (0, 0)], [(1, 0.5), (1, 1.5), (2, 1.5), (2, 0.5), (1, 0.5)]]
OTHER = [[(2, -1), (7, 1), (4, 4), (5, 6), (1, 3), (2, -1)]]


def polys(spark, *items):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for i, p in enumerate(items)], f"id int, rings {RINGS}")


def inside(p, pts):
    out = np.zeros(len(pts), bool)
    for ring in p:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
            cross = (ya > pts[:, 1]) != (yb > pts[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= cross & (pts[:, 0] < (xb - xa) * (pts[:, 1] - ya) / (yb - ya) + xa)
    return out


def shared(spark, a, b):
    s, t = polys(spark, a).withColumnRenamed("id", "s"), polys(spark, b).withColumnRenamed("id", "t")
    r = overlay.overlay_polygons(s, t, "s", "t").first()
    return r["inter_area"] if r else 0.0


def test_concave_overlap_with_hole_matches_grid(spark):
    n = 1500
    gx, gy = np.meshgrid((np.arange(n) + 0.5) * 7 / n, (np.arange(n) + 0.5) * 7 / n - 1)
    pts = np.column_stack([gx.ravel(), gy.ravel()])
    want = (inside(CONCAVE, pts) & inside(OTHER, pts)).mean() * 49
    assert shared(spark, CONCAVE, OTHER) == pytest.approx(want, rel=2e-3)
    assert shared(spark, OTHER, CONCAVE) == pytest.approx(shared(spark, CONCAVE, OTHER), rel=1e-9)


def test_self_overlap_is_the_area_and_edges_share_nothing(spark):
    a = polys(spark, CONCAVE).select(G.area("rings")).first()[0]
    assert a == pytest.approx(20.0) and shared(spark, CONCAVE, CONCAVE) == pytest.approx(a, rel=1e-12)
    box = lambda x: [[(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)]]
    assert shared(spark, box(0), box(1)) == 0.0
    assert shared(spark, box(0), [*box(0.5), *box(3)]) == pytest.approx(0.5)     # multipolygon


def test_random_polygon_overlaps(spark):
    rng = np.random.default_rng(5)

    def star(cx, cy):
        ang = np.sort(rng.random(9)) * 2 * np.pi
        p = [(cx + r * np.cos(a), cy + r * np.sin(a)) for a, r in zip(ang, 0.5 + rng.random(9) * 1.5)]
        return [p + p[:1]]

    a, b = [star(*rng.random(2) * 3) for _ in range(12)], [star(*rng.random(2) * 3) for _ in range(12)]
    s, t = polys(spark, *a).withColumnRenamed("id", "s"), polys(spark, *b).withColumnRenamed("id", "t")
    got = {(r["s"], r["t"]): r["inter_area"] for r in overlay.overlay_polygons(s, t, "s", "t").collect()}
    n = 700
    gx, gy = np.meshgrid((np.arange(n) + 0.5) * 9 / n - 3, (np.arange(n) + 0.5) * 9 / n - 3)
    pts = np.column_stack([gx.ravel(), gy.ravel()])
    ia, ib = [inside(p, pts) for p in a], [inside(p, pts) for p in b]
    for i in range(12):
        for j in range(12):
            assert got.get((i, j), 0.0) == pytest.approx((ia[i] & ib[j]).mean() * 81, abs=0.03)


def coast(n, cx, cy, seed, size=3.0):
    """A closed outline of n points around a centre, smooth in the large and rough in the small."""
    rng = np.random.default_rng(seed)
    a = np.sort(rng.random(n)) * 2 * np.pi
    r = size * (1 + 0.3 * np.sin(5 * a) + 0.1 * np.sin(31 * a) + 0.002 * rng.random(n))
    p = np.column_stack([cx + r * np.cos(a), cy + r * np.sin(a)])
    return np.vstack([p, p[:1]])


def as_ring(p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def signed_area(r):
    n = np.roll(r, -1, axis=0)
    return float(np.sum(r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1])) / 2


def test_pieces_are_small_and_add_up():
    outer, hole = coast(20_000, 0, 0, 1)[:-1], coast(3_000, 0.2, 0.1, 2, 0.5)[:-1][::-1]
    pieces = G.cut_rings([outer, hole], 128)
    assert max(sum(map(len, p)) for p in pieces) <= 128
    assert sum(signed_area(r) for p in pieces for r in p) == pytest.approx(signed_area(outer) + signed_area(hole), rel=1e-12)
    boxes = [(np.concatenate(p).min(axis=0), np.concatenate(p).max(axis=0)) for p in pieces]
    shared = sum(float(np.prod(np.maximum(0, np.minimum(b[1], d[1]) - np.maximum(b[0], d[0])))) for i, b in enumerate(boxes) for d in boxes[:i])
    assert shared < 1e-9                                                # boxes do not overlap either
    comb = np.array([(x, y) for i in range(300) for x, y in ((0, 2 * i), (100, 2 * i), (100, 2 * i + 1), (0, 2 * i + 1))], float)
    comb = np.vstack([comb, [(-1, 2 * 299 + 1), (-1, 0)]])
    cut = G.cut_rings([comb], 64)
    assert sum(signed_area(r) for p in cut for r in p) == pytest.approx(signed_area(comb), rel=1e-12) and max(sum(map(len, p)) for p in cut) <= 64
    same = np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)] * 100)         # a ring wound many times over has no line that halves it
    assert sum(signed_area(r) for p in G.cut_rings([same], 16) for r in p) == pytest.approx(50.0)


def test_cut_overlay_equals_the_whole(spark):
    """Large outlines on both sides, with holes: the same areas whatever the size of the pieces."""
    a = [[as_ring(coast(700, 4 * (i % 3), 4 * (i // 3), i)), as_ring(coast(300, 4 * (i % 3), 4 * (i // 3), 50 + i, 0.6)[::-1])] for i in range(6)]
    b = [[as_ring(coast(900, 3 * i, 2, 100 + i))] for i in range(4)]
    df = lambda rows, k: spark.createDataFrame(list(enumerate(rows)), f"{k} int, rings {RINGS}")
    got = [{(r["s"], r["t"]): (r["src_area"], r["inter_area"]) for r in overlay.overlay_polygons(df(a, "s"), df(b, "t"), "s", "t", max_points=n).where("inter_area > 1e-9").collect()}
           for n in (10_000, 100)]
    assert set(got[0]) == set(got[1]) and len(got[0]) > 8
    assert all(got[1][k] == pytest.approx(v, rel=1e-9) for k, v in got[0].items())


def test_target_of_many_points(spark):
    """Boxes over one outline of 100,000 points: inside ones are whole, and all together make up the outline."""
    p = coast(100_000, 0, 0, 7)
    target = spark.createDataFrame([(1, [as_ring(p)])], f"t int, rings {RINGS}")
    boxes = spark.range(400).select(F.col("id").alias("s"), (F.col("id") % 20 * 0.5 - 5).alias("x0"), (F.floor(F.col("id") / 20) * 0.5 - 5).alias("y0"))
    source = boxes.select("s", G.box_rings("x0", "y0", F.col("x0") + 0.5, F.col("y0") + 0.5).alias("rings"))
    got = {r["s"]: r["inter_area"] for r in overlay.overlay_polygons(source, target, "s", "t").collect()}
    assert sum(got.values()) == pytest.approx(signed_area(p[:-1]), rel=1e-9)
    assert sum(abs(v - 0.25) < 1e-12 for v in got.values()) > 60 and max(got.values()) <= 0.25 + 1e-12


def test_stacked_copies_on_one_cell(spark):
    """A third of all sources on one spot: salted, whole, and each pair once."""
    s = spark.range(300).select(F.col("id").alias("s"), F.when(F.col("id") < 100, 0.25).otherwise(F.col("id") * 1.0).alias("x0"), F.lit(0.25).alias("y0"))
    s = s.withColumns({"x1": F.col("x0") + 0.5, "y1": F.col("y0") + 0.5})
    t = spark.range(400).select(F.col("id").alias("t"), (F.col("id") * 1.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") + 1.0).alias("x1"), F.lit(1.0).alias("y1"))
    named = lambda df, k, p: df.select(k, *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")])
    pairs = overlay.candidate_pairs(named(s, "s", "s_"), named(t, "t", "t_"), rows_per_task=20)
    got = [(r["s"], r["t"]) for r in pairs.select("s", "t").collect()]
    assert sorted(got) == [(i, 0 if i < 100 else i) for i in range(300)]


def test_ties_and_unmatched(spark):
    over = spark.createDataFrame([(1, 7, 2.0, 1.0), (1, 3, 2.0, 1.0), (2, 9, 1.0, 0.2)], "u int, d int, src_area double, inter_area double")
    units = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    assert sorted(tuple(r) for r in overlay.assign_by_area(units, over, "u", "d").collect()) == [(1, 3), (2, 9), (3, None)]
    with pytest.raises(ValueError):
        overlay.assign_by_area(units, over.where("false"), "u", "d")
    counts = overlay.interpolate_counts(over, spark.createDataFrame([(1, "5"), (2, "x")], "u int, n string"),
                                        spark.createDataFrame([(3,), (7,), (9,), (11,)], "d int"), "u", "d", ["n"])
    assert sorted(tuple(r) for r in counts.collect()) == [(3, 2), (7, 2), (9, 0), (11, 0)]


def test_hull_and_circle(spark):
    tri = [[(0, 0), (4, 0), (0, 3), (0, 0)]]
    r = {x["id"]: x for x in overlay.compactness(polys(spark, CONCAVE, tri), "id").collect()}
    assert r[0]["convex_hull_ratio"] == pytest.approx(20 / 30)
    assert r[1]["reock"] == pytest.approx(6 / (np.pi * 2.5 ** 2)) and r[1]["convex_hull_ratio"] == pytest.approx(1)
    assert r[1]["schwartzberg"] == pytest.approx(np.sqrt(4 * np.pi * 6 / 144))


def test_smallest_circle_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        pts = rng.normal(size=(rng.integers(2, 14), 2)) * rng.random(2)
        got = G._circle_radius(G._hull(pts[:, 0], pts[:, 1]))
        best = np.inf
        for i in range(len(pts)):
            for j in range(i):
                mids = [(pts[i] + pts[j]) / 2]
                for k in range(j):
                    m = np.array([pts[i] - pts[j], pts[i] - pts[k]])
                    if abs(np.linalg.det(m)) > 1e-12:
                        mids.append(np.linalg.solve(2 * m, [(pts[i] ** 2).sum() - (pts[q] ** 2).sum() for q in (j, k)]))
                best = min([best, *[np.hypot(*(pts - c).T).max() for c in mids]])
        assert got == pytest.approx(best, rel=1e-9)


def test_adjacency_is_by_side_only(spark):
    box = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]
    units = polys(spark, box(0, 0), box(1, 0), box(0, 1), box(1, 1), box(0, 0))      # the last is a copy of the first
    edges = sorted((r["src"], r["dst"], r["shared_length"]) for r in overlay.adjacency(units, "id").collect())
    assert edges == [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 3, 1.0), (2, 4, 1.0)]
    loose = polys(spark, box(0, 0), box(1.0000001, 0))
    assert overlay.adjacency(loose, "id").count() == 0 and overlay.adjacency(loose, "id", tolerance=1e-3).count() == 1


def turned(x, y, angle=0.7, at=(1e6, 7e6)):
    return float(at[0] + x * np.cos(angle) - y * np.sin(angle)), float(at[1] + x * np.sin(angle) + y * np.cos(angle))


@pytest.mark.parametrize("at", [(0.0, 0.0), (1e6, 7e6), (-3e7, 2e5)])
@pytest.mark.parametrize("tolerance", [None, 1e-3, 0.5])
def test_slanted_borders_at_projected_coordinates(spark, at, tolerance):
    """A row of units of 1000 above, units of random widths below: every border meets in part; corners moved by a quarter of the tolerance."""
    rng = np.random.default_rng(3)
    upper = [(i, 1000.0 * i, 1000.0 * (i + 1), 0.0, 800.0) for i in range(20)]
    cuts = np.concatenate(([0.0], np.sort(rng.random(30) * 20_000), [20_000.0]))
    lower = [(100 + i, a, b, -500.0, 0.0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    move = (tolerance or 0.0) / 4
    wiggle = lambda p: tuple(float(v + move / np.sqrt(2) * rng.uniform(-1, 1)) for v in p)
    rows = [(i, [[dict(zip("xy", p)) for p in (lambda c: [*c, c[0]])([wiggle(turned(x, y, 0.7, at)) for x, y in ((a, lo), (b, lo), (b, hi), (a, hi))])]])
            for i, a, b, lo, hi in upper + lower]
    want = {(i, i + 1): 800.0 for i in range(19)} | {(100 + i, 101 + i): 500.0 for i in range(30)}
    want |= {(i, j): min(b, d) - max(a, c) for i, a, b, *_ in upper for j, c, d, *_ in lower if min(b, d) - max(a, c) > 1.0}
    got = {(r["src"], r["dst"]): r["shared_length"] for r in overlay.adjacency(spark.createDataFrame(rows, f"id int, rings {RINGS}"), "id", tolerance=tolerance).collect()}
    assert set(want) <= set(got) and all(abs(got[k] - v) <= max(tolerance or 0, 1e-6) for k, v in want.items())
    assert all(v <= 1.0 + (tolerance or 0) for k, v in got.items() if k not in want)


def test_long_border_against_many_short_ones(spark):
    """One unit of 4,000 along many of 4 to 9: all parts found, each once, and units that cross or only touch do not count."""
    edges, x = [], 0.0
    while x < 4000:
        edges.append((x, min(4000.0, x + 4 + len(edges) % 6)))
        x = edges[-1][1]
    ring = lambda *c: [[dict(zip("xy", turned(*p))) for p in (*c, c[0])]]
    rows = [(0, ring((0, 0), (4000, 0), (4000, 900), (0, 900)))] + [(k + 1, ring((a, -3), (b, -3), (b, 0), (a, 0))) for k, (a, b) in enumerate(edges)]
    rows += [(9000, ring((4000, 900), (4100, 900), (4100, 1000), (4000, 1000))), (9001, ring((-50, 450), (-50, 300), (0, 450)))]
    got = {(r["src"], r["dst"]): r["shared_length"] for r in overlay.adjacency(spark.createDataFrame(rows, f"id int, rings {RINGS}"), "id").collect()}
    want = {(0, k + 1): b - a for k, (a, b) in enumerate(edges)} | {(k, k + 1): 3.0 for k in range(1, len(edges))}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_cut_edges_skip_units_outside_a_plan(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    m = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "2"), ("q", "a", "1"), ("q", "b", "1")], "plan_id string, vtd_geoid string, district_id string")
    assert sorted(tuple(r) for r in overlay.cut_edges(e, m).collect()) == [("p", 2, 1), ("q", 1, 0)]


def test_geojson_and_wkb(spark, tmp_path):
    clockwise = [[list(p) for p in CONCAVE[0]][::-1], [list(p) for p in CONCAVE[1]][::-1]]
    f = {"type": "Feature", "properties": {"District": "7"}, "geometry": {"type": "Polygon", "coordinates": clockwise}}
    g = {"type": "Feature", "properties": {"District": "8"}, "geometry": {"type": "MultiPolygon", "coordinates": [clockwise, [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}}
    path = tmp_path / "d.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [f, g]}, indent=1))
    got = {r["district"]: r["a"] for r in readers.read_geojson(spark, str(path)).select("district", G.area("rings").alias("a")).collect()}
    assert got == {"7": pytest.approx(20.0), "8": pytest.approx(20.5)}
    wkb = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in clockwise)
    multi = struct.pack("<BII", 1, 6, 1) + wkb
    df = spark.createDataFrame([(bytearray(wkb),), (bytearray(multi),), (None,)], "geometry binary")
    p = str(tmp_path / "w.parquet")
    df.write.parquet(p)
    areas = [r[0] for r in readers.read_geo_parquet(spark, p).where("rings is not null").select(G.area("rings")).collect()]
    assert areas == [pytest.approx(20.0)] * 2


def test_invalid_reasons(spark):
    bad = polys(spark, [], [[(0, 0), (1, 0), (0, 0)]], [[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(0, 0), (1, 0), (2, 0), (0, 0)]],
                [[(0, 0), (float("nan"), 0), (1, 1), (0, 0)]], CONCAVE)
    got = {r["id"]: r["reason"] for r in overlay.invalid_geometries(bad, "id").collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[2] == "ring not closed" and got[3] == "zero area"


def test_boxes_of_very_different_sizes(spark):
    rng = np.random.default_rng(8)

    def layer(n, names):
        size = 10.0 ** rng.uniform(-3, 2, n)
        x, y = rng.random(n) * 60 - 30, rng.random(n) * 60 - 30
        rows = [(i, float(a), float(b), float(a + c), float(b + c * r)) for i, (a, b, c, r) in enumerate(zip(x, y, size, rng.random(n)))]
        return rows, spark.createDataFrame(rows, ", ".join([names[0] + " int"] + [f"{names[1]}{c} double" for c in ("x0", "y0", "x1", "y1")]))

    a, s = layer(150, ("s", "s_"))
    b, t = layer(150, ("t", "t_"))
    got = sorted((r["s"], r["t"]) for r in overlay.candidate_pairs(s, t, rows_per_task=40).select("s", "t").collect())
    want = sorted((p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    assert got == want and len(want) > 100
    assert overlay.candidate_pairs(s.where("false"), t).columns == [*s.columns, *t.columns]


def test_memory_of_clipping_is_bounded():
    """A batch of ten thousand pairs is clipped a slice at a time, and slices add up."""
    import tracemalloc

    import pandas as pd
    n = 10_000
    each = lambda v: pd.Series([np.array(v)] * n)
    ring = np.array(CONCAVE[0] + CONCAVE[1], float)
    other = np.array(OTHER[0], float)
    args = (each(ring[:, 0]), each(ring[:, 1]), each([6, 5]), each(other[:, 0]), each(other[:, 1]), each([6]))
    one = G.overlap_area.func(*[a[:1] for a in args])[0]
    tracemalloc.start()
    out = G.overlap_area.func(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(out, one, rtol=1e-12) and peak < 40_000_000, peak


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_edges_send_an_edge_once_for_many_plans(spark):
    """Rows that are there twice, units that some plans leave out, districts without a name, more plans than one row holds."""
    rng = np.random.default_rng(6)
    rows = [(f"p{p}", f"u{u}", None if (p + u) % 11 == 0 else str(int(rng.integers(0, 3)))) for p in range(150) for u in range(12) if (p * u) % 7 != 3]
    rows += [("p1", "u2", "0"), ("p1", "u2", "1"), ("p1", "u3", "1"), ("p149", "u5", None), (None, "u1", "1"), ("p2", None, "1")]
    edges = [(f"u{i}", f"u{j}", 1.0) for i in range(12) for j in range(i + 1, 12) if (i + j) % 3] + [("u1", "u99", 1.0)]
    m = spark.createDataFrame(rows, "plan_id string, vtd_geoid string, district_id string")
    found = overlay.cut_edges(spark.createDataFrame(edges, "src string, dst string, shared_length double"), m)
    want = {}
    for p, u, a in rows:
        for q, v, b in rows:
            if p is not None and p == q and any(u == s and v == t for s, t, _ in edges):
                n = want.setdefault(p, [0, 0])
                n[0] += 1
                n[1] += a is not None and b is not None and a != b
    assert {r["plan_id"]: [r["n_edges"], r["n_cut_edges"]] for r in found.collect()} == want
    assert not [l for l in _plan_text(found).splitlines() if "Join" in l and "[plan_id" in l]


def test_adjacency_measures_after_the_join(spark):
    """Filters that are pushed into the join write every step out many times over: a method too long to be compiled."""
    units = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], "id int, x0 double, y0 double").withColumns(
        {"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    found = overlay.adjacency(units.withColumn("rings", G.box_rings("x0", "y0", "x1", "y1")), "id")
    assert found.count() == 24
    joins = [l for l in _plan_text(found).splitlines() if "SortMergeJoin" in l]
    assert joins and not [l for l in joins if " / " in l]


@pytest.mark.parametrize("reach", [1e-9, 0.3])
def test_cells_along_a_segment_come_once(spark, reach):
    rng = np.random.default_rng(7)
    ends = [(i, *map(float, rng.normal(size=4) * 3), int(a)) for i, a in enumerate(rng.integers(-3, 3, 40))]
    seg = spark.createDataFrame(ends, "id int, xa double, ya double, xb double, yb double, _at int").withColumn(
        "_len", F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")))
    got = [(r["id"], r["_cx"], r["_cy"]) for r in overlay._cells_along(seg, reach).collect()]
    assert len(got) == len(set(got))
    want = set()
    for i, xa, ya, xb, yb, at in ends:
        size = 2.0 ** at / overlay.PIECES
        n, margin = int(np.ceil(np.hypot(xb - xa, yb - ya) / size)), size / 2 + 2 * reach
        for k in range(n):
            span = [sorted((a + (b - a) * k / n, a + (b - a) * (k + 1) / n)) for a, b in ((xa, xb), (ya, yb))]
            cells = [range(int(np.floor((l - margin) / size)), int(np.floor((h + margin) / size)) + 1) for l, h in span]
            want |= {(i, cx, cy) for cx in cells[0] for cy in cells[1]}
    assert set(got) == want
