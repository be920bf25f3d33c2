"""Measures of a polygon held as rings: ``array<array<struct<x:double,y:double>>>``.

A ring is closed (last point repeats the first).  Outer rings run
counter-clockwise and holes clockwise, so every sum over rings is signed and
holes and multipolygons need no case of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS_TYPE = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_rings(x0, y0, x1, y1) -> Column:
    """An axis-aligned box as one counter-clockwise ring."""
    corner = lambda x, y: F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


def _edges(ring: Column, value) -> Column:
    """Sum of ``value(p, q)`` over the edges of a ring."""
    n = F.size(ring)
    return F.aggregate(
        F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
                   F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), value),
        F.lit(0.0), lambda s, v: s + v)


def ring_signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / F.lit(2.0)


def area(rings) -> Column:
    return F.abs(F.aggregate(F.transform(_col(rings), ring_signed_area), F.lit(0.0), lambda s, v: s + v))


def perimeter(rings) -> Column:
    length = lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
    return F.aggregate(F.transform(_col(rings), lambda r: _edges(r, length)), F.lit(0.0), lambda s, v: s + v)


def polsby_popper(rings) -> Column:
    p = perimeter(rings)
    return F.when(p > 0, F.lit(4.0) * F.pi() * area(rings) / (p * p))


def schwartzberg(rings) -> Column:
    return F.sqrt(polsby_popper(rings))


def xs(rings) -> Column:
    return F.transform(F.flatten(_col(rings)), lambda p: p["x"])


def ys(rings) -> Column:
    return F.transform(F.flatten(_col(rings)), lambda p: p["y"])


def ring_sizes(rings) -> Column:
    return F.transform(_col(rings), lambda r: F.size(r))


def bounds(rings) -> list[Column]:
    """Columns x0, y0, x1, y1 of the bounding box."""
    return [F.array_min(xs(rings)).alias("x0"), F.array_min(ys(rings)).alias("y0"),
            F.array_max(xs(rings)).alias("x1"), F.array_max(ys(rings)).alias("y1")]


def orient_polygon(rings: Column) -> Column:
    """First ring counter-clockwise, the others (holes) clockwise."""
    turn = lambda r, i: F.when((ring_signed_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r))
    return F.transform(rings, turn)


def wound(rings) -> Column:
    """Rings with outer ones counter-clockwise, whatever way a whole outline was drawn.

    An outline whose signed total is negative is drawn the other way round, as
    some formats have it: all its rings are reversed.  Holes must run against
    their shell; see ``invalid_reason``.
    """
    r = _col(rings)
    total = F.aggregate(F.transform(r, ring_signed_area), F.lit(0.0), lambda s, v: s + v)
    return F.when(total < 0, F.transform(r, lambda q: F.reverse(q))).otherwise(r)


def _finite_points(rings: Column) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.forall(F.flatten(rings), lambda p: ok(p["x"]) & ok(p["y"]))


def _inner_like_shell(rings: Column) -> Column:
    """Is there a ring whose box lies strictly inside that of another ring with the same winding?"""
    box = lambda r: F.struct(
        F.array_min(F.transform(r, lambda p: p["x"])).alias("x0"), F.array_min(F.transform(r, lambda p: p["y"])).alias("y0"),
        F.array_max(F.transform(r, lambda p: p["x"])).alias("x1"), F.array_max(F.transform(r, lambda p: p["y"])).alias("y1"),
        (ring_signed_area(r) > 0).alias("left"))
    boxes = F.transform(rings, box)
    inside = lambda a, b: ((a["x0"] > b["x0"]) & (a["y0"] > b["y0"]) & (a["x1"] < b["x1"]) & (a["y1"] < b["y1"]) & (a["left"] == b["left"]))
    # an island in a hole is wound like the outermost shell; it lies inside an even number of rings
    around = lambda a: F.size(F.filter(boxes, lambda b: (a["x0"] > b["x0"]) & (a["y0"] > b["y0"]) & (a["x1"] < b["x1"]) & (a["y1"] < b["y1"])))
    return F.exists(boxes, lambda a: (around(a) % 2 == 1) & F.exists(boxes, lambda b: inside(a, b) & (around(b) % 2 == 0)))


def invalid_reason(rings) -> Column:
    """Why a polygon cannot be measured, or NULL when it can."""
    r = _col(rings)
    return (
        F.when(r.isNull() | (F.size(r) == 0), "no rings")
        .when(~_finite_points(r), "coordinate missing or not finite")
        .when(F.exists(r, lambda q: F.size(q) < 4), "ring with fewer than 4 points")
        .when(F.exists(r, lambda q: q[0] != F.element_at(q, -1)), "ring not closed")
        .when(area(r) == 0, "zero area")
        .when(_inner_like_shell(r), "hole wound like its shell")
    )


def _hull(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, of one geometry's points."""
    pts = np.unique(np.column_stack([px, py]), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _circle_radius(hull: np.ndarray) -> float:
    """Radius of the smallest circle around hull points, grown by the farthest outlier."""
    def through(support):
        if len(support) == 1:
            return support[0], 0.0
        if len(support) == 2:
            mid = (support[0] + support[1]) / 2
            return mid, float(np.hypot(*(support[0] - mid)))
        a, b, c = support
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if d == 0:
            return None, np.inf
        bb, cc = np.sum((b - a) ** 2), np.sum((c - a) ** 2)
        mid = a + np.array([(c[1] - a[1]) * bb - (b[1] - a[1]) * cc,
                            (b[0] - a[0]) * cc - (c[0] - a[0]) * bb]) / d
        return mid, float(np.hypot(*(a - mid)))

    def holds(mid, r, pts):
        return mid is not None and np.all(np.hypot(*(np.asarray(pts) - mid).T) <= r * (1 + 1e-12) + 1e-15)

    def smallest(support):
        """Smallest circle around two to four points: best pair or triple that holds all."""
        best = (None, np.inf)
        k = len(support)
        for i in range(k):
            for j in range(i + 1, k):
                for l in [None, *range(j + 1, k)]:
                    pick = [support[i], support[j]] + ([] if l is None else [support[l]])
                    mid, r = through(pick)
                    if r < best[1] and holds(mid, r, support):
                        best = (mid, r, pick)
        return best

    if len(hull) < 2:
        return 0.0
    pick = [hull[0], hull[np.argmax(np.hypot(*(hull - hull[0]).T))]]
    mid, r = through(pick)
    while True:                                             # the radius grows in every round, over finitely many supports
        far = np.hypot(*(hull - mid).T)
        worst = int(np.argmax(far))
        if far[worst] <= r * (1 + 1e-12) + 1e-15:
            return r
        grown = smallest([*pick, hull[worst]])
        if grown[0] is None or grown[1] <= r:               # rounding stands in the way: the farthest point bounds the circle
            return float(far[worst])
        mid, r, pick = grown


@F.pandas_udf(T.StructType([T.StructField("hull_area", T.DoubleType()), T.StructField("circle_area", T.DoubleType())]))
def enclosing_areas(px: pd.Series, py: pd.Series) -> pd.DataFrame:
    """Areas of the convex hull and of the smallest enclosing circle, one geometry per row."""
    hull_area, circle_area = [], []
    for x, y in zip(px, py):
        h = _hull(np.asarray(x, float), np.asarray(y, float))
        nxt = np.roll(h, -1, axis=0)
        hull_area.append(abs(float(np.sum(h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]))) / 2)
        circle_area.append(float(np.pi * _circle_radius(h) ** 2))
    return pd.DataFrame({"hull_area": hull_area, "circle_area": circle_area})


POINTS_AT_ONCE = 16_384                                  # Fixed value: points clipped together; three cuts make up to eight of each


def _clipped_area(poly: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Signed area of each ring inside its own counter-clockwise triangle.

    The ring is cut by the three sides in turn.  A point outside a side is
    moved onto the side's line; the runs along that line enclose nothing, so
    the signed area stays exact and no branch on topology is needed.
    """
    for k in range(3):
        a, b = tri[:, k], tri[:, (k + 1) % 3]
        side = b - a
        normal = np.stack([-side[:, 1], side[:, 0]], axis=1) / np.hypot(side[:, 0], side[:, 1])[:, None]
        d = np.einsum("nkc,nc->nk", poly - a[:, None, :], normal)
        nd, nxt = np.roll(d, -1, axis=1), np.roll(poly, -1, axis=1)
        kept = poly - np.minimum(d, 0)[..., None] * normal[:, None, :]
        crosses = (d > 0) != (nd > 0)
        t = np.where(crosses, d / np.where(d == nd, 1.0, d - nd), 0.0)
        cross = np.where(crosses[..., None], poly + t[..., None] * (nxt - poly), kept)
        poly = np.stack([kept, cross], axis=2).reshape(len(tri), -1, 2)
    nxt = np.roll(poly, -1, axis=1)
    return np.sum(poly[..., 0] * nxt[..., 1] - nxt[..., 0] * poly[..., 1], axis=1) / 2


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _flat_rings(x: pd.Series, y: pd.Series, sizes: pd.Series):
    """All points of a batch, and row, first point and open size of every ring worth measuring."""
    pts = np.column_stack([np.concatenate([np.asarray(v, float) for v in x]), np.concatenate([np.asarray(v, float) for v in y])])
    per_row = np.array([len(s) for s in sizes])
    size = np.concatenate([np.asarray(s, int) for s in sizes])
    row, start = np.repeat(np.arange(len(x)), per_row), np.cumsum(size) - size
    keep = size >= 4
    return pts, row[keep], start[keep], size[keep] - 1


@F.pandas_udf(T.DoubleType())
def overlap_area(ax: pd.Series, ay: pd.Series, an: pd.Series,
                 bx: pd.Series, by: pd.Series, bn: pd.Series) -> pd.Series:
    """Shared area of two polygons per row, from flat coordinates and ring sizes.

    Outer rings run counter-clockwise and holes clockwise (``wound`` sees to
    it).  Each ring of b is a fan of signed triangles; each ring of a is clipped
    against each triangle it can reach.  All clips of a batch run together,
    rings of like length at a time.
    """
    # a slice of rows at a time keeps the triangle table small for long outlines
    points = np.array([len(v) for v in bx])
    part = np.cumsum(points) // POINTS_AT_ONCE
    cols = (ax, ay, an, bx, by, bn)
    done = [_overlap_slice(*[c[part == k] for c in cols]) for k in np.unique(part)]
    return pd.Series(np.concatenate(done) if done else np.zeros(0))


def _overlap_slice(ax, ay, an, bx, by, bn) -> np.ndarray:
    total = np.zeros(len(ax))
    apts, arow, astart, asize = _flat_rings(ax, ay, an)
    bpts, brow, bstart, bsize = _flat_rings(bx, by, bn)
    if not len(arow) or not len(brow):
        return total
    fans = bsize - 2
    ring = np.repeat(np.arange(len(brow)), fans)
    i = bstart[ring] + 1 + _ranges(fans)
    tri = np.stack([bpts[bstart[ring]], bpts[i], bpts[i + 1]], axis=1)
    e1, e2 = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    turn = e1[:, 0] * e2[:, 1] - e1[:, 1] * e2[:, 0]
    tri, sign, trow = tri[turn != 0], np.sign(turn[turn != 0]), brow[ring][turn != 0]
    tri = np.where((sign < 0)[:, None, None], tri[:, ::-1], tri)

    rings_in_row = np.bincount(arow, minlength=len(ax))
    first_ring = np.cumsum(rings_in_row) - rings_in_row
    t = np.repeat(np.arange(len(tri)), rings_in_row[trow])
    r = first_ring[trow[t]] + _ranges(rings_in_row[trow])
    ends = np.repeat(np.arange(len(arow)), asize)
    at = astart[ends] + _ranges(asize)
    cuts = np.cumsum(asize) - asize
    low, high = np.minimum.reduceat(apts[at], cuts), np.maximum.reduceat(apts[at], cuts)
    near = np.all((low[r] < tri.max(axis=1)[t]) & (high[r] > tri.min(axis=1)[t]), axis=1)
    t, r = t[near], r[near]

    padded = 1 << np.ceil(np.log2(asize[r])).astype(int) if len(r) else np.zeros(0, int)
    for width in np.unique(padded):
        ts, rs = t[padded == width], r[padded == width]
        step = max(1, POINTS_AT_ONCE // int(width))
        for k in range(0, len(ts), step):
            tk, rk = ts[k:k + step], rs[k:k + step]
            # short rings repeat their last point, which adds nothing to an area
            idx = astart[rk][:, None] + np.minimum(np.arange(width)[None], asize[rk][:, None] - 1)
            origin = tri[tk, :1]
            part = sign[tk] * _clipped_area(apts[idx] - origin, tri[tk] - origin)
            total += np.bincount(trow[tk], part, minlength=len(total))
    return total


def _beside(ring: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """The part of an open ring on one side of an axis-parallel line, in the same order.

    Runs on the other side shrink to the line between their crossings.  They enclose nothing, so signed areas stay whole.
    """
    d = sign * (at - ring[:, axis])
    nd, nxt = np.roll(d, -1), np.roll(ring, -1, axis=0)
    crosses = (d > 0) != (nd > 0)
    cross = ring + (np.where(crosses, d / np.where(d == nd, 1.0, d - nd), 0.0))[:, None] * (nxt - ring)
    cross[:, axis] = at
    return np.stack([ring, cross], axis=1).reshape(-1, 2)[np.stack([d > 0, crosses], axis=1).ravel()]


def cut_rings(rings: list[np.ndarray], max_points: int) -> list[list[np.ndarray]]:
    """Open rings cut into pieces of at most ``max_points`` points, by lines through the middle point of the longer side.

    Where a line would not halve the points (an outline that crosses it all the time), the other side is tried; a piece
    that neither helps stays as it is.
    """
    done, open_ = [], [rings]
    while open_:
        piece = open_.pop()
        points = np.concatenate(piece)
        if len(points) <= max_points:
            done.append(piece)
            continue
        extent = points.max(axis=0) - points.min(axis=0)
        for axis in (int(extent[1] > extent[0]), int(extent[1] <= extent[0])):
            at = float(np.median(points[:, axis]))
            if not points[:, axis].min() < at < points[:, axis].max():
                at = float(points[:, axis].min() + extent[axis] / 2)
            halves = [[part for part in (_beside(r, axis, at, sign) for r in piece) if len(part) > 2] for sign in (1, -1)]
            if max(sum(map(len, h)) for h in halves) <= 0.8 * len(points):
                open_ += [h for h in halves if h]
                break
        else:
            done.append(piece)
    return done


def box_overlap_area(a: str, b: str) -> Column:
    """Shared area of two bounding boxes held in columns ``<a>x0`` .. ``<b>y1``."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
