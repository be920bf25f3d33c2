"""Polygon overlay, assignment, interpolation, adjacency and cut edges as joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import residual_count, to_number
from ..storage import materialize
from .joins import dimension, fits, salted_join, shuffled
from .keyed import assert_unique

# Pairs of one piece that a task fetches; points of a piece; pieces of a layer that may be broadcast.
PAIRS_PER_TASK = 20_000
PIECE_POINTS = 128
PIECES_HELD = 50_000


def _with_box(df: DataFrame, rings: str, prefix: str) -> DataFrame:
    names = [prefix + n for n in ("x0", "y0", "x1", "y1")]
    return df.withColumns(dict(zip(names, G.bounds(rings))))


def _level(prefix: str):
    """Power of two that just holds the longer side of a box."""
    return F.ceil(F.log2(F.greatest(F.col(f"{prefix}x1") - F.col(f"{prefix}x0"),
                                    F.col(f"{prefix}y1") - F.col(f"{prefix}y0")))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    return sorted(df.agg(F.collect_set("_own").alias("l")).first()["l"])      # binary exponents: a few dozen


def _cells(df: DataFrame, prefix: str) -> DataFrame:
    """Grid cells of size 2^_at that a box touches: at most four, as the box is no larger than a cell."""
    size = F.pow(F.lit(2.0), F.col("_at"))

    def run(low: str, high: str):
        return F.sequence(F.floor(F.col(low) / size).cast("bigint"), F.floor(F.col(high) / size).cast("bigint"))

    return df.withColumn("_cx", F.explode(run(f"{prefix}x0", f"{prefix}x1"))).withColumn(
        "_cy", F.explode(run(f"{prefix}y0", f"{prefix}y1"))).drop("_own")


def candidate_pairs(source: DataFrame, target: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """Pairs whose boxes (``s_x0``.. and ``t_x0``..) share an area.

    Every box has its own grid, the one whose cells just hold it.  Two boxes
    meet on the grid of the larger one, where that one lies in at most four
    cells and, in a layer that does not overlap itself, next to few others.
    So a crowded district of small boxes never meets itself as all pairs,
    however sizes mix.  Cells with many of the smaller boxes are salted.  A
    pair is kept only in the cell of the lower left corner of the shared box,
    so no distinct is needed.
    """
    s = source.withColumn("_own", _level("s_")).where("_own is not null")      # a box without extent has no level
    t = target.withColumn("_own", _level("t_")).where("_own is not null")
    s_levels, t_levels = _levels(s), _levels(t)
    low_x, low_y = F.greatest("s_x0", "t_x0"), F.greatest("s_y0", "t_y0")
    size = F.pow(F.lit(2.0), F.col("_at"))

    def meet(small: DataFrame, p: str, large: DataFrame, q: str, levels: list[int], strictly: bool) -> DataFrame:
        reach = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: (v > F.col("_own")) if strictly else (v >= F.col("_own")))
        left = _cells(small.withColumn("_at", F.explode(reach)), p)
        right = _cells(large.withColumn("_at", F.col("_own")), q)
        return salted_join(left, right, ["_at", "_cx", "_cy"], rows_per_task, unfolded=True).where(
            (low_x < F.least("s_x1", "t_x1")) & (low_y < F.least("s_y1", "t_y1"))
            & (F.floor(low_x / size) == F.col("_cx")) & (F.floor(low_y / size) == F.col("_cy"))
        ).select(*source.columns, *target.columns)

    if not s_levels or not t_levels:
        return source.where("false").withColumns({c: F.lit(None).cast(k) for c, k in target.dtypes})
    parts = []
    if s_levels[0] <= t_levels[-1]:                        # target at least as large
        parts.append(meet(s, "s_", t, "t_", t_levels, False))
    if t_levels[0] < s_levels[-1]:                         # source larger
        parts.append(meet(t, "t_", s, "s_", s_levels, True))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def overlay_boxes(source: DataFrame, target: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """Shared areas of axis-aligned boxes ``x0,y0,x1,y1``, without leaving the JVM."""
    def named(df: DataFrame, key: str, p: str) -> DataFrame:
        return df.select(F.col(key), *[F.col(c).cast("double").alias(p + c) for c in ("x0", "y0", "x1", "y1")])

    pairs = candidate_pairs(named(source, source_id, "s_"), named(target, target_id, "t_"))
    return pairs.select(
        source_id, target_id,
        ((F.col("s_x1") - F.col("s_x0")) * (F.col("s_y1") - F.col("s_y0"))).alias("src_area"),
        G.box_overlap_area("s_", "t_").alias("inter_area"),
    ).where(F.col("inter_area") > 0)


def _flat(df: DataFrame, key: str, rings: str, p: str) -> DataFrame:
    """Id, area, flat coordinates and piece number 0 of every outline, interiors to the left."""
    r = df.select(key, G.wound(rings).alias("_r"))
    return r.select(key, F.lit(0).alias(p + "piece"), G.area("_r").alias(p + "area"), G.xs("_r").alias(p + "x"),
                    G.ys("_r").alias(p + "y"), G.ring_sizes("_r").alias(p + "n"))


def outline_pieces(flat: DataFrame, p: str, max_points: int = PIECE_POINTS) -> tuple[DataFrame, bool]:
    """The outlines with those of more than ``max_points`` points cut into pieces, and whether there were any.

    Pieces are cut once, one outline at a time, by lines that halve its points, until each is small; the inside of a
    large outline becomes plain boxes.  They do not overlap, and their signed areas add up to the whole.
    """
    flat = materialize(flat)
    large = flat.where(F.size(p + "x") > max_points)
    if large.isEmpty():
        return flat, False

    def cut(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x, y, n = (np.asarray(row[p + c]) for c in "xyn")
                ends = np.cumsum(n)
                rings = [np.column_stack([x[e - k:e - 1], y[e - k:e - 1]]) for e, k in zip(ends, n) if k > 3]
                pieces = G.cut_rings(rings, max_points)
                closed = [[np.vstack([r, r[:1]]) for r in piece] for piece in pieces]
                yield pd.DataFrame({**{c: [row[c]] * len(pieces) for c in pdf.columns}, p + "piece": range(len(pieces)),
                                    p + "x": [np.concatenate(c)[:, 0] for c in closed], p + "y": [np.concatenate(c)[:, 1] for c in closed],
                                    p + "n": [[len(r) for r in c] for c in closed]})

    parts = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = large.repartition(parts, F.xxhash64(p + "x", p + "y"))
    return materialize(flat.where(~(F.size(p + "x") > max_points)).unionByName(dealt.mapInPandas(cut, flat.schema))), True


def overlay_polygons(source: DataFrame, target: DataFrame, source_id: str, target_id: str,
                     source_rings: str = "rings", target_rings: str = "rings", max_points: int = PIECE_POINTS) -> DataFrame:
    """Shared areas of polygons with holes and several parts, drawn either way round.

    Outlines are cut into pieces of at most ``max_points`` points first, so no pair carries a whole coastline.  Only ids
    and boxes of pieces pass the cell join.  The coordinates are fetched for the pairs that remain, which are dealt out
    evenly, each is clipped once, in Arrow batches, and the pieces of a pair are summed.
    """
    s, s_cut = outline_pieces(_flat(source, source_id, source_rings, "_s"), "_s", max_points)
    t, t_cut = outline_pieces(_flat(target, target_id, target_rings, "_t"), "_t", max_points)

    def boxes(df: DataFrame, key: str, p: str, q: str) -> DataFrame:
        ends = [F.array_min(p + "x"), F.array_min(p + "y"), F.array_max(p + "x"), F.array_max(p + "y")]
        return df.select(key, p + "piece", *[c.alias(q + n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"))])

    on_s, on_t = [source_id, "_spiece"], [target_id, "_tpiece"]
    pairs = materialize(candidate_pairs(boxes(s, source_id, "_s", "s_"), boxes(t, target_id, "_t", "t_")).select(*on_s, *on_t))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.drop("_tarea")
    if fits(s, PIECES_HELD) and fits(t, PIECES_HELD):
        met = pairs.repartition(parts, *on_s, *on_t).join(F.broadcast(t), on_t).join(F.broadcast(s), on_s)
    else:
        met = (salted_join(salted_join(pairs, t, on_t, PAIRS_PER_TASK, unfolded=True), s, on_s, PAIRS_PER_TASK, unfolded=True)
               .repartition(parts, *on_s, *on_t))
    shared = G.overlap_area.asNondeterministic()            # so that the filter stays above the even deal
    clipped = met.select(source_id, target_id, F.col("_sarea").alias("src_area"), shared("_sx", "_sy", "_sn", "_tx", "_ty", "_tn").alias("inter_area"))
    if s_cut or t_cut:
        clipped = clipped.groupBy(source_id, target_id, "src_area").agg(F.sum("inter_area").alias("inter_area"))
    return clipped.where(F.col("inter_area") > 0)


def largest_overlap(overlay: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """Target with the largest shared area per source; the lower target id wins a tie."""
    best = F.min_by(F.struct(F.col(target_id), F.col("inter_area")),
                    F.struct(-F.col("inter_area"), F.col(target_id)))
    return overlay.groupBy(source_id).agg(best.alias("b")).select(source_id, "b.*")


def assign_by_area(units: DataFrame, overlay: DataFrame, unit_id: str, district_id: str) -> DataFrame:
    """Every unit with the district it overlaps most; NULL where it touches none."""
    best = largest_overlap(overlay, unit_id, district_id)
    if best.isEmpty():
        raise ValueError("the overlay of units and districts has no intersection")
    return units.join(best.select(unit_id, district_id), unit_id, "left")


def area_weights(overlay: DataFrame) -> DataFrame:
    """Share of the source area inside the target, in 0..1; sources without area are left out."""
    w = F.least(F.greatest(F.col("inter_area") / F.col("src_area"), F.lit(0.0)), F.lit(1.0))
    return overlay.where(F.col("src_area") > 0).withColumn("w", w)


def interpolate_counts(overlay: DataFrame, attrs: DataFrame, targets: DataFrame, source_id: str,
                       target_id: str, counts: list[str]) -> DataFrame:
    """Source counts spread over targets by area weight, whole numbers, 0 where nothing falls.

    Sums are cut to nine digits before they are made whole, so a sum that is
    just a half does not depend on the order the tasks added it in.
    """
    weighted = area_weights(overlay).join(attrs.select(source_id, *counts), source_id, "left")
    sums = weighted.groupBy(target_id).agg(
        *[F.sum(F.coalesce(to_number(c), F.lit(0.0)) * F.col("w")).alias(c) for c in counts])
    return targets.join(sums, target_id, "left").select(
        *targets.columns, *[F.rint(F.round(F.coalesce(F.col(c), F.lit(0.0)), 9)).cast("bigint").alias(c) for c in counts])


def unit_demographics(blocks: DataFrame, pl: DataFrame, overlay: DataFrame, units: DataFrame, unit_id: str,
                      total: str, groups: dict[str, str]) -> DataFrame:
    """Voting-age counts per unit from block counts, with the residual group."""
    assert_unique(blocks, ["geoid20"], "census blocks")
    assert_unique(pl, ["geoid20"], "block attributes")
    out = interpolate_counts(overlay, pl, units.select(unit_id), "geoid20", unit_id, [total, *groups.values()])
    named = out.select(unit_id, F.col(total).alias("vap_total"), *[F.col(c).alias(n) for n, c in groups.items()])
    known = ["vap_nh_white", "vap_nh_black", "vap_hisp", "vap_nh_asian", "vap_nh_native"]
    for c in known:
        if c not in named.columns:
            named = named.withColumn(c, F.lit(0).cast("bigint"))
    return named.select(unit_id, "vap_total", *known).withColumn("vap_other", residual_count("vap_total", known))


def ring_segments(units: DataFrame, unit_id: str, rings: str = "rings") -> DataFrame:
    """Directed boundary segments, interiors to their left."""
    ring = units.select(unit_id, F.explode(G.wound(rings)).alias("r"))
    n = F.size("r") - 1
    seg = ring.select(unit_id, F.explode(F.zip_with(
        F.slice("r", F.lit(1), n), F.slice("r", F.lit(2), n),
        lambda p, q: F.struct(p["x"].alias("xa"), p["y"].alias("ya"), q["x"].alias("xb"), q["y"].alias("yb")))
    ).alias("s"))
    return seg.select(unit_id, "s.*")


PIECES = 2                                               # Fixed value: pieces that a segment is cut into on its own grid


def _piece_centres(seg: DataFrame) -> DataFrame:
    """A segment's pieces on the grid ``_at``, no longer than a cell (2^_at / PIECES), each in the cell of its middle."""
    size = F.pow(F.lit(2.0), F.col("_at")) / PIECES
    each = seg.withColumn("_n", F.ceil(F.col("_len") / size).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    middle = lambda c: F.col(c + "a") + (F.col(c + "b") - F.col(c + "a")) * (F.col("_i") + 0.5) / F.col("_n")
    return each.withColumns({"_cx": F.floor(middle("x") / size).cast("bigint"), "_cy": F.floor(middle("y") / size).cast("bigint")})


def _cells_along(seg: DataFrame, reach: float) -> DataFrame:
    """Cells of the grid ``_at`` in which a piece that comes within ``reach`` of the segment may have its middle, each once."""
    size = F.pow(F.lit(2.0), F.col("_at")) / PIECES
    margin = size / 2 + 2 * reach
    at = lambda c, k: F.col(c + "a") + (F.col(c + "b") - F.col(c + "a")) * k / F.col("_p")
    # the cells of the pieces move one way only, so a cell is new to a piece if the piece before did not have it
    each = seg.withColumn("_p", F.ceil(F.col("_len") / size).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    for c in ("x", "y"):
        for name, k in (("", F.col("_j")), ("o", F.greatest(F.col("_j") - 1, F.lit(0)))):
            ends = at(c, k), at(c, k + 1)
            each = each.withColumns({f"_{c}l{name}": F.floor((F.least(*ends) - margin) / size).cast("bigint"),
                                     f"_{c}h{name}": F.floor((F.greatest(*ends) + margin) / size).cast("bigint")})
    cells = each.withColumn("_cx", F.explode(F.sequence("_xl", "_xh"))).withColumn("_cy", F.explode(F.sequence("_yl", "_yh")))
    return cells.where((F.col("_j") == 0) | ~(F.col("_cx").between(F.col("_xlo"), F.col("_xho")) & F.col("_cy").between(F.col("_ylo"), F.col("_yho")))).select(
        *seg.columns, "_cx", "_cy")


def adjacency(units: DataFrame, unit_id: str, rings: str = "rings", tolerance: float | None = None,
              digits: int = 9) -> DataFrame:
    """Neighbouring units (``src < dst``) with the length of their shared boundary, also where only parts of segments meet.

    Interiors lie left of a segment, so a neighbour runs along the same stretch the other way.  Two opposite segments
    share the stretch over which the shorter one, measured from the longer one's own start, stays within ``tolerance``
    of it; a stretch no longer than the tolerance does not count.  Corners may differ by up to half the tolerance, and
    coordinates may be of any size, since all distances are taken near the segments.  By default the tolerance is
    ten to the minus ``digits``, or 64 roundings of the largest coordinate if that is more.

    Segments meet on grids that fit their lengths: each has a grid of cells half as wide as it is long, and two
    segments meet on the grid of the longer one, which is there in all cells along it, the shorter one once for each
    of its pieces.  So no line, row or column of the map is one key, a crowded place of short segments meets few long
    ones, and each pair counts with the piece in which its shared stretch begins only.
    """
    seg = ring_segments(units, unit_id, rings).withColumn("_len", F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))       # outlines unfold, so their files' tasks are too few
    seg = seg.repartition(parts, F.xxhash64("xa", "ya", "xb", "yb"))
    seg = materialize(seg.where((F.col("_len") > 0) & (F.col("_len") < float("inf"))).withColumn("_own", F.ceil(F.log2("_len")).cast("int")))
    largest, found = seg.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in ("xa", "ya", "xb", "yb")])), F.collect_set("_own")).first()
    if not found:
        return seg.select(F.col(unit_id).alias("src"), F.col(unit_id).alias("dst"), F.lit(0.0).alias("shared_length"))
    reach = float(tolerance) if tolerance else max(10.0 ** -digits, 64 * 2.0 ** -52 * largest)
    finest = math.ceil(math.log2(4 * PIECES * reach))       # no cell is narrower than four reaches
    levels = sorted({max(v, finest) for v in found})        # binary exponents: a few dozen
    seg = seg.where(F.col("_len") > reach).withColumn("_own", F.greatest("_own", F.lit(finest)))

    def side(df: DataFrame, p: str, *more: str) -> DataFrame:
        return df.select(F.xxhash64("_at", "_cx", "_cy").alias("_cell"), "_at", "_cx", "_cy", *more, *[F.col(c).alias(p + c) for c in (unit_id, "xa", "ya", "xb", "yb", "_len", "_own")])

    every = seg.withColumn("_at", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_own"))))
    shorter, longer = side(_piece_centres(every), "a", "_i", "_n"), side(_cells_along(seg.withColumn("_at", F.col("_own")), reach), "b")
    step = lambda p, c: F.col(f"{p}{c}b") - F.col(f"{p}{c}a")
    turned = step("a", "x") * step("b", "x") + step("a", "y") * step("b", "y") < 0
    low, high = (lambda p, c: F.least(f"{p}{c}a", f"{p}{c}b")), (lambda p, c: F.greatest(f"{p}{c}a", f"{p}{c}b"))
    beside = lambda c: (low("a", c) - high("b", c) <= 2 * reach) & (low("b", c) - high("a", c) <= 2 * reach)
    # sorts compare the first key by its prefix: a hash tells cells apart there, whatever the map's shape
    pairs = salted_join(shorter, longer, ["_cell", "_at", "_cx", "_cy"], unfolded=True).where(
        (F.col("a" + unit_id) != F.col("b" + unit_id))
        # equal grids: the pair comes from both sides, so it counts once
        & ((F.col("a_own") < F.col("b_own")) | (F.col("a" + unit_id) < F.col("b" + unit_id)))
        # most of those that meet run the same way or across, or lie apart: a few comparisons tell, before anything is measured
        & turned & beside("x") & beside("y"))
    # numbered rows keep the steps of the measuring apart: filters pushed through them would write each step out many times
    # over in the join's own condition, a method too long to be compiled
    numbered = lambda df: df.withColumn("_pair", F.monotonically_increasing_id()).where("_pair >= 0")
    ux, uy = (F.col("bxb") - F.col("bxa")) / F.col("b_len"), (F.col("byb") - F.col("bya")) / F.col("b_len")
    pairs = numbered(pairs.withColumns({"_ux": ux, "_uy": uy, **{f"_{c}{e}": F.col(f"a{c}{e}") - F.col(f"b{c}a") for c in "xy" for e in "ab"}}))
    along = lambda e: F.col("_ux") * F.col(f"_x{e}") + F.col("_uy") * F.col(f"_y{e}")
    off = lambda e: F.col("_ux") * F.col(f"_y{e}") - F.col("_uy") * F.col(f"_x{e}")
    pairs = numbered(pairs.withColumns({"_ta": along("a"), "_tb": along("b"), "_da": off("a"), "_db": off("b")})).where("_tb < _ta").withColumns(
        {"_lo": F.greatest(F.col("_tb"), F.lit(0.0)), "_hi": F.least(F.col("_ta"), F.col("b_len"))}).where(F.col("_hi") - F.col("_lo") > reach)
    apart = lambda t: F.abs(F.col("_da") + (F.col("_db") - F.col("_da")) * (F.col(t) - F.col("_ta")) / (F.col("_tb") - F.col("_ta")))
    begins = F.floor((F.col("_ta") - F.col("_hi")) / (F.col("_ta") - F.col("_tb")) * F.col("_n"))
    pairs = pairs.where((apart("_lo") <= reach) & (apart("_hi") <= reach) & (F.least(F.greatest(begins, F.lit(0)), F.col("_n") - 1) == F.col("_i")))
    return pairs.select(F.least("a" + unit_id, "b" + unit_id).alias("src"), F.greatest("a" + unit_id, "b" + unit_id).alias("dst"),
                        (F.col("_hi") - F.col("_lo")).alias("_len")).groupBy("src", "dst").agg(F.sum("_len").alias("shared_length"))


PLANS_TOGETHER = 64                                      # Fixed value: plans whose districts of a unit are one row


def cut_edges(edges: DataFrame, plan_map: DataFrame) -> DataFrame:
    """Edges whose two units lie in different districts, per plan.

    What a unit has in up to about PLANS_TOGETHER plans is one row, which meets the edges that start at the unit and then
    the row of the unit at the other end.  So an edge is sent once for that many plans, and no key gathers a plan.
    Rows that are there twice count for each, and a unit without a row in a plan has no edges in it.
    """
    m = plan_map.select("plan_id", "vtd_geoid", "district_id").where("plan_id is not null and vtd_geoid is not null")
    plans = m.agg(F.approx_count_distinct("plan_id")).first()[0]
    m = m.withColumn("_set", F.pmod(F.xxhash64("plan_id"), F.lit(-(-plans // PLANS_TOGETHER) or 1)).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("plan_id", "district_id")))
    rows = m.repartition("vtd_geoid").groupBy("vtd_geoid", "_set").agg(listed.alias("_in")).select(
        "vtd_geoid", "_set", F.col("_in.plan_id").alias("_plans"), F.col("_in.district_id").alias("_districts")).withColumn(
        "_once", F.size(F.array_distinct("_plans")) == F.size("_plans"))
    start = rows.withColumnsRenamed({"vtd_geoid": "src"})
    end = rows.select(F.col("vtd_geoid").alias("dst"), "_set", F.col("_plans").alias("_plans_to"), F.col("_districts").alias("_to"))
    reached = start.join(shuffled(edges.select("src", "dst")), "src").join(shuffled(end), ["dst", "_set"])
    cut = lambda x, y: F.coalesce(x != y, F.lit(False))
    named = lambda p, q, r: F.struct(p.alias("plan_id"), cut(q, r).alias("cut"))
    one_by_one = F.flatten(F.transform(F.arrays_zip("_plans", "_districts"), lambda a: F.transform(
        F.filter(F.arrays_zip("_plans_to", "_to"), lambda b: b["_plans_to"] == a["_plans"]), lambda b: named(a["_plans"], a["_districts"], b["_to"]))))
    side_by_side = F.zip_with("_plans", F.zip_with("_districts", "_to", cut), lambda p, c: F.struct(p.alias("plan_id"), c.alias("cut")))
    each = F.when(F.col("_once") & (F.col("_plans") == F.col("_plans_to")), side_by_side).otherwise(one_by_one)
    return reached.select(F.inline(each)).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("cut").alias("n_cut_edges"))


def compactness(units: DataFrame, unit_id: str, rings: str = "rings") -> DataFrame:
    """Area, perimeter and the four compactness ratios per geometry, which are dealt out evenly before the hulls are sought."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = units.repartition(parts, F.xxhash64(G.xs(rings), G.ys(rings))).withColumn("_e", G.enclosing_areas(G.xs(rings), G.ys(rings)))
    a = G.area(rings)
    return around.select(
        unit_id, a.alias("area"), G.perimeter(rings).alias("perimeter"),
        G.polsby_popper(rings).alias("polsby_popper"), G.schwartzberg(rings).alias("schwartzberg"),
        F.try_divide(a, F.col("_e.hull_area")).alias("convex_hull_ratio"),
        F.try_divide(a, F.col("_e.circle_area")).alias("reock"))


def invalid_geometries(units: DataFrame, unit_id: str, rings: str = "rings") -> DataFrame:
    return units.select(unit_id, G.invalid_reason(rings).alias("reason")).where("reason is not null")
