"""Joins of traces with traces, nodes and area boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.functions.lineage import cut
from riftspark.operators import grid, tiles

#: An intersection this near to an end is that end's own.
NEAR_INTERSECTION = 1e-3
#: Ends of two traces this near are one point.
SAME_END = 1e-4


def crossings(traces: DataFrame, cell: float, split: bool = False) -> DataFrame:
    """(network, a_id, a_seg, b_id, b_seg, x, y) of segments of different traces that meet, a_id < b_id, parallel ones left
    out. A point is computed once for the pair, so that both traces get the same coordinates."""
    if split:
        return _crossed(grid.other_pairs(grid.segments_of(traces), cell, split=True))
    return tiles.by_tile(grid.segments_of(traces), 2 * cell, 0.0, tiles.crossings, "a_id long, a_seg int, b_id long, b_seg int, x double, y double")


def _crossed(pairs: DataFrame) -> DataFrame:
    met = pairs.where(geom.segments_intersect("a_", "b_") & ~geom.parallel("a_", "b_")).withColumn("p", geom.crossing_point("a_", "b_"))
    return met.select(F.col("a_network").alias("network"), "a_id", "a_seg", "b_id", "b_seg", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def overlaps(traces: DataFrame, cell: float) -> DataFrame:
    """(network, a_id, a_seg, b_id, b_seg, x, y): both ends of the common part of collinear segments of different traces."""
    work = lambda t, tile: tiles.crossings(t, tile, None)
    return tiles.by_tile(grid.segments_of(traces), 2 * cell, 0.0, work, "a_id long, a_seg int, b_id long, b_seg int, x double, y double").distinct()


def _overlapped(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where(geom.segments_intersect("a_", "b_") & geom.parallel("a_", "b_"))
    pts = F.array(*[F.struct(F.col(f"{s}x{i}").alias("x"), F.col(f"{s}y{i}").alias("y"), F.lit(s).alias("side")) for s in ("a_", "b_") for i in (0, 1)])

    def on_other(p):
        inside = lambda s: p["x"].between(F.least(F.col(f"{s}x0"), F.col(f"{s}x1")), F.greatest(F.col(f"{s}x0"), F.col(f"{s}x1"))) & p["y"].between(
            F.least(F.col(f"{s}y0"), F.col(f"{s}y1")), F.greatest(F.col(f"{s}y0"), F.col(f"{s}y1"))
        )
        return F.when(p["side"] == "a_", inside("b_")).otherwise(inside("a_"))

    out = pairs.select(F.col("a_network").alias("network"), "a_id", "a_seg", "b_id", "b_seg", F.explode(F.filter(pts, on_other)).alias("p"))
    return out.select("network", "a_id", "a_seg", "b_id", "b_seg", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()


def crosscuts(crossed: DataFrame) -> DataFrame:
    """(network, a_id, b_id, n): different points where two traces meet."""
    return crossed.groupBy("network", "a_id", "b_id").agg(F.count_distinct("x", "y").alias("n"))


def multiple_crosscuts(traces: DataFrame, cell: float, least: int = 3) -> DataFrame:
    """(id): traces that meet one other trace in so many points or more.

    Where most traces do, comparing them in small blocks finds most of them; only the others are then compared with all traces
    near them, tile by tile, and none further than its first such partner. Pairs aren't shuffled.
    """
    box = geom.bounds("pts")
    wide = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    n, most, mean = traces.where(F.size("pts") > 1).agg(F.count("*"), F.max(F.size("pts") - 1), F.avg(wide)).first()
    rows = traces.where(F.size("pts") > 1).select(F.col("trace_id").alias("id"), "network", box.alias("b"), F.explode(geom.segments("pts")).alias("s"))
    rows = rows.select("id", "network", *[F.col(f"b.{c}").alias(o) for c, o in zip(("min_x", "min_y", "max_x", "max_y"), grid.SEGMENT, strict=True)], *[F.col(f"s.{c}").alias(f"s{c}") for c in grid.SEGMENT])
    if not n or most * most < least:  # straight traces meet once
        return rows.select("id").limit(0)
    block = F.pmod(F.xxhash64("id"), F.lit(-(-n // 2048)))
    first = cut(tiles.by_group(rows.withColumn("known", F.lit(False)).withColumn("block", block), ("network", "block"), lambda t, _: tiles.met_often(t, None, least), "id long").select("id"))
    rows = rows.join(first.withColumn("known", F.lit(True)), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    others = tiles.by_tile(rows, max(cell, 2 * mean), 0.0, lambda t, tile: tiles.met_often(t, tile, least), "id long").select("id")
    return first.unionByName(others).distinct()


def _with_ends(traces: DataFrame) -> DataFrame:
    """segments_of() with both ends of their traces."""
    out = traces.where(F.size("pts") > 1).select(F.col("trace_id").alias("id"), "network", geom.start("pts").alias("a"), geom.end("pts").alias("b"), F.explode(geom.segments("pts")).alias("s"))
    return out.select("id", "network", *[F.col(f"s.{c}").alias(c) for c in grid.SEGMENT], F.col("a.x").alias("ex0"), F.col("a.y").alias("ey0"), F.col("b.x").alias("ex1"), F.col("b.y").alias("ey1"))


def junctions(traces: DataFrame, cell: float, reach: float, threshold: int, kinds: str) -> DataFrame:
    """(id): traces with a node to which so many nodes of other traces are nearer than reach, and those nodes' traces. kinds: see
    tiles.trace_nodes(). Neither nodes nor pairs are shuffled."""
    work = lambda t, tile: tiles.near_flags(t, tile, reach, threshold, SAME_END, NEAR_INTERSECTION, kinds)
    return tiles.by_tile(_with_ends(traces), max(2 * cell, 16 * reach), 2 * reach + NEAR_INTERSECTION, work, "id long").select("id").distinct()


def multi_junctions(traces: DataFrame, cell: float, snap: float, multiplier: float = 1.1) -> DataFrame:
    """(id): traces with two foreign nodes, ends or intersections, near one of their own."""
    return junctions(traces, cell, snap * multiplier, 2, "met")


def v_nodes(traces: DataFrame, cell: float, snap: float, multiplier: float = 1.1) -> DataFrame:
    """(id): traces with a free end near a free end of another."""
    return junctions(traces, cell, snap * multiplier, 1, "free")


def end_distances(traces: DataFrame, cell: float, reach: float) -> DataFrame:
    """(id, end, x, y, other, d): other traces nearer than reach to an end, with their distance. All that is near to an end is in
    the end's tile, so that pairs aren't shuffled."""
    found = tiles.by_tile(_with_ends(traces), max(2 * cell, 4 * reach), reach, lambda t, tile: tiles.end_pairs(t, tile, reach), "id long, end int, x double, y double, other long, d double")
    return found.drop("network")


def snap_errors(traces: DataFrame, cell: float, snap: float, multiplier: float = 1.1) -> DataFrame:
    """(id, error): ends that miss another trace by more than snap and less than snap x multiplier while none is nearer.

    A trace that the missed one cuts anywhere, but not just touches at its ends, overlaps it; one that runs on it for a
    stretch can't be cut there and is stacked; else it underlaps. Only pairs that miss are compared further.
    """
    reach = snap * multiplier
    banded = tiles.by_tile(_with_ends(traces), max(2 * cell, 4 * reach), reach, lambda t, tile: tiles.end_pairs(t, tile, reach, snap), "id long, other long")
    banded = cut(banded.select("id", "other").distinct())
    segments = grid.segments_of(traces)
    of = lambda p: segments.select(*[F.col(c).alias(p + c) for c in segments.columns])
    pairs = banded.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()
    pairs = cut(pairs.join(of("a_"), "a_id").join(of("b_"), "b_id").where(geom.bbox_overlap("a_", "b_")))
    crossed = _crossed(pairs)
    both = crossed.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"))
    both = both.unionByName(crossed.select(F.col("b_id").alias("id"), F.col("a_id").alias("other"), F.col("x").alias("px"), F.col("y").alias("py")))
    tips = grid.ends_of(traces).groupBy("id").agg(*[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{c}{e}") for e in (0, 1) for c in ("x", "y")])
    at_tip = lambda e: F.hypot(F.col("px") - F.col(f"x{e}"), F.col("py") - F.col(f"y{e}")) < 1e-9
    cuts = both.join(tips, "id").where(~at_tip(0) & ~at_tip(1)).select("id", "other").distinct().withColumn("cut", F.lit(True))
    runs = _overlapped(pairs).groupBy("a_id", "b_id").agg(F.count_distinct("x", "y").alias("n")).where("n > 1")
    runs = runs.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")))).alias("p")).select("p.*").distinct().withColumn("run", F.lit(True))
    kind = banded.join(cuts, ["id", "other"], "left").join(runs, ["id", "other"], "left")
    error = F.when(F.col("run"), "STACKED TRACES").when(F.col("cut"), "OVERLAPPING SNAP").otherwise("UNDERLAPPING SNAP")
    return kind.select("id", error.alias("error")).distinct()


def proximal(traces: DataFrame, cell: float, buffer: float, tolerance: float) -> DataFrame:
    """traces with the column merge: whether another trace is as near as the buffer and runs alike, by its ends or by
    its regression line. Directions go with the segments, so that pairs give traces at once and aren't shuffled."""
    turned = traces.select(F.col("trace_id").alias("id"), "network", geom.azimuth("pts").alias("az"), geom.regression_azimuth("pts").alias("reg"), F.explode(geom.segments("pts")).alias("s"))
    turned = turned.select("id", "network", "az", "reg", *[F.col(f"s.{c}").alias(c) for c in grid.SEGMENT])
    flagged = tiles.by_tile(turned, max(2 * cell, 2 * buffer), buffer, lambda t, _: tiles.run_alike(t, buffer, tolerance), "id long")
    flagged = flagged.select(F.col("id").alias("trace_id")).distinct().withColumn("__m", F.lit(True))
    return traces.join(flagged, "trace_id", "left").withColumn("merge", F.coalesce("__m", F.lit(False))).drop("__m")


def distinct_points(points: DataFrame, reach: float) -> DataFrame:
    """Points (id, network, x, y) without those nearer than reach to a point of a smaller id that itself stays.

    One round drops what is near a point that has no smaller neighbour; the rounds end when no pair is left.
    """
    left, kept = points, None
    while True:
        pairs = grid.other_pairs(grid.as_segments(left.select("id", "network", "x", "y")), max(4 * reach, 1e-9), reach)
        close = cut(pairs.where(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) < reach).select("a_id", "b_id"))
        lowest = left.join(close.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
        kept = lowest if kept is None else kept.unionByName(lowest)
        if close.isEmpty():
            return kept
        gone = close.join(lowest.select(F.col("id").alias("a_id")), "a_id").select(F.col("b_id").alias("id")).distinct()
        left = cut(left.join(lowest.select("id"), "id", "left_anti").join(gone, "id", "left_anti"))
        kept = cut(kept)


# Areas


def boundaries(areas: DataFrame) -> DataFrame:
    """(id, network, seg, x0, y0, x1, y1): the sides of areas (area_id, network, rings)."""
    out = areas.select(F.col("area_id").alias("id"), "network", F.posexplode(geom.boundary_segments("rings")).alias("seg", "s"))
    return out.select("id", "network", "seg", *[F.col(f"s.{c}").alias(c) for c in grid.SEGMENT])


def inside_areas(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """points (key columns, network, x, y) that lie in an area of their network, once each. A ray to the right counts
    sides in the point's row of cells: sides are joined by that row, and the sums are formed by partial aggregation.
    A point on a side of an area isn't inside that area."""
    sides = boundaries(areas).withColumn("row", F.explode(F.sequence(F.floor(F.least("y0", "y1") / cell), F.floor(F.greatest("y0", "y1") / cell))))
    keys = points.columns
    at = points.withColumn("row", F.floor(F.col("y") / cell))
    s = sides.select(F.col("id").alias("__area"), F.col("network").alias("__network"), "row", *grid.SEGMENT)
    x = F.col("x0") + geom.ratio((F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")), F.col("y1") - F.col("y0"))
    px, py = F.col("x"), F.col("y")
    ray = ((F.col("y0") > py) != (F.col("y1") > py)) & (px < x)
    turn = (F.col("x1") - F.col("x0")) * (py - F.col("y0")) - (F.col("y1") - F.col("y0")) * (px - F.col("x0"))
    on = (turn == 0) & px.between(F.least("x0", "x1"), F.greatest("x0", "x1")) & py.between(F.least("y0", "y1"), F.greatest("y0", "y1"))
    hits = at.join(s, (at["row"] == s["row"]) & (at["network"] == s["__network"]) & (ray | on))
    sums = hits.groupBy(*keys, "__area").agg(F.count(F.when(ray, 1)).alias("__n"), F.max(on).alias("__on"))
    return sums.where("__n % 2 = 1 and not __on").select(*keys).distinct()


def boundary_flags(lines: DataFrame, areas: DataFrame, cell: float, snap: float) -> DataFrame:
    """(trace_id, near, through): whether a line comes nearer than snap to a boundary, and whether it cuts through: all its
    ends are near the boundary, or none lies inside an area while the line touches one. Ends on a side aren't inside."""
    sides = boundaries(areas)
    pairs = grid.box_pairs(grid.segments_of(lines), sides, cell, snap, ("network",))
    met = pairs.withColumn("d", geom.segment_distance("a_", "b_")).where(F.col("d") < snap)
    by_line = met.groupBy(F.col("a_id").alias("trace_id")).agg(F.lit(True).alias("near"), F.max(F.col("d") == 0).alias("touches"))
    ends = grid.ends_of(lines)
    end_pairs = grid.box_pairs(grid.as_segments(ends), sides, cell, snap, ("network",))
    d = geom.point_segment_distance(*(F.col(c) for c in ("a_x", "a_y", "b_x0", "b_y0", "b_x1", "b_y1")))
    ends_near = end_pairs.where(d < snap).select(F.col("a_id").alias("trace_id"), F.col("a_end").alias("end")).distinct().groupBy("trace_id").agg(F.count("*").alias("n_near"))
    inside = inside_areas(ends, areas, cell).groupBy(F.col("id").alias("trace_id")).agg(F.count("*").alias("n_inside"))
    out = lines.select("trace_id").join(by_line, "trace_id", "left").join(ends_near, "trace_id", "left").join(inside, "trace_id", "left")
    near = F.coalesce("near", F.lit(False))
    # a line all of whose points lie inside touches its area too, but then an end is inside
    through = (F.coalesce("n_near", F.lit(0)) == 2) | ((F.coalesce("n_inside", F.lit(0)) == 0) & F.coalesce("touches", F.lit(False)))
    return out.select("trace_id", near.alias("near"), through.alias("through"))


def boundary_counts(flags: DataFrame) -> DataFrame:
    """(trace_id, crossings, weight) of boundary_flags()."""
    n = F.col("near").cast("int") + F.col("through").cast("int")
    return flags.select("trace_id", n.alias("crossings"), geom.boundary_weight(n).alias("weight"))


def target_area_underlaps(traces: DataFrame, areas: DataFrame, cell: float, snap: float, multiplier: float = 1.1, area_multiplier: float = 1.5) -> DataFrame:
    """(id): traces with an end inside an area whose distance to the boundary is from snap to snap x both multipliers,
    and which don't cross the boundary near that end."""
    reach = snap * multiplier * area_multiplier
    sides = boundaries(areas)
    ends = inside_areas(grid.ends_of(traces), areas, cell)
    pairs = grid.box_pairs(grid.as_segments(ends), sides, cell, reach, ("network",))
    d = geom.point_segment_distance(*(F.col(c) for c in ("a_x", "a_y", "b_x0", "b_y0", "b_x1", "b_y1")))
    banded = pairs.withColumn("d", d).groupBy(F.col("a_id").alias("id"), F.col("a_end").alias("end"), F.col("a_x").alias("x"), F.col("a_y").alias("y")).agg(F.min("d").alias("d")).where((F.col("d") >= snap) & (F.col("d") < reach))
    cut = grid.box_pairs(grid.segments_of(traces), sides, cell, 0.0, ("network",)).where(geom.segments_intersect("a_", "b_") & ~geom.parallel("a_", "b_"))
    cut = cut.withColumn("p", geom.crossing_point("a_", "b_")).select(F.col("a_id").alias("id"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    reached = banded.join(cut, "id").where(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) < 2 * reach).select("id", "end").distinct()
    return banded.join(reached, ["id", "end"], "left_anti").select("id").distinct()


def empty_area(traces: DataFrame, areas: DataFrame, cell: float) -> bool:
    """Whether no trace meets any area."""
    met = grid.box_pairs(grid.segments_of(traces), boundaries(areas), cell, 0.0, ("network",)).where(geom.segments_intersect("a_", "b_"))
    return met.isEmpty() and inside_areas(grid.ends_of(traces), areas, cell).isEmpty()


def nodes_on_traces(nodes: DataFrame, traces: DataFrame, buffer: float, cell: float) -> DataFrame:
    """(node columns, trace_id, at_end): traces as near to a node (id, network, x, y) as the buffer, and whether an end is."""
    pairs = grid.box_pairs(grid.as_segments(nodes), grid.segments_of(traces), cell, buffer, ("network",))
    d = geom.point_segment_distance(*(F.col(c) for c in ("a_x", "a_y", "b_x0", "b_y0", "b_x1", "b_y1")))
    near = pairs.where(d <= buffer).select(*[F.col(f"a_{c}").alias(c) for c in nodes.columns], F.col("b_id").alias("trace_id")).distinct()
    ends = grid.ends_of(traces).select(F.col("id").alias("trace_id"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    return near.join(ends, "trace_id").groupBy(*nodes.columns, "trace_id").agg(F.max(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) <= buffer).alias("at_end"))
