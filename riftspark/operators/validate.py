"""Validation rules for traces, and the runner that puts their errors into one ordered list for each trace.

Row rules are Column expressions and run on a stream as well; the others are joins. A row that fails a major rule (null,
or many parts that don't merge) gets only that error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.functions.lineage import cut
from riftspark.operators import grid, joins, overlay, tiles

#: The rules' error strings in the order of the list (fixed values).
ERRORS = (
    "NULL GEOMETRY",
    "GEOM TYPE MULTILINESTRING",
    "CUTS ITSELF",
    "MULTI JUNCTION",
    "V NODE",
    "MULTIPLE CROSSCUTS",
    "UNDERLAPPING SNAP",
    "OVERLAPPING SNAP",
    "TRACE UNDERLAPS TARGET AREA",
    "STACKED TRACES",
    "SHARP TURNS",
)
MAJOR = ERRORS[:2]


@dataclass(frozen=True)
class Thresholds:
    snap: float = 0.01
    multiplier: float = 1.1
    area_multiplier: float = 1.5
    triangle: float = 10.0
    overlap: float = 50.0
    stacked_buffer: float = 5.0
    sharp_average: float = 135.0
    sharp_previous: float = 100.0


# Row rules


def is_null(pts: str | Column) -> Column:
    p = F.col(pts) if isinstance(pts, str) else pts
    return p.isNull() | (F.size(p) == 0)


def cuts_itself(pts: str | Column) -> Column:
    """Whether a line is a ring, or any two of its segments meet elsewhere than in the vertex that neighbours share."""
    p = F.col(pts) if isinstance(pts, str) else pts
    s = geom.segments(p)
    numbered = F.transform(s, lambda v, i: F.struct(i.alias("i"), v.alias("s")))

    def cross(ax, ay, bx, by, cx, cy):
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def meet(a, b):
        d1, d2 = cross(a["x0"], a["y0"], a["x1"], a["y1"], b["x0"], b["y0"]), cross(a["x0"], a["y0"], a["x1"], a["y1"], b["x1"], b["y1"])
        d3, d4 = cross(b["x0"], b["y0"], b["x1"], b["y1"], a["x0"], a["y0"]), cross(b["x0"], b["y0"], b["x1"], b["y1"], a["x1"], a["y1"])
        boxes = (F.least(a["x0"], a["x1"]) <= F.greatest(b["x0"], b["x1"])) & (F.least(b["x0"], b["x1"]) <= F.greatest(a["x0"], a["x1"]))
        boxes = boxes & (F.least(a["y0"], a["y1"]) <= F.greatest(b["y0"], b["y1"])) & (F.least(b["y0"], b["y1"]) <= F.greatest(a["y0"], a["y1"]))
        return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)

    def back(a, b):
        """Neighbours that run back on each other."""
        ux, uy, vx, vy = a["x1"] - a["x0"], a["y1"] - a["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]
        return (ux * vy - uy * vx == 0) & (ux * vx + uy * vy < 0)

    hits = lambda a: F.exists(numbered, lambda b: F.when(b["i"] == a["i"] + 1, back(a["s"], b["s"])).otherwise((b["i"] > a["i"] + 1) & meet(a["s"], b["s"])))
    ring = geom.start(p) == geom.end(p)
    return F.coalesce(ring | F.exists(numbered, hits), F.lit(False))


def sharp_turns(pts: str | Column, average: float = 135.0, previous: float = 100.0) -> Column:
    """Whether, of more than two vertices, a segment turns more than a limit from the whole line or from the one before;
    limits above 90 degrees count as 90."""
    p = F.col(pts) if isinstance(pts, str) else pts
    vector = lambda s: geom.unit_vector(F.struct(s["x0"].alias("x"), s["y0"].alias("y")), F.struct(s["x1"].alias("x"), s["y1"].alias("y")))
    whole = geom.unit_vector(geom.start(p), geom.end(p))
    vectors = F.transform(geom.segments(p), vector)
    bad_whole = F.exists(vectors, lambda v: ~geom.same_direction(whole, v, average))
    n = F.greatest(F.size(vectors) - 1, F.lit(0))
    bad_step = F.exists(F.arrays_zip(F.slice(vectors, 1, n).alias("u"), F.slice(vectors, F.lit(2), n).alias("v")), lambda t: ~geom.same_direction(t["u"], t["v"], previous))
    return F.coalesce((F.size(p) > 2) & (bad_whole | bad_step), F.lit(False))


def row_rules(t: Thresholds = Thresholds()) -> dict[str, Callable[[str], Column]]:  # noqa: B008
    return {"NULL GEOMETRY": is_null, "CUTS ITSELF": cuts_itself, "SHARP TURNS": lambda p: sharp_turns(p, t.sharp_average, t.sharp_previous)}


def with_row_errors(traces: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """traces with the errors of the row rules; works on streams."""
    found = [F.when(rule("pts"), F.lit(name)) for name, rule in row_rules(t).items()]
    return traces.withColumn("errors", F.when(is_null("pts"), F.array(F.lit("NULL GEOMETRY"))).otherwise(F.array_compact(F.array(*found))))


# Pair rules


def stacked(traces: DataFrame, cell: float, t: Thresholds) -> DataFrame:
    """(id): traces that run along another one: on it, or for overlap x snap within stacked_buffer x snap x multiplier of it;
    and traces that another cuts into more than three pieces, or into three with a short middle one.

    The second kind is tested on stretches of that length at nine places: where the other trace is straight beside a stretch its ends
    decide; one that bows out of the buffer and back between two of the places counts as running along.
    """
    on = joins.overlaps(traces, cell).groupBy("a_id", "b_id").agg(F.count_distinct("x", "y").alias("n")).where("n > 1")
    by_overlap = on.select(F.explode(F.array("a_id", "b_id")).alias("id"))

    step, reach = t.snap * t.overlap, t.snap * t.multiplier * t.stacked_buffer
    pieces = traces.where(geom.length("pts") >= step * (1 - 1e-9)).select(F.col("trace_id").alias("id"), "network", F.posexplode(geom.segmentize("pts", step)).alias("seg", "s"))
    pieces = pieces.select("id", "network", "seg", *[F.col(f"s.{c}").alias(c) for c in grid.SEGMENT])
    pieces = pieces.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= step * (1 - 1e-6))
    straight = F.size("pts") == 2
    b = [F.col(c) for c in ("b_x0", "b_y0", "b_x1", "b_y1")]
    places = [(F.col("a_x0") + (F.col("a_x1") - F.col("a_x0")) * (k / 8), F.col("a_y0") + (F.col("a_y1") - F.col("a_y0")) * (k / 8)) for k in range(9)]
    near = [geom.point_segment_distance(*at, *b) <= reach for at in places]
    pairs = lambda others: grid.box_pairs(pieces, grid.segments_of(others), max(cell, step), reach, ("network",)).where("a_id <> b_id")
    # a straight trace is one segment, which is near all places or isn't; only of others the segments are gathered
    lines = grid.segments_of(traces.where(straight)).drop("seg").withColumn("stretch", F.lit(False))
    both = lines.unionByName(pieces.drop("seg").withColumn("stretch", F.lit(True)))
    by_buffer = tiles.by_tile(both, max(2 * cell, 2 * step), reach, lambda a, _: tiles.run_along(a, reach), "id long").select("id")
    bent = traces.where(~straight)
    some = not bent.isEmpty()
    if some:
        gathered = pairs(bent).where(reduce(or_, near)).groupBy("a_id", "a_seg", "b_id").agg(*[F.max(c).alias(f"n{i}") for i, c in enumerate(near)])
        along = gathered.where(" and ".join(f"n{i}" for i in range(9)))
        by_buffer = by_buffer.unionByName(along.select(F.explode(F.array("a_id", "b_id")).alias("id")))

    if not some:  # straight traces cut each other once
        return by_overlap.unionByName(by_buffer).distinct()
    crossed = joins.crossings(traces, cell)
    sides = [crossed.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_seg").alias("seg"), F.col(f"{o}_id").alias("other"), "x", "y") for s, o in (("a", "b"), ("b", "a"))]
    both = sides[0].unionByName(sides[1])
    # places along the trace as lengths, without its own ends
    starts = traces.select(F.col("trace_id").alias("id"), F.posexplode(geom.segments("pts")).alias("seg", "s"), geom.length("pts").alias("whole"), "pts")
    before = F.aggregate(F.slice(geom.segments("pts"), 1, F.col("seg")), F.lit(0.0), lambda d, s: d + geom.segment_length(s))
    starts = starts.select("id", "seg", "whole", before.alias("before"), F.col("s.x0").alias("sx"), F.col("s.y0").alias("sy"))
    placed = both.join(starts, ["id", "seg"]).withColumn("at", F.col("before") + F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
    inner = placed.where((F.col("at") > 1e-12) & (F.col("at") < F.col("whole") - 1e-12))
    cuts = inner.groupBy("id", "other").agg(F.array_sort(F.collect_set(F.round("at", 12))).alias("p"))
    middle = F.element_at("p", 2) - F.element_at("p", 1)
    by_triangle = cuts.where((F.size("p") > 2) | ((F.size("p") == 2) & (middle > t.snap / t.triangle) & (middle < t.snap * t.triangle))).select("id")
    return by_overlap.unionByName(by_buffer).unionByName(by_triangle).distinct()


def errors(traces: DataFrame, areas: DataFrame | None, cell: float, t: Thresholds = Thresholds(), rules: Sequence[str] = ERRORS) -> DataFrame:  # noqa: B008
    """(trace_id, error) of all rules; traces have trace_id, network, pts and, where parts exist, ``parts``."""
    rows = with_row_errors(traces, t).select("trace_id", F.explode("errors").alias("error"))
    usable = traces.where(~is_null("pts"))
    named = lambda df, name: df.select(F.col("id").alias("trace_id"), F.lit(name).alias("error"))
    out = rows.where(F.col("error").isin(list(rules)))
    if "MULTI JUNCTION" in rules:
        out = out.unionByName(named(joins.multi_junctions(usable, cell, t.snap, t.multiplier), "MULTI JUNCTION"))
    if "V NODE" in rules:
        out = out.unionByName(named(joins.v_nodes(usable, cell, t.snap, t.multiplier), "V NODE"))
    if "MULTIPLE CROSSCUTS" in rules:
        out = out.unionByName(named(joins.multiple_crosscuts(usable, cell), "MULTIPLE CROSSCUTS"))
    if {"UNDERLAPPING SNAP", "OVERLAPPING SNAP"} & set(rules):
        out = out.unionByName(joins.snap_errors(usable, cell, t.snap, t.multiplier).select(F.col("id").alias("trace_id"), "error").where(F.col("error").isin(list(rules))))
    if areas is not None and "TRACE UNDERLAPS TARGET AREA" in rules:
        out = out.unionByName(named(joins.target_area_underlaps(usable, areas, cell, t.snap, t.multiplier, t.area_multiplier), "TRACE UNDERLAPS TARGET AREA"))
    if "STACKED TRACES" in rules:
        out = out.unionByName(named(stacked(usable, cell, t), "STACKED TRACES"))
    return out.distinct()


def fixed(traces: DataFrame) -> DataFrame:
    """Traces with a column parts (array of lines): parts that join end to start become one line in pts; others have null
    pts and the type error."""
    return overlay.merge_parts(traces).withColumn("__multi", F.col("pts").isNull() & (F.size("parts") > 1))


def validated(traces: DataFrame, areas: DataFrame | None, cell: float | None = None, t: Thresholds = Thresholds(), rules: Sequence[str] = ERRORS, fix: bool = True) -> DataFrame:  # noqa: B008
    """traces with the ordered list ``errors``. The first pass fixes many-part lines, the second checks everything."""
    multi = None
    if "parts" in traces.columns:
        traces = fixed(traces) if fix else overlay.merge_parts(traces.withColumn("__many", F.size("parts") > 1)).withColumn("__multi", F.col("__many")).drop("__many")
        # the parts are joined once for all rules
        traces = cut(traces.withColumn("pts", F.when(~F.col("__multi"), F.col("pts"))))
        multi = traces.where("__multi").select("trace_id", F.lit("GEOM TYPE MULTILINESTRING").alias("error"))
    cell = cell or grid.median_length(grid.segments_of(traces))
    found = errors(traces, areas, cell, t, rules)
    if multi is not None:
        found = found.join(multi.select("trace_id"), "trace_id", "left_anti").unionByName(multi)
        traces = traces.drop("__multi")
    order = F.array_position(F.array(*map(F.lit, ERRORS)), F.col("error"))
    lists = found.groupBy("trace_id").agg(F.array_sort(F.collect_set(F.struct(order.alias("o"), "error"))).alias("e"))
    out = traces.drop("errors").join(lists.select("trace_id", F.transform("e", lambda x: x["error"]).alias("errors")), "trace_id", "left")
    return out.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def summary(checked: DataFrame) -> DataFrame:
    """(error, n) over all traces."""
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
