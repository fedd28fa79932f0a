"""Column expressions on line geometry.

A line is ``array<struct<x: double, y: double>>``; a polygon is a list of rings of the same kind, the first ring of each
closed path first. Everything here is a built-in expression, so that Spark keeps it in generated code or evaluates it
in the JVM; nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"
LINE = f"array<{POINT}>"
RINGS = f"array<{LINE}>"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Points and vertices


def point(x: Column | float, y: Column | float) -> Column:
    to = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(to(x).alias("x"), to(y).alias("y"))


def segment_line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line of two points."""
    return F.array(point(x0, y0), point(x1, y1))


def start(pts: str | Column) -> Column:
    return F.get(_c(pts), 0)


def end(pts: str | Column) -> Column:
    return F.get(_c(pts), F.size(_c(pts)) - 1)


def endpoints(pts: str | Column) -> Column:
    """First and last vertex."""
    return F.struct(start(pts).alias("first"), end(pts).alias("last"))


def next_vertex(pts: str | Column, p: Column) -> Column:
    """The neighbour of the end p toward the middle; null if p is no end."""
    n = F.size(_c(pts))
    return F.when(start(pts) == p, F.try_element_at(_c(pts), F.lit(2))).when(end(pts) == p, F.try_element_at(_c(pts), n - 1))


def replace_vertex(pts: str | Column, index: Column | int, p: Column) -> Column:
    """The line with the vertex at a zero-based index replaced."""
    at = index if isinstance(index, Column) else F.lit(index)
    return F.transform(_c(pts), lambda v, i: F.when(i == at, p).otherwise(v))


def drop_z(pts: str | Column) -> Column:
    """Vertices with x and y only."""
    return F.transform(_c(pts), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def has_z(pts: str | Column) -> Column:
    """Whether any vertex of a line with z has a value there."""
    return F.exists(_c(pts), lambda p: p["z"].isNotNull())


def segments(pts: str | Column) -> Column:
    """array<struct<x0, y0, x1, y1>> of consecutive vertices; empty for fewer than two."""
    p = _c(pts)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(p, 1, n).alias("a"), F.slice(p, F.lit(2), n).alias("b")),
        lambda s: F.struct(s["a"]["x"].alias("x0"), s["a"]["y"].alias("y0"), s["b"]["x"].alias("x1"), s["b"]["y"].alias("y1")),
    )


# Measures


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def segment_length(s: Column) -> Column:
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    return F.sqrt(dx * dx + dy * dy)


def length(pts: str | Column) -> Column:
    return F.aggregate(segments(pts), F.lit(0.0), lambda t, s: t + segment_length(s))


def bounds(pts: str | Column) -> Column:
    """struct<min_x, min_y, max_x, max_y>."""
    xs, ys = F.transform(_c(pts), lambda p: p["x"]), F.transform(_c(pts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def extend_bounds(b: Column, by: Column | float) -> Column:
    return F.struct((b["min_x"] - by).alias("min_x"), (b["min_y"] - by).alias("min_y"), (b["max_x"] + by).alias("max_x"), (b["max_y"] + by).alias("max_y"))


def within_bounds(x: Column, y: Column, b: Column) -> Column:
    """Inclusive at all sides."""
    return x.between(b["min_x"], b["max_x"]) & y.between(b["min_y"], b["max_y"])


def azimuth_of(dx: Column, dy: Column, halved: bool = True) -> Column:
    """Degrees clockwise from north, 0 to 360, or 0 to 180 where the direction doesn't matter."""
    a = F.lit(90.0) - F.degrees(F.atan2(dy, dx))
    a = F.when(a < 0, a + 360.0).otherwise(a)
    return half_azimuth(a) if halved else a


def azimuth(pts: str | Column, halved: bool = True) -> Column:
    """From the first to the last vertex."""
    a, b = start(pts), end(pts)
    return azimuth_of(b["x"] - a["x"], b["y"] - a["y"], halved)


def half_azimuth(degrees: Column) -> Column:
    return F.when(degrees >= 180, degrees - 180.0).otherwise(degrees)


def regression_azimuth(pts: str | Column) -> Column:
    """Of the least-squares line through all vertices; 0 where its slope is about 0, as of lines from east to west."""
    p = _c(pts)
    n = F.size(p).cast("double")
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda t, v: t + v[k]) / n
    mx, my = mean("x"), mean("y")
    sxx = F.aggregate(p, F.lit(0.0), lambda t, v: t + (v["x"] - mx) * (v["x"] - mx))
    sxy = F.aggregate(p, F.lit(0.0), lambda t, v: t + (v["x"] - mx) * (v["y"] - my))
    slope = F.try_divide(sxy, sxx)
    a = F.degrees(F.atan(F.try_divide(F.lit(1.0), slope)))
    return F.when(slope.isNull() | (F.abs(slope) < 1e-8), 0.0).otherwise(F.when(a < 0, a + 180.0).otherwise(a))


def strike(dip_direction: Column) -> Column:
    return F.pmod(dip_direction - 90.0, F.lit(360.0))


def azimuths_close(first: Column, second: Column, tolerance: float, halved: bool = True) -> Column:
    """Whether two directions differ by less, on a circle of 180 or 360 degrees."""
    turn = 180.0 if halved else 360.0
    d = F.abs(first - second)
    return F.least(d, turn - d) < tolerance


def unit_vector(a: Column, b: Column) -> Column:
    """struct<x, y> from a to b; NaN where they are (almost) the same point."""
    d = distance(a, b)
    nan = F.lit(float("nan"))
    return F.struct(F.when(d > 1e-15, (b["x"] - a["x"]) / d).otherwise(nan).alias("x"), F.when(d > 1e-15, (b["y"] - a["y"]) / d).otherwise(nan).alias("y"))


def azimuth_vector(degrees: Column) -> Column:
    r = F.radians(degrees)
    return F.struct(F.sin(r).alias("x"), F.cos(r).alias("y"))


def angle_between(u: Column, v: Column) -> Column:
    """Degrees between unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u["x"] * v["x"] + u["y"] * v["y"]))))


def same_direction(u: Column, v: Column, limit: float) -> Column:
    """Whether unit vectors differ by at most the limit; over 90 degrees never."""
    return F.coalesce(angle_between(u, v) <= min(90.0, limit), F.lit(False)) & ~F.isnan(u["x"]) & ~F.isnan(v["x"])


def angle_at(p: Column, corner: Column, q: Column) -> Column:
    """Degrees at the corner between p and q; null where either coincides with it."""
    a = angle_between(unit_vector(corner, p), unit_vector(corner, q))
    return F.when((distance(p, corner) > 1e-15) & (distance(q, corner) > 1e-15), a)


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


def circle_radius(area: Column) -> Column:
    return F.sqrt(area / F.pi())


def circle_polygon(x: Column, y: Column, radius: Column, corners: int = 64) -> Column:
    """A circle as one ring of so many corners; of 64 it has area 3.137 at radius 1."""
    step = 2 * 3.141592653589793 / corners
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((x + radius * F.cos(-step * (i % corners))).alias("x"), (y + radius * F.sin(-step * (i % corners))).alias("y")))
    return F.array(ring)


# Linear reference


def interpolate(pts: str | Column, along: Column) -> Column:
    """The point so far along the line, held between its ends."""
    total = F.aggregate(
        segments(pts),
        F.struct(F.lit(0.0).alias("done"), F.lit(None).cast(POINT).alias("p")),
        lambda t, s: F.struct(
            (t["done"] + segment_length(s)).alias("done"),
            F.when(
                t["p"].isNull() & (along <= t["done"] + segment_length(s)),
                F.struct(
                    (s["x0"] + (s["x1"] - s["x0"]) * F.coalesce(F.try_divide(F.greatest(along - t["done"], F.lit(0.0)), segment_length(s)), F.lit(0.0))).alias("x"),
                    (s["y0"] + (s["y1"] - s["y0"]) * F.coalesce(F.try_divide(F.greatest(along - t["done"], F.lit(0.0)), segment_length(s)), F.lit(0.0))).alias("y"),
                ),
            ).otherwise(t["p"]).alias("p"),
        ),
    )
    return F.coalesce(total["p"], end(pts))


def segmentize(pts: str | Column, step: float) -> Column:
    """Pieces (x0, y0, x1, y1) of that length along the line, the last held at its end."""
    n = F.greatest(F.ceil(length(pts) / step).cast("int"), F.lit(1))

    def piece(i: Column) -> Column:
        a, b = interpolate(pts, i * F.lit(step)), interpolate(pts, (i + 1) * F.lit(step))
        return F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


# Distances and intersections


def ratio(a: Column, b: Column) -> Column:
    """a / b, and a where b is 0: never null, never an error."""
    return a / F.when(b != 0, b).otherwise(1.0)


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    t = ratio((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_line_distance(p: Column, pts: str | Column) -> Column:
    return F.array_min(F.transform(segments(pts), lambda s: point_segment_distance(p["x"], p["y"], s["x0"], s["y0"], s["x1"], s["y1"])))


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _ends(s: str) -> tuple[Column, Column, Column, Column]:
    return F.col(f"{s}x0"), F.col(f"{s}y0"), F.col(f"{s}x1"), F.col(f"{s}y1")


def bbox_overlap(a: str, b: str, grow: float = 0.0) -> Column:
    """Whether the boxes of two segments, columns prefixed a and b, come as near as ``grow``."""
    ax0, ay0, ax1, ay1 = _ends(a)
    bx0, by0, bx1, by1 = _ends(b)
    x = (F.least(ax0, ax1) <= F.greatest(bx0, bx1) + grow) & (F.least(bx0, bx1) <= F.greatest(ax0, ax1) + grow)
    return x & (F.least(ay0, ay1) <= F.greatest(by0, by1) + grow) & (F.least(by0, by1) <= F.greatest(ay0, ay1) + grow)


def segments_intersect(a: str, b: str) -> Column:
    """Whether two segments meet. The boxes must overlap too: cross products alone count separate collinear ones."""
    ax0, ay0, ax1, ay1 = _ends(a)
    bx0, by0, bx1, by1 = _ends(b)
    d1, d2 = cross(ax0, ay0, ax1, ay1, bx0, by0), cross(ax0, ay0, ax1, ay1, bx1, by1)
    d3, d4 = cross(bx0, by0, bx1, by1, ax0, ay0), cross(bx0, by0, bx1, by1, ax1, ay1)
    return (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0) & bbox_overlap(a, b)


def parallel(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = _ends(a)
    bx0, by0, bx1, by1 = _ends(b)
    return ((ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0)) == 0


def crossing_point(a: str, b: str) -> Column:
    """Where two segments that meet and aren't parallel do; an end that lies there is returned exactly."""
    ax0, ay0, ax1, ay1 = _ends(a)
    bx0, by0, bx1, by1 = _ends(b)
    den = (ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0)
    t = ratio((bx0 - ax0) * (by1 - by0) - (by0 - ay0) * (bx1 - bx0), den)
    on_a = lambda x, y: cross(ax0, ay0, ax1, ay1, x, y) == 0
    on_b = lambda x, y: cross(bx0, by0, bx1, by1, x, y) == 0
    # coordinate by coordinate: a CASE of structs isn't compiled
    hits = [(on_b(ax0, ay0), ax0, ay0), (on_b(ax1, ay1), ax1, ay1), (on_a(bx0, by0), bx0, by0), (on_a(bx1, by1), bx1, by1)]
    x, y = ax0 + t * (ax1 - ax0), ay0 + t * (ay1 - ay0)
    for hit, hx, hy in reversed(hits):
        x, y = F.when(hit, hx).otherwise(x), F.when(hit, hy).otherwise(y)
    return F.struct(x.alias("x"), y.alias("y"))


def segment_distance(a: str, b: str) -> Column:
    """Least distance of two segments: 0 where they meet, else from an end to the other."""
    ax0, ay0, ax1, ay1 = _ends(a)
    bx0, by0, bx1, by1 = _ends(b)
    apart = F.least(
        point_segment_distance(ax0, ay0, bx0, by0, bx1, by1), point_segment_distance(ax1, ay1, bx0, by0, bx1, by1),
        point_segment_distance(bx0, by0, ax0, ay0, ax1, ay1), point_segment_distance(bx1, by1, ax0, ay0, ax1, ay1),
    )
    return F.when(segments_intersect(a, b), 0.0).otherwise(apart)


# Polygons


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula, about the ring's first corner."""
    ox, oy = F.try_element_at(ring, F.lit(1))["x"], F.try_element_at(ring, F.lit(1))["y"]
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + ((s["x0"] - ox) * (s["y1"] - oy) - (s["x1"] - ox) * (s["y0"] - oy))) / 2.0


def polygon_area(rings: str | Column) -> Column:
    """First ring less the holes."""
    areas = F.transform(_c(rings), lambda r: F.abs(ring_area(r)))
    return F.coalesce(F.try_element_at(areas, F.lit(1)) * 2 - F.aggregate(areas, F.lit(0.0), lambda t, a: t + a), F.lit(0.0))


def ring_centroid(ring: Column) -> Column:
    o = F.try_element_at(ring, F.lit(1))
    w = lambda s: (s["x0"] - o["x"]) * (s["y1"] - o["y"]) - (s["x1"] - o["x"]) * (s["y0"] - o["y"])
    sx = F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s["x0"] + s["x1"] - 2 * o["x"]) * w(s))
    sy = F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s["y0"] + s["y1"] - 2 * o["y"]) * w(s))
    six = 6.0 * ring_area(ring)
    return F.struct((o["x"] + sx / six).alias("x"), (o["y"] + sy / six).alias("y"))


def point_in_rings(px: Column, py: Column, rings: str | Column) -> Column:
    """Even-odd rule over all rings; points on a side may fall either way."""

    def hits(ring: Column) -> Column:
        def one(t: Column, s: Column) -> Column:
            spans = (s["y0"] > py) != (s["y1"] > py)
            x = s["x0"] + F.try_divide((py - s["y0"]) * (s["x1"] - s["x0"]), s["y1"] - s["y0"])
            return t + F.when(spans & (px < x), 1).otherwise(0)

        return F.aggregate(segments(ring), F.lit(0), one)

    return F.aggregate(_c(rings), F.lit(0), lambda t, r: t + hits(r)) % 2 == 1


def boundary_segments(rings: str | Column) -> Column:
    return F.flatten(F.transform(_c(rings), segments))


def boundary_distance(px: Column, py: Column, rings: str | Column) -> Column:
    return F.array_min(F.transform(boundary_segments(rings), lambda s: point_segment_distance(px, py, s["x0"], s["y0"], s["x1"], s["y1"])))


def box_rings(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    corners = [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y)]
    return F.array(F.array(*[point(x, y) for x, y in corners]))


# Sets and classes


def in_range(value: Column, low: float, high: float, around: bool = False) -> Column:
    """Inclusive at both ends. A range that runs around the circle has its low end above its high end."""
    return ((value >= low) | (value <= high)) if around and low > high else value.between(low, high)


def set_of(value: Column, ranges: Sequence[tuple[float, float]], names: Sequence[str], around: bool = False, none: str = "-1", strict: bool = False) -> Column:
    """The name of the range that holds the value. Where two do, on a shared edge, the first counts; strict raises."""
    fits = [in_range(value, low, high, around) for low, high in ranges]
    out = F.lit(none)
    for fit, name in reversed(list(zip(fits, names, strict=True))):
        out = F.when(fit, F.lit(name)).otherwise(out)
    if strict:
        many = sum((F.coalesce(f, F.lit(False)).cast("int") for f in fits), F.lit(0)) > 1
        out = F.when(many, F.raise_error(F.lit("the value lies in more than one range"))).otherwise(out)
    return out


def last_set_of(value: Column, ranges: Sequence[tuple[float, float]], names: Sequence[str], none: str = "-1") -> Column:
    """The same, but the last fitting range counts."""
    return set_of(value, list(ranges)[::-1], list(names)[::-1], none=none)


def boundary_weight(count: Column) -> Column:
    """1, 2 and 0 for 0, 1 and 2 crossings of the boundary; anything else is an error."""
    return F.when(count == 0, 1).when(count == 1, 2).when(count == 2, 0).otherwise(F.raise_error(F.lit("a line crosses the boundary 0, 1 or 2 times")).cast("int"))


def plain_name(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), "[^a-zA-Z0-9_]", "")


def class_colour(c: str | Column) -> Column:
    return F.when(_c(c).isin("C-C", "X"), "green").when(_c(c).isin("C-I", "Y"), "blue").when(_c(c).isin("I-I", "I"), "black").otherwise("red")
