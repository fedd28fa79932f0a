"""Contour grids and random circular samples.

Random draws are hashes of (seed, network, sample), so that a lost task draws the same again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.functions.lineage import cut
from riftspark.operators import grid, params, tiles


def total_bounds(traces: DataFrame, by: str = "network") -> DataFrame:
    b = geom.bounds("pts")
    return traces.groupBy(by).agg(F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"), F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y"))


def cells(bounds: DataFrame, width: float | None = None, divider: int = 20) -> DataFrame:
    """(network, cell_id, x0, y0, x1, y1): squares over bounds, column by column from the top left. Without a width, the
    longer side has ``divider`` cells."""
    side = F.lit(float(width)) if width else F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / divider
    out = bounds.withColumn("w", side).withColumn("rows", F.ceil((F.col("max_y") - F.col("min_y")) / F.col("w")).cast("int")).withColumn("cols", F.ceil((F.col("max_x") - F.col("min_x")) / F.col("w")).cast("int"))
    out = out.where("rows > 0 and cols > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    x, y = F.col("min_x") + F.col("c") * F.col("w"), F.col("max_y") - F.col("r") * F.col("w")
    return out.select("network", (F.col("c") * F.col("rows") + F.col("r")).cast("long").alias("cell_id"), x.alias("x0"), (y - F.col("w")).alias("y0"), (x + F.col("w")).alias("x1"), y.alias("y1"))


def circles_of(sampled: DataFrame, factor: float = 1.5) -> DataFrame:
    """(network, id, x, y, r): the sample circle of each cell, about its centre, factor times its side."""
    return sampled.select("network", F.col("cell_id").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), ((F.col("x1") - F.col("x0")) * factor).alias("r"))


def length_in_circle(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, r: Column) -> Column:
    """The length of a segment inside a circle: between the roots of |p + t d - c|² = r², held between 0 and 1."""
    dx, dy, fx, fy = x1 - x0, y1 - y0, x0 - cx, y0 - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    hold = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.when((disc > 0) & (a > 0), (hold((-b + root) / (2 * a)) - hold((-b - root) / (2 * a))) * F.sqrt(a)).otherwise(0.0)


def _circle_boxes(circles: DataFrame) -> DataFrame:
    """Circles as the diagonals of their boxes, for the cell join."""
    r, x, y = F.col("r"), F.col("x"), F.col("y")
    return circles.withColumns({"x0": x - r, "y0": y - r, "x1": x + r, "y1": y + r})


def lengths_in_circles(lines: DataFrame, circles: DataFrame, cell: float) -> DataFrame:
    """(network, id, line, length): the length of each line inside each circle that it enters. Only lines of several segments are
    summed, so that straight ones aren't shuffled once for each circle."""
    inside = length_in_circle(*(F.col(c) for c in ("a_x0", "a_y0", "a_x1", "a_y1", "b_x", "b_y", "b_r")))

    def parts(of: DataFrame) -> DataFrame:
        pairs = grid.box_pairs(grid.segments_of(of), _circle_boxes(circles), cell, 0.0, ("network",)).withColumn("__in", inside).where("__in > 0")
        return pairs.select(F.col("b_network").alias("network"), F.col("b_id").alias("id"), F.col("a_id").alias("line"), F.col("__in").alias("length"))

    straight = grid.segments_of(lines.where(F.size("pts") == 2))
    longest = straight.agg(F.max(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0] or 0.0
    out = tiles.lengths_in_circles(straight, circles, max(cell, longest), longest)
    bent = lines.where(F.size("pts") > 2)
    if bent.isEmpty():
        return out
    return out.unionByName(parts(bent).groupBy("network", "id", "line").agg(F.sum("length").alias("length")))


def nodes_in_circles(nodes: DataFrame, circles: DataFrame, cell: float) -> DataFrame:
    """(network, id, class) for each node in each circle."""
    at = grid.as_segments(nodes.select(F.lit(0).alias("id"), "network", "x", "y", "class"))
    pairs = grid.box_pairs(at, _circle_boxes(circles), cell, 0.0, ("network",))
    inside = pairs.where(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2) <= F.col("b_r") * F.col("b_r"))
    return inside.select(F.col("b_network").alias("network"), F.col("b_id").alias("id"), F.col("a_class").alias("class"))


def parameters_in_circles(traces: DataFrame, circles: DataFrame, cell: float, nodes: DataFrame | None = None, branches: DataFrame | None = None, corners: int | None = 64) -> DataFrame:
    """(network, id, parameters) of each circle: lines are clipped to it, nodes counted in it. corners: the area is that of
    a polygon with so many corners; None: of the circle."""
    by = ["network", "id"]
    unit = corners / 2 * math.sin(2 * math.pi / corners) if corners else math.pi
    areas = circles.select(*by, (F.col("r") * F.col("r") * unit).alias("area"))
    clipped = lengths_in_circles(traces, circles, cell)
    found_nodes = nodes_in_circles(nodes, circles, cell) if nodes is not None else None
    found_branches = None
    if branches is not None:
        keyed = branches.select(F.xxhash64("trace_id", "piece").alias("trace_id"), "network", "pts")
        found_branches = lengths_in_circles(keyed, circles, cell)
    return params.topology_parameters(clipped, areas, found_nodes, found_branches, by=by)


def contour_grid(traces: DataFrame, width: float | None = None, nodes: DataFrame | None = None, branches: DataFrame | None = None, precursor: DataFrame | None = None) -> DataFrame:
    """Cells with the parameters of the circle about each. Empty cells have zeros."""
    at = precursor if precursor is not None else cells(total_bounds(traces), width)
    side = at.agg(F.max(F.col("x1") - F.col("x0"))).first()[0] or 1.0
    found = parameters_in_circles(traces, circles_of(at), 2 * float(side), nodes, branches)
    return at.join(found.withColumnRenamed("id", "cell_id"), ["network", "cell_id"], "left")


# Random samples


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the columns only."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def random_circles(areas: DataFrame, samples: int, least_radius: float, by_area: bool = False, seed: int = 0) -> DataFrame:
    """(network, id, x, y, r): random circles inside circular areas (network, x, y, r). Radii, or areas, are uniform from the
    least to the area's own; centres are uniform where the circle stays inside. An area of a lesser radius is an error."""
    if samples < 1 or not 0 < least_radius < math.inf:
        raise ValueError("samples and the least radius must be above 0")
    own = F.when(F.col("r") >= least_radius, F.col("r")).otherwise(F.raise_error(F.lit("an area is smaller than the least radius")).cast("double"))
    rows = areas.withColumn("r", own).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    u, v, w = (uniform(seed + k, "network", "id") for k in range(3))
    low = F.lit(float(least_radius))
    radius = F.sqrt(low * low + u * (F.col("r") * F.col("r") - low * low)) if by_area else low + u * (F.col("r") - low)
    out = rows.withColumn("__r", radius)
    away, turn = (F.col("r") - F.col("__r")) * F.sqrt(v), 2 * F.pi() * w
    return out.select("network", "id", (F.col("x") + away * F.cos(turn)).alias("x"), (F.col("y") + away * F.sin(turn)).alias("y"), F.col("__r").alias("r"))


def random_points(boxes: DataFrame, n: int, seed: int = 0, tries: int = 64, rounds: int = 12) -> DataFrame:
    """(network, id, x, y): n points in polygons (network, rings), each the first of its draws in the box that lies inside.

    Points that have none after ``tries`` draws get four times as many in the next round. A polygon without area is an
    error, and so is one that fills so little of its box that some point is missing after the last round.
    """
    none = boxes.where(geom.polygon_area("rings") <= 0).select("network").limit(1).collect()
    if none:
        raise ValueError(f"the polygon of network {none[0][0]!r} has no area")
    b = geom.bounds(F.flatten("rings"))
    left = boxes.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("__b", b)
    found, first = None, 0
    for _ in range(rounds):
        rows = left.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))))
        x = F.col("__b.min_x") + uniform(seed, "network", "id", "k") * (F.col("__b.max_x") - F.col("__b.min_x"))
        y = F.col("__b.min_y") + uniform(seed + 1, "network", "id", "k") * (F.col("__b.max_y") - F.col("__b.min_y"))
        inside = rows.withColumns({"x": x, "y": y}).where(geom.point_in_rings(F.col("x"), F.col("y"), "rings"))
        got = cut(inside.groupBy("network", "id").agg(F.min_by(F.struct("x", "y"), "k").alias("p")).select("network", "id", "p.x", "p.y"))
        found = got if found is None else found.unionByName(got)
        left = cut(left.join(got, ["network", "id"], "left_anti"))
        if left.isEmpty():
            return found
        first, tries = first + tries, 4 * tries
    raise ValueError(f"a polygon fills too little of its box: points are missing after {first} draws each")


def subsample(traces: DataFrame, areas: DataFrame, samples: int, least_radius: float, nodes: DataFrame | None = None, branches: DataFrame | None = None, by_area: bool = False, seed: int = 0) -> DataFrame:
    """Parameters of random circles in each network's circular area: all samples are one join."""
    circles = random_circles(areas, samples, least_radius, by_area, seed)
    return parameters_in_circles(traces, circles, 2 * least_radius, nodes, branches).join(circles.select("network", "id", "x", "y", "r"), ["network", "id"])


def sample_networks(traces: DataFrame, circles: DataFrame, cell: float, corners: int = 64) -> tuple[DataFrame, DataFrame]:
    """Traces and areas in which each circle (network, id, x, y, r) is a network of its own, named network/id: the traces
    (trace_id, network, pts, of) whose boxes meet the circle's, unclipped, with new ids, of being their ids before; the
    areas are polygons of so many corners."""
    name = lambda n, i: F.concat_ws("/", n, F.col(i).cast("string"))
    near = grid.box_pairs(grid.segments_of(traces), _circle_boxes(circles), cell, 0.0, ("network",))
    near = near.select(F.col("a_id").alias("of"), name("b_network", "b_id").alias("network")).distinct()
    found = near.join(traces.select(F.col("trace_id").alias("of"), "pts"), "of")
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: geom.point(F.col("x") + F.col("r") * F.cos(2 * F.pi() * (k % corners) / corners), F.col("y") + F.col("r") * F.sin(2 * F.pi() * (k % corners) / corners)))
    areas = circles.select(F.col("id").alias("area_id"), name("network", "id").alias("network"), F.array(ring).alias("rings"))
    # the numbers stay as they are once they are stored
    return cut(found.select(F.monotonically_increasing_id().alias("trace_id"), "network", "pts", "of")), areas


def one_of_each(rows: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """A random row of each group."""
    order = Window.partitionBy(*by).orderBy(uniform(seed, *[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def weighted_choice(rows: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, with chances in proportion to a weight: those of least -ln(u) / weight."""
    return rows.where(F.col(weight) > 0).orderBy(-F.log(F.greatest(uniform(seed, F.col(key).cast("string")), F.lit(1e-300))) / F.col(weight), key).limit(k)


def sample_of_circles(samples: DataFrame, least: int, most: int, by: str = "network", seed: int = 0) -> DataFrame:
    """A random sample of each of some groups; how many groups is random from least to most, and a group's chance is in
    proportion to the total area of its samples."""
    n = samples.sparkSession.range(1).select((F.lit(least) + F.floor(uniform(seed) * (most - least + 1))).cast("int").alias("n")).first()[0]
    weights = samples.groupBy(by).agg(F.sum("Area").alias("__w"))
    chosen = weighted_choice(weights, by, "__w", n, seed).select(by)
    return one_of_each(samples.join(chosen, by), [by], seed)


# Outlines


def bounding_polygons(traces: DataFrame, factor: float = 2.0) -> DataFrame:
    """(network, rings): the traces' box, widened about its centre by the factor; sides of no length are widened by 1."""
    b = total_bounds(traces)
    half = lambda a, c: F.greatest((F.col(c) - F.col(a)) / 2 * factor, F.lit(1.0))
    mid = lambda a, c: (F.col(a) + F.col(c)) / 2
    x0, x1 = mid("min_x", "max_x") - half("min_x", "max_x"), mid("min_x", "max_x") + half("min_x", "max_x")
    y0, y1 = mid("min_y", "max_y") - half("min_y", "max_y"), mid("min_y", "max_y") + half("min_y", "max_y")
    ring = F.array(*[geom.point(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return b.select("network", F.array(ring).alias("rings"))


def representative_points(areas: DataFrame) -> DataFrame:
    """(area_id, network, x, y): a point inside each polygon, the middle of its widest stretch on the line halfway up."""
    b = geom.bounds(F.flatten("rings"))
    # halfway between the two middle heights of corners, so that the line meets no corner
    ys = F.array_sort(F.array_distinct(F.transform(F.flatten("rings"), lambda p: p["y"])))
    k = F.greatest(F.floor(F.size(ys) / 2).cast("int"), F.lit(1))
    y = (F.element_at(ys, k) + F.coalesce(F.try_element_at(ys, k + 1), F.element_at(ys, k))) / 2
    rows = areas.withColumn("__y", y).withColumn("__s", geom.boundary_segments("rings")).withColumn("__b", b)
    hit = F.filter("__s", lambda s: (s["y0"] > F.col("__y")) != (s["y1"] > F.col("__y")))
    xs = F.array_sort(F.transform(hit, lambda s: s["x0"] + (F.col("__y") - s["y0"]) * (s["x1"] - s["x0"]) / (s["y1"] - s["y0"])))
    rows = rows.withColumn("__x", xs)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__x") - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.element_at("__x", i + 1) - F.element_at("__x", i)).alias("w"), ((F.element_at("__x", i + 1) + F.element_at("__x", i)) / 2).alias("x")))
    widest = F.when(F.size("__x") > 1, F.array_max(pairs)["x"])
    return rows.select("area_id", "network", F.coalesce(widest, F.col("__b.min_x")).alias("x"), F.col("__y").alias("y"))
