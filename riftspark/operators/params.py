"""Aggregates of networks: counts, topology parameters, sets, roses, anisotropy, ternary points, relations.

All are one group-by on the network (and a set, bin or cell), which Spark aggregates partially before it shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.operators import joins

NODE_CLASSES = ("X", "Y", "I", "E")
BRANCH_CLASSES = ("C-C", "C-I", "I-I", "C-E", "I-E", "E-E")


class Parameter(NamedTuple):
    """A network parameter: unit, whether it is shown on a log axis, how samples are put together, and if it needs nodes."""

    name: str
    unit: str = "-"
    log: bool = False
    how: str = "mean"
    topology: bool = True


#: The parameters' names, as in published descriptions of fracture networks (fixed values).
PARAMETERS = (
    Parameter("Number of Traces", how="sum"),
    Parameter("Number of Branches", how="sum"),
    Parameter("Number of Traces (Real)", how="sum", topology=False),
    Parameter("Number of Branches (Real)", how="sum"),
    Parameter("Trace Min Length", "m", True, topology=False),
    Parameter("Trace Max Length", "m", True, topology=False),
    Parameter("Trace Mean Length", "m", True, topology=False),
    Parameter("Branch Min Length", "m", True),
    Parameter("Branch Max Length", "m", True),
    Parameter("Branch Mean Length", "m", True),
    Parameter("Areal Frequency P20", "1/m^2", True),
    Parameter("Areal Frequency B20", "1/m^2", True),
    Parameter("Fracture Intensity P21", "m/m^2", True, topology=False),
    Parameter("Fracture Intensity B21", "m/m^2", True, topology=False),
    Parameter("Dimensionless Intensity P22", topology=False),
    Parameter("Dimensionless Intensity B22"),
    Parameter("Connections per Trace"),
    Parameter("Connections per Branch"),
    Parameter("Connection Frequency", "1/m^2", True),
    Parameter("Trace Mean Length (Mauldon)", "m", True),
    Parameter("Fracture Density (Mauldon)", "1/m^2", True),
    Parameter("Fracture Intensity (Mauldon)", "m/m^2", True),
    Parameter("Area", "m^2", how="sum", topology=False),
    Parameter("Censoring", "m^2", topology=False),
)


def _nan() -> Column:
    return F.lit(float("nan"))


def node_counts(nodes: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """Columns X, Y, I, E."""
    return nodes.groupBy(*by).agg(*[F.count(F.when(F.col("class") == c, 1)).alias(c) for c in NODE_CLASSES])


def branch_counts(branches: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """Columns of the six classes; Error counts nowhere."""
    return branches.groupBy(*by).agg(*[F.count(F.when(F.col("connection") == c, 1)).alias(c) for c in BRANCH_CLASSES])


def branch_boundary_crossings(connection: Column) -> Column:
    """How often a branch meets the boundary: two for E-E, one for other classes that aren't inside, Error among them."""
    return F.when(connection.isin("C-C", "C-I", "I-I"), 0).when(connection == "E-E", 2).otherwise(1)


def crossing_counts(lines: DataFrame, label: str, by: Sequence[str] = ("network",), column: str = "crossings") -> DataFrame:
    """How many lines meet the boundary 0, 1 and 2 times, in columns named after the label."""
    return lines.groupBy(*by).agg(*[F.count(F.when(F.col(column) == n, 1)).alias(f"{label} Boundary {n} Intersect Count") for n in range(3)])


def lengths_summary(lines: DataFrame, prefix: str, by: Sequence[str] = ("network",)) -> DataFrame:
    """n, total, least, greatest and mean of a column length, prefixed."""
    of = F.col("length")
    return lines.groupBy(*by).agg(*[c.alias(f"{prefix}_{n}") for n, c in (("n", F.count(of)), ("sum", F.sum(of)), ("min", F.min(of)), ("max", F.max(of)), ("mean", F.avg(of)))])


def topology_parameters(traces: DataFrame, areas: DataFrame, nodes: DataFrame | None = None, branches: DataFrame | None = None, circular: bool = False, by: Sequence[str] = ("network",)) -> DataFrame:
    """One row for each group with the parameters above. traces and branches have a column length, areas a column area.

    Without nodes and branches, what needs them is NaN. The Mauldon estimates need a circular area.
    """
    by = list(by)
    out = areas.groupBy(*by).agg(F.sum("area").alias("a")).join(lengths_summary(traces, "t", by), by, "left")
    topology = nodes is not None and branches is not None
    if topology:
        out = out.join(node_counts(nodes, by), by, "left").join(lengths_summary(branches, "b", by), by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    a, n, total, mean = F.col("a"), zero("t_n"), zero("t_sum"), zero("t_mean")
    p21 = total / a
    values: dict[str, Column] = {
        "Area": a, "Number of Traces (Real)": n, "Trace Min Length": zero("t_min"), "Trace Max Length": zero("t_max"), "Trace Mean Length": mean,
        "Fracture Intensity P21": p21, "Fracture Intensity B21": p21, "Dimensionless Intensity P22": p21 * mean,
    }
    if topology:
        x, y, i, e = (zero(c) for c in NODE_CLASSES)
        traces_n, branches_n = (y + i) / 2, (4 * x + 3 * y + i) / 2
        some = lambda v, d: F.when(d > 0, v / F.when(d > 0, d)).otherwise(0.0)
        b_mean = some(total, branches_n)
        mauldon = F.when(i + y > 0, F.pi() * geom.circle_radius(a) / 2 * some(e, i + y)).otherwise(0.0) if circular else _nan()
        density = (i + y) / (2 * a) if circular else _nan()
        values |= {
            "Number of Traces": traces_n, "Number of Branches": branches_n, "Number of Branches (Real)": zero("b_n"), "Branch Min Length": zero("b_min"), "Branch Max Length": zero("b_max"),
            "Branch Mean Length": b_mean, "Areal Frequency P20": traces_n / a, "Areal Frequency B20": branches_n / a, "Dimensionless Intensity B22": p21 * b_mean,
            "Connections per Trace": some(2 * (y + x), traces_n), "Connections per Branch": some(3 * y + 4 * x, branches_n), "Connection Frequency": (y + x) / a,
            "Trace Mean Length (Mauldon)": mauldon, "Fracture Density (Mauldon)": density, "Fracture Intensity (Mauldon)": mauldon * density,
        }
    names = [p.name for p in PARAMETERS if p.name != "Censoring"]
    return out.select(*by, *[(values[k] if k in values else _nan()).alias(k) for k in names])


# Sets


def set_table(lines: DataFrame, column: str, names: Sequence[str], by: Sequence[str] = ("network",)) -> DataFrame:
    """Count, total length and share of each configured set in each group, zero where there is none."""
    every = lines.select(*by).distinct().withColumn(column, F.explode(F.array(*map(F.lit, names))))
    sums = lines.groupBy(*by, column).agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    out = every.join(sums, [*by, column], "left").fillna({"n": 0, "total": 0.0})
    whole = Window.partitionBy(*by)
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("total"), F.sum("total").over(whole)), F.lit(0.0))).withColumn("rank", F.rank().over(whole.orderBy(F.col("total").desc())))


def rose(lines: DataFrame, axial: bool = True, multiplier: float = 1.0, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, bin, centre, width, height): lengths summed by azimuth, in bins whose number grows as the cube root of the lines'.

    The last bin is closed. Bins without lines have height 0.
    """
    turn = 180.0 if axial else 360.0
    n = lines.groupBy(*by).agg(F.count("*").alias("n"))
    bins = n.withColumn("bins", F.ceil(turn / (F.lit(turn) / (2 * F.pow("n", F.lit(1 / 3))) * multiplier)).cast("int")).withColumn("width", turn / F.col("bins"))
    at = F.least(F.floor(F.col("azimuth") / F.col("width")).cast("int"), F.col("bins") - 1)
    sums = lines.join(bins.select(*by, "bins", "width"), list(by)).withColumn("bin", at).groupBy(*by, "bin").agg(F.sum("length").alias("height"))
    every = bins.select(*by, "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(sums, [*by, "bin"], "left").select(*by, "bin", ((F.col("bin") + 0.5) * F.col("width")).alias("centre"), "width", F.coalesce("height", F.lit(0.0)).alias("height"))


ANGLES = (0, 30, 60, 90, 120, 150)


def anisotropy(branches: DataFrame, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, angle, value): lengths of C-C branches times the cosine of their turn from each angle, summed."""
    d = lambda a: F.abs(F.col("azimuth") - a)
    turn = lambda a: F.when(d(a) <= 90, d(a)).otherwise(180.0 - d(a))
    of = F.when(F.col("connection") == "C-C", F.col("length")).otherwise(0.0)
    sums = branches.groupBy(*by).agg(*[F.sum(of * F.cos(F.radians(turn(a)))).alias(f"a{a}") for a in ANGLES])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), F.col(f"a{a}").alias("value")) for a in ANGLES]))
    return sums.select(*by, rows.alias("r")).select(*by, "r.angle", "r.value")


def ternary(counts: DataFrame, columns: tuple[str, str, str], by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, first, third, second) in percent; null where all are 0."""
    a, b, c = (F.col(f"`{k}`") for k in columns)
    total = F.when(a + b + c > 0, a + b + c)
    return counts.select(*by, *[(100.0 * v / total).alias(n) for n, v in (("p1", a), ("p2", c), ("p3", b))])


def connections_line(per_branch: float, step: float = 0.01) -> list[tuple[float, float, float]]:
    """Points (x, i, y) of node shares with that many connections per branch: 4x + 3y = c (4x + 3y + i) / 2, x + y + i = 1."""
    out, x = [], 0.0
    while x <= 1:
        y = (0.5 * per_branch + x * (1.5 * per_branch - 4)) / (3 - per_branch)
        if not 0 <= y <= 1 - x + 1e-12:
            if out:
                break
        else:
            out.append((x, 1 - x - y, y))
        x = round(x + step, 10)
    return out


# Relations of sets


def relations(traces: DataFrame, nodes: DataFrame, set_column: str, names: Sequence[str], buffer: float, cell: float, by_name: str = "network") -> DataFrame:
    """(network, first, second, x, y, y_reverse, error_count) for each pair of sets that both have traces.

    A node counts for a pair if traces of both sets lie within the buffer. X nodes count as x; Y nodes as y where they touch
    an end of the first set's traces, else as y_reverse; other classes are errors.
    """
    order = {n: i for i, n in enumerate(names)}
    ranked = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    xy = nodes.where(F.col("class").isin("X", "Y")).withColumn("id", F.xxhash64("network", "x", "y")).select("id", "network", "x", "y", "class")
    near = joins.nodes_on_traces(xy, traces.select("trace_id", "network", "pts"), buffer, cell).join(traces.select("trace_id", F.col(set_column).alias("of")), "trace_id")
    near = near.where(F.col("of").isin(list(names))).groupBy("network", "id", "class", "of").agg(F.max("at_end").alias("at_end"))
    a, b = near.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.network") == F.col("b.network")) & (ranked[F.col("a.of")] < ranked[F.col("b.of")]))
    found = pairs.select(F.col("a.network").alias("network"), F.col("a.of").alias("first"), F.col("b.of").alias("second"), F.col("a.class").alias("class"), F.col("a.at_end").alias("at_end"))
    count = lambda c: F.count(F.when(c, 1))
    sums = found.groupBy("network", "first", "second").agg(
        count(F.col("class") == "X").alias("x"), count((F.col("class") == "Y") & F.col("at_end")).alias("y"), count((F.col("class") == "Y") & ~F.col("at_end")).alias("y_reverse"), count(~F.col("class").isin("X", "Y")).alias("error_count")
    )
    return with_every_pair(traces, sums, set_column, names)


def with_every_pair(traces: DataFrame, sums: DataFrame, set_column: str, names: Sequence[str]) -> DataFrame:
    """Sums (network, first, second, ...) for each pair of sets that both have traces, 0 where they have no row."""
    ranked = F.create_map(*[F.lit(v) for kv in enumerate(names) for v in kv[::-1]])
    present = traces.where(F.col(set_column).isin(list(names))).select("network", F.col(set_column).alias("of")).distinct()
    every = present.alias("p").join(present.alias("q"), (F.col("p.network") == F.col("q.network")) & (ranked[F.col("p.of")] < ranked[F.col("q.of")]))
    every = every.select(F.col("p.network").alias("network"), F.col("p.of").alias("first"), F.col("q.of").alias("second"))
    return every.join(sums, ["network", "first", "second"], "left").fillna(0)


# Samples


def weighted_samples(samples: DataFrame, by: Sequence[str] = ("name",), weight: str = "Area") -> DataFrame:
    """Parameters of samples put together: sums, and means weighted by the area; other columns as a JSON list."""
    how = {p.name: p.how for p in PARAMETERS}
    w = F.col(f"`{weight}`")
    out = []
    for c in samples.columns:
        if c in by:
            continue
        v = F.col(f"`{c}`")
        if how.get(c) == "sum":
            out.append(F.sum(v).alias(c))
        elif c in how:
            out.append((F.sum(v * w) / F.sum(w)).alias(c))
        else:
            out.append(F.to_json(F.array_sort(F.collect_list(v))).alias(c))
    return samples.groupBy(*by).agg(*out)


def as_columns(described: DataFrame, names: Sequence[str], parameters: Sequence[str], key: str = "network") -> DataFrame:
    """(parameter, one column for each network) of a table with one row for each network."""
    values = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(f"`{p}`").cast("double").alias("value")) for p in parameters])
    long = described.select(key, F.explode(values).alias("r")).select(key, "r.parameter", "r.value")
    return long.groupBy("parameter").pivot(key, list(names)).agg(F.first("value"))


# Directions


def circular_mean(lines: DataFrame, column: str = "azimuth", by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, mean, spread): the direction of the sum of unit vectors, 0 to 360, and the root mean square turn from it."""
    r = F.radians(column)
    mean = lines.groupBy(*by).agg(F.sum(F.sin(r)).alias("s"), F.sum(F.cos(r)).alias("c")).select(*by, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean"))
    d = F.abs(F.col(column) - F.col("mean"))
    turn = F.least(d, 360.0 - d)
    return lines.join(mean, list(by)).groupBy(*by, "mean").agg(F.sqrt(F.avg(turn * turn)).alias("spread"))


# Ternary diagrams


def ternary_heatmap(points: DataFrame, bins: int = 40, sigma: float = 2.0, by: Sequence[str] = ("network",)) -> DataFrame:
    """(by, i, j, n, smooth): points (p1, p2 in percent) counted in bins, and the counts smoothed by a Gaussian of so many
    bins, cut off at four sigma. Each filled bin spreads to its neighbours by a join with the fixed kernel."""
    width = 100.0 / bins
    at = lambda c: F.least(F.floor(F.col(c) / width).cast("int"), F.lit(bins - 1))
    counts = points.where("p1 is not null").groupBy(*by, at("p1").alias("i"), at("p2").alias("j")).agg(F.count("*").alias("n"))
    reach = int(4 * sigma)
    weights = [(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    total = sum(w for _, w in weights)
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in weights])
    spread = counts.withColumn("a", F.explode(kernel)).withColumn("b", F.explode(kernel))
    spread = spread.select(*by, (F.col("i") + F.col("a.k")).alias("i"), (F.col("j") + F.col("b.k")).alias("j"), (F.col("n") * F.col("a.w") * F.col("b.w")).alias("v"))
    inside = spread.where(F.col("i").between(0, bins - 1) & F.col("j").between(0, bins - 1)).groupBy(*by, "i", "j").agg(F.sum("v").alias("smooth"))
    return inside.join(counts, [*by, "i", "j"], "left").select(*by, "i", "j", F.coalesce("n", F.lit(0)).alias("n"), "smooth")


def random_branch_curve(points: int = 11) -> list[tuple[float, float, float]]:
    """Shares (C-C, C-I, I-I) of branches whose ends are connected at random with probability 0, 0.1, ..., 1."""
    out = []
    for k in range(points):
        p = k / (points - 1)
        out.append((p * p, 2 * p * (1 - p), (1 - p) ** 2))
    return out
