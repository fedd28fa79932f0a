"""Spatial joins as hash joins on grid cells.

Each segment goes to the cells that its box touches; two segments meet in a cell by an equi-join, which Spark plans as a
hash or sort-merge join and can split where a cell is crowded. A pair that shares several cells is kept in one of them
only, the cell of the greater of both least cells, so that no distinct is needed. A residual on the boxes drops the
rest. A side is never broadcast by us: Spark does so where it knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftspark.functions import geom

SEGMENT = ("x0", "y0", "x1", "y1")


def segments_of(traces: DataFrame) -> DataFrame:
    """(id, network, seg, x0, y0, x1, y1): the segments of traces, numbered from 0."""
    out = traces.select(F.col("trace_id").alias("id"), "network", F.posexplode(geom.segments("pts")).alias("seg", "s"))
    return out.select("id", "network", "seg", *[F.col(f"s.{c}").alias(c) for c in SEGMENT])


def ends_of(traces: DataFrame) -> DataFrame:
    """(id, network, end, x, y): the first (0) and last (1) vertex of each trace."""
    both = F.array(F.struct(F.lit(0).alias("end"), geom.start("pts").alias("p")), F.struct(F.lit(1).alias("end"), geom.end("pts").alias("p")))
    out = traces.where(F.size("pts") > 1).select(F.col("trace_id").alias("id"), "network", F.explode(both).alias("e"))
    return out.select("id", "network", F.col("e.end").alias("end"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def as_segments(points: DataFrame) -> DataFrame:
    """Points (x, y) as segments of no length, for the joins below."""
    return points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})


def median_length(segments: DataFrame) -> float:
    """A cell size for a table of segments: about the median length; 1 for none."""
    n = segments.agg(F.percentile_approx(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)), 0.5)).first()[0]
    return float(n) if n else 1.0


def split_long(segments: DataFrame, longest: float) -> DataFrame:
    """Segments with the boxes (bx0..by1) of their pieces of at most that length; coordinates stay whole."""
    whole = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.greatest(F.lit(1), F.ceil(whole / longest).cast("int"))
    out = segments.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("__n")
    i = F.col("__i")
    return out.withColumns({"bx0": at("x0", "x1", i), "by0": at("y0", "y1", i), "bx1": at("x0", "x1", i + 1), "by1": at("y0", "y1", i + 1)}).drop("__n", "__i")


def _celled(segments: DataFrame, prefix: str, cell: float, grow: float, split: bool) -> DataFrame:
    own = split_long(segments, 8 * cell) if split else segments.withColumns({f"b{c}": F.col(c) for c in SEGMENT})
    low = lambda a, b: F.floor((F.least(a, b) - grow) / cell).cast("long")
    high = lambda a, b: F.floor((F.greatest(a, b) + grow) / cell).cast("long")
    out = own.select(*[F.col(c).alias(prefix + c) for c in segments.columns], low("bx0", "bx1").alias(prefix + "cx"), high("bx0", "bx1").alias("__hx"), low("by0", "by1").alias(prefix + "cy"), high("by0", "by1").alias("__hy"))
    out = out.withColumn("cx", F.explode(F.sequence(F.col(prefix + "cx"), F.col("__hx"))))
    return out.withColumn("cy", F.explode(F.sequence(F.col(prefix + "cy"), F.col("__hy")))).drop("__hx", "__hy")


def box_pairs(a: DataFrame, b: DataFrame, cell: float, grow: float = 0.0, within: tuple[str, ...] = (), split: bool = False) -> DataFrame:
    """Pairs of segments whose boxes come as near as ``grow``, each once, with columns prefixed a_ and b_.

    within: columns that must be equal, such as the network. split: cut long segments into pieces first, which keeps
    their cells few; pairs then need a distinct.
    """
    left, right = _celled(a, "a_", cell, grow, split), _celled(b, "b_", cell, 0.0, split)
    on = (left["cx"] == right["cx"]) & (left["cy"] == right["cy"])
    for c in within:
        on = on & (left[f"a_{c}"] == right[f"b_{c}"])
    first = (left["cx"] == F.greatest("a_cx", "b_cx")) & (left["cy"] == F.greatest("a_cy", "b_cy"))
    out = left.join(right, on & first & geom.bbox_overlap("a_", "b_", grow))
    out = out.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns])
    return out.distinct() if split else out


def other_pairs(segments: DataFrame, cell: float, grow: float = 0.0, once: bool = True, within: tuple[str, ...] = ("network",), split: bool = False) -> DataFrame:
    """box_pairs() of a table with itself for different ids: each unordered pair once (a_id < b_id), or both ways."""
    out = box_pairs(segments, segments, cell, grow, within, split)
    return out.where("a_id < b_id" if once else "a_id <> b_id")
