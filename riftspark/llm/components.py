"""Connected components of a table of links, by hooking and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A kept table (id, comp) of every node that isn't the smallest of its component; comp is the smallest.

    Each round hooks every node to its smallest smaller neighbour, which gives a forest; pointer jumping makes its trees
    stars; the links are then carried over to the roots. The rounds end when no link is left, after about log(nodes).
    Every table of a round is kept, so that joins on a hot root see two plain exchanges, which Spark can split.
    Null ends and links of a node with itself count for nothing.
    """
    edges = common.keep(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(), "edges"
    )
    found = None
    while edges.count():
        parent = common.keep(edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("comp")), "forest")
        while True:
            up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
            jumped = common.keep(parent.join(up, "comp", "left").select("id", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved")), "forest")
            moved = jumped.where("moved").limit(1).count()
            common.drop(parent)
            parent = jumped
            if not moved:
                break
        step = parent.select("id", "comp")
        if found is None:
            labels = step
        else:
            up = step.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
            labels = found.join(up, "comp", "left").select("id", F.coalesce("above", "comp").alias("comp")).unionByName(step)
        labels = common.keep(labels, "components")
        if found is not None:
            common.drop(found)
        found = labels
        hi, lo = step.toDF("hi", "hi_comp"), step.toDF("lo", "lo_comp")
        ends = edges.join(hi, "hi", "left").join(lo, "lo", "left").select(F.coalesce("hi_comp", "hi").alias("x"), F.coalesce("lo_comp", "lo").alias("y"))
        rest = common.keep(ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        common.drop(edges, parent)
        edges = rest
    if found is None:
        found = common.keep(edges.toDF("id", "comp"), "components")
    common.drop(edges)
    return found
