"""Trace tables derived from the driver's tables, by arithmetic that any SQL engine does alike.

Coordinates of the orders view are multiples of 1/4, so that sums and differences are exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftspark.functions import geom

#: DuckDB's form of the two views, for WITH clauses.
ORDERS_SQL = """t AS (
  SELECT o_orderkey AS id, o_orderpriority AS grp, ((o_orderkey * 7919) % 1024)::DOUBLE AS x0, ((o_custkey * 104729) % 1024)::DOUBLE AS y0,
    ((o_orderkey * 7919) % 1024)::DOUBLE + (floor(o_totalprice)::BIGINT % 65 - 32)::DOUBLE / 4 AS x1,
    ((o_custkey * 104729) % 1024)::DOUBLE + ((floor(o_totalprice)::BIGINT * 31) % 67 - 33)::DOUBLE / 4 AS y1
  FROM orders
), l AS (SELECT * FROM t WHERE NOT (x0 = x1 AND y0 = y1))"""

EMBEDDINGS_SQL = """l AS (
  SELECT vec_id AS id, label::VARCHAR AS grp, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[3]::DOUBLE AS x1, embedding[4]::DOUBLE AS y1
  FROM embeddings
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, x0, y0, x1, y1): a short segment for each order."""
    p = F.floor("o_totalprice").cast("long")
    x0 = ((F.col("o_orderkey") * 7919) % 1024).cast("double")
    y0 = ((F.col("o_custkey") * 104729) % 1024).cast("double")
    x1 = x0 + (p % 65 - 32).cast("double") / 4
    y1 = y0 + ((p * 31) % 67 - 33).cast("double") / 4
    out = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return out.where("not (x0 = x1 and y0 = y1)")


def embedding_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, x0, y0, x1, y1): a dense small network for each label."""
    e = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"), *e)


def as_traces(segments: DataFrame) -> DataFrame:
    """(trace_id, network, pts) of a table of segments."""
    return segments.select(F.col("id").alias("trace_id"), F.col("grp").alias("network"), geom.segment_line(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("pts"))


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_traces(order_segments(spark, sf_dir))


def embedding_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_traces(embedding_segments(spark, sf_dir))


def embedding_polylines(spark: SparkSession, sf_dir: str, vertices: int = 5) -> DataFrame:
    """(trace_id, network, pts) with so many vertices, the first numbers of each vector."""
    e = F.col("embedding")
    pts = F.array(*[geom.point(e[2 * k], e[2 * k + 1]) for k in range(vertices)])
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace_id"), F.col("label").cast("string").alias("network"), pts.alias("pts"))
