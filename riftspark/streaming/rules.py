"""Row rules and running aggregates on streams of traces.

Rules that need one row use the same expressions as in batches. Aggregates by network need state for each network only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.operators import validate


def validated_stream(traces: DataFrame, thresholds: validate.Thresholds | None = None) -> DataFrame:
    """A stream of traces (trace_id, network, pts, ...) with the errors of the row rules."""
    return validate.with_row_errors(traces, thresholds or validate.Thresholds())


def length_totals(traces: DataFrame, time: str | None = None, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count and total length by network; with a time column, by window, with late rows up to the watermark."""
    measured = traces.withColumn("length", geom.length("pts"))
    if time is None:
        return measured.groupBy("network").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    by = measured.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "network")
    return by.agg(F.count("*").alias("n"), F.sum("length").alias("total")).select(F.col("w.start").alias("start"), "network", "n", "total")
