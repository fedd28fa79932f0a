"""Where many traces meet, queries equal their SQL and shuffle rows in proportion to the traces, not to the pairs that meet."""

import os

import pytest

from riftspark import queries
from riftspark.functions.lineage import cut

from . import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

NAMES = ["branches", "topology_parameters", "node_counts", "azimuth_set_relations", "proximal_traces", "multi_junctions", "near_nodes", "snap_misses", "v_nodes", "end_distances", "crossings", "contour_grid"]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """The orders of sf0.001 moved into a square of 12 by 12, so that each crosses about 40 others."""
    at = tmp_path_factory.mktemp("crowded")
    for t in oracle.TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", at / f"{t}.parquet")
    c = oracle.connect(SF)
    # keys of which the views' products modulo 1024 are below 12
    keys = "SELECT k FROM range(1, 200000) r(k) WHERE (k * {m}) % 1024 < 12"
    c.sql(f"""COPY (WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), a AS (SELECT k, row_number() OVER (ORDER BY hash(k), k) AS n FROM ({keys.format(m=7919)})),
      b AS (SELECT k, row_number() OVER (ORDER BY hash(k + 1), k) AS n FROM ({keys.format(m=104729)}))
      SELECT a.k AS o_orderkey, b.k AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM o JOIN a USING (n) JOIN b USING (n)) TO '{at}/orders.parquet'""")
    return str(at)


def moved(plan) -> int:
    """Rows written by the exchanges of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved(plan.plan())
    n = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return n + sum(moved(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("name", NAMES)
def test_crowded(spark, crowded, name):
    df = queries.QUERIES[name](spark, crowded)
    oracle.same(df, queries.SQL[name], crowded)
    assert moved(df._jdf.queryExecution().executedPlan()) < 15 * 1500


def test_crowded_polylines(spark):
    """Bent traces that meet each other often: flags equal those of all pairs, and crossings aren't shuffled."""
    import random

    from pyspark.sql import functions as F

    from riftspark.operators import joins

    random.seed(3)
    at = lambda k: 0 if k % 4 else 5 * k  # every fourth lies by itself
    rows = [(k, str(k % 2), [(at(k) + random.gauss(0, 0.5), random.gauss(0, 0.5)) for _ in range(5 if k % 3 else 2)]) for k in range(240)]
    t = spark.createDataFrame(rows, "trace_id long, network string, pts array<struct<x: double, y: double>>")
    crossed = joins.crosscuts(joins.crossings(t, 0.25)).where(F.col("n") >= 3)
    want = {r.id for r in crossed.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct().collect()}
    found = joins.multiple_crosscuts(t, 0.25)
    assert 0 < len(want) < 240
    assert {r.id for r in found.collect()} == want
    assert moved(found._jdf.queryExecution().executedPlan()) < 12 * 4 * 240


def test_crowded_validation(spark, crowded, monkeypatch):
    """All rules together store no table of meetings."""
    from riftspark.operators import joins, validate

    stored = []
    for module in (joins, validate):
        monkeypatch.setattr(module, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    assert queries.QUERIES["validation_errors"](spark, crowded).count() == queries.views.order_traces(spark, crowded).count()
    assert max((df.count() for df in stored), default=0) < 2 * 1500
