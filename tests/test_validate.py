import pytest
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.operators import joins, validate
from riftspark.plans.network import Validation
from riftspark.sources.vector import areas_from, lines_from
from riftspark.streaming import rules

T = validate.Thresholds(snap=0.01)


def errors(spark, rows, areas=None, t=T):
    df = Validation(lines_from(spark, rows), areas_from(spark, areas) if areas else None, t, cell=1.0).run()
    return {r.trace_id: r.errors for r in df.collect()}


def row_errors(spark, pts):
    return validate.with_row_errors(lines_from(spark, [(1, "n", pts)]), T).first().errors


def test_good_traces(spark):
    assert errors(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(1, -1), (1, 1)])]) == {1: [], 2: []}


@pytest.mark.parametrize(
    ("pts", "cuts"),
    [([(0, 0), (2, 0), (2, 2), (1, -1)], True), ([(0, 0), (1, 0), (1, 1), (0, 0)], True), ([(0, 0), (1, 0), (2, 0)], False), ([(0, 0), (2, 0), (1, 0)], True), ([(0, 0), (1, 0)], False)],
)
def test_cuts_itself(spark, pts, cuts):
    assert ("CUTS ITSELF" in row_errors(spark, pts)) is cuts


@pytest.mark.parametrize(("pts", "sharp"), [([(0, 0), (1, 0), (0.5, 0.1), (2, 0)], True), ([(0, 0), (1, 0), (2, 0.5)], False), ([(0, 0), (1, 0)], False), ([(0, 0), (1, 1), (2, 0), (3, 1)], False)])
def test_sharp_turns(spark, pts, sharp):
    assert ("SHARP TURNS" in row_errors(spark, pts)) is sharp


def test_null_and_multi_part_geometry(spark):
    parts = [(1, "n", [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)]]), (2, "n", [[(0.0, 5.0), (1.0, 5.0)], [(7.0, 7.0), (8.0, 8.0)]]), (3, "n", None)]
    df = spark.createDataFrame(parts, f"trace_id long, network string, parts array<{geom.LINE}>")
    got = {r.trace_id: r for r in Validation(df, None, T, cell=1.0).run().collect()}
    assert got[1].errors == [] and len(got[1].pts) == 3
    assert got[2].errors == ["GEOM TYPE MULTILINESTRING"]
    assert got[3].errors == ["NULL GEOMETRY"]
    strict = {r.trace_id: r.errors for r in Validation(df, None, T, fix=False, cell=1.0).run().collect()}
    assert strict[1] == ["GEOM TYPE MULTILINESTRING"]


def test_v_nodes_and_multi_junctions(spark):
    v = errors(spark, [(1, "n", [(0, 0), (1, 1)]), (2, "n", [(1, 1), (2, 0)])])
    assert v[1] == v[2] == ["V NODE"]
    m = errors(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(1, -1), (1, 1)]), (3, "n", [(1.005, -1), (1.005, 1)])])
    assert "MULTI JUNCTION" in m[1]


def test_multiple_crosscuts(spark):
    got = errors(spark, [(1, "n", [(0, 0), (8, 0)]), (2, "n", [(1, -1), (2, 1), (4, -1), (6, 1)])])
    assert "MULTIPLE CROSSCUTS" in got[1] and "MULTIPLE CROSSCUTS" in got[2]


@pytest.mark.parametrize(("end", "kind"), [(0.0105, "UNDERLAPPING SNAP"), (-0.0105, "OVERLAPPING SNAP"), (0.005, None), (0.5, None)])
def test_snap_errors(spark, end, kind):
    got = errors(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(2, end), (2, 3)])])[2]
    assert [e for e in got if "SNAP" in e] == ([kind] if kind else [])


def test_target_area_underlap(spark):
    box = [(1, "n", [[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)]])]
    assert errors(spark, [(1, "n", [(0, 0), (4.988, 0)])], box)[1] == ["TRACE UNDERLAPS TARGET AREA"]
    assert errors(spark, [(1, "n", [(0, 0), (4.9, 0)])], box)[1] == []
    assert errors(spark, [(1, "n", [(0, 0), (5.1, 0)])], box)[1] == []


def test_stacked_traces(spark):
    assert "STACKED TRACES" in errors(spark, [(1, "n", [(0, 0), (0, 1)]), (2, "n", [(0, -1), (0, 2)])])[1]
    assert errors(spark, [(1, "n", [(10, 0), (10, 1)]), (2, "n", [(0, -1), (0, 2)])])[1] == []
    near = errors(spark, [(1, "n", [(0, 0), (3, 0)]), (2, "n", [(0, 0.03), (3, 0.03)])])
    assert "STACKED TRACES" in near[1]
    triangle = errors(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(1, -1), (1.97, 0.0), (2.0, 0.02), (2.03, 0.0), (3, -1)])])
    assert "STACKED TRACES" in triangle[1]


def test_order_of_errors_and_summary(spark):
    got = Validation(lines_from(spark, [(1, "n", [(0, 0), (1, 0), (0.2, 0.1), (0.5, -1)]), (2, "n", [(5, 5), (6, 6)])]), None, T, cell=1.0).run()
    assert {r.trace_id: r.errors for r in got.collect()} == {1: ["CUTS ITSELF", "SHARP TURNS"], 2: []}
    assert {r.error: r.n for r in validate.summary(got).collect()} == {"CUTS ITSELF": 1, "SHARP TURNS": 1}


def test_proximal(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (0, 3)]), (2, "n", [(0, 0.5), (0, 3.5)]), (3, "n", [(10, 0), (10, 3)]), (4, "n", [(0, 5), (5, 5)])])
    assert {r.trace_id: r.merge for r in joins.proximal(lines, 1.0, 1.0, 10.0).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_distinct_points(spark):
    pts = spark.createDataFrame([(i, "n", x, 0.0) for i, x in enumerate((0.0, 0.5, 1.0, 5.0))], "id long, network string, x double, y double")
    assert sorted(r.id for r in joins.distinct_points(pts, 0.6).collect()) == [0, 2, 3]


def test_row_rules_on_a_stream(spark, tmp_path):
    lines_from(spark, [(1, "n", [(0, 0), (1, 0), (0.5, 0.1), (2, 0)]), (2, "n", [(0, 0), (1, 0)])]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"trace_id long, network string, pts {geom.LINE}").parquet(str(tmp_path / "in"))
    q = rules.validated_stream(stream).select("trace_id", "errors").writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.trace_id: r.errors for r in spark.table("checked").collect()} == {1: ["SHARP TURNS"], 2: []}
    totals = rules.length_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "d")).start()
    totals.processAllAvailable()
    totals.stop()
    assert spark.table("totals").select(F.col("n")).first()[0] == 2


def test_an_end_beyond_a_bend_overlaps_whatever_the_distance(spark):
    """A trace that the missed one cuts elsewhere overlaps it, one that it doesn't cut underlaps."""
    rows = [(1, "n", [(0, -1), (0, 4.9895)]), (2, "n", [(-1, 0), (3, 0), (3, 5), (-1, 5)]), (3, "n", [(20, 0), (20, 4.9895)]), (4, "n", [(19, 5), (21, 5)])]
    got = {(r.id, r.error) for r in joins.snap_errors(lines_from(spark, rows), 1.0, 0.01).collect()}
    assert got == {(1, "OVERLAPPING SNAP"), (3, "UNDERLAPPING SNAP")}


def test_parts_merge_in_any_order_and_direction(spark):
    from riftspark.operators import overlay

    cases = {
        "in order": ([[(0, 0), (1, 0)], [(1, 0), (2, 0)]], [(0, 0), (1, 0), (2, 0)]),
        "second reversed": ([[(0, 0), (1, 0)], [(2, 0), (1, 0)]], [(0, 0), (1, 0), (2, 0)]),
        "before the first": ([[(1, 0), (2, 0)], [(0, 0), (1, 0)]], [(0, 0), (1, 0), (2, 0)]),
        "shuffled": ([[(1, 0), (2, 0)], [(3, 0), (4, 0)], [(3, 0), (2, 0)], [(0, 0), (1, 0)]], [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]),
        "mostly backwards": ([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(3, 0), (2, 0)]], [(3, 0), (2, 0), (1, 0), (0, 0)]),
        "apart": ([[(0, 0), (1, 0)], [(5, 0), (6, 0)]], None),
        "three in a point": ([[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]], None),
        "one": ([[(0, 0), (1, 0)]], [(0, 0), (1, 0)]),
        "null": (None, None),
    }
    rows = [(k, None if p is None else [[(float(x), float(y)) for x, y in part] for part in p]) for k, (p, _) in cases.items()]
    got = overlay.merge_parts(spark.createDataFrame(rows, "k string, parts array<array<struct<x: double, y: double>>>")).collect()
    assert {r.k: r.pts and [(p.x, p.y) for p in r.pts] for r in got} == {k: v for k, (_, v) in cases.items()}
