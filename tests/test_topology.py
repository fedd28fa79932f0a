import pytest
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.operators import grid, joins, overlay, params, topology
from riftspark.plans.network import MultiNetwork, Network
from riftspark.sources.vector import areas_from, lines_from

BOX = [(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)]


def points(df):
    return sorted((r["trace_id"], [tuple(p) for p in r["pts"]]) for r in df.collect())


def test_box_pairs_give_each_pair_once(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (10, 10)]), (2, "n", [(0, 10), (10, 0)]), (3, "n", [(20, 20), (21, 21)]), (4, "m", [(0, 0), (10, 10)])])
    s = grid.segments_of(lines)
    for split in (False, True):
        got = [(r.a_id, r.b_id) for r in grid.other_pairs(s, 1.0, split=split).collect()]
        assert got == [(1, 2)]


def test_crossings_touches_and_overlaps(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(1, -1), (1, 1)]), (3, "n", [(2, 0), (2, 2)]), (4, "n", [(3, 0), (6, 0)])])
    got = sorted((r.a_id, r.b_id, r.x, r.y) for r in joins.crossings(lines, 1.0).collect())
    assert got == [(1, 2, 1, 0), (1, 3, 2, 0)]
    assert sorted((r.a_id, r.b_id, r.x) for r in joins.overlaps(lines, 1.0).collect()) == [(1, 4, 3), (1, 4, 4)]


def test_branches_and_nodes_of_a_small_network(spark):
    lines = lines_from(spark, [(1, "n", [(-5, 0), (5, 0)]), (2, "n", [(-2, -2), (-2, 2)]), (3, "n", [(2, 0), (2, 3)]), (4, "n", [(3, 4), (4, 4)])])
    areas = areas_from(spark, [(1, "n", [BOX])])
    branches, nodes = topology.branches_and_nodes(lines, areas, 0.001, 1.0)
    assert params.node_counts(nodes).first().asDict() == {"network": "n", "X": 1, "Y": 1, "I": 5, "E": 2}
    counts = params.branch_counts(branches).first().asDict()
    assert counts == {"network": "n", "C-C": 1, "C-I": 3, "I-I": 1, "C-E": 2, "I-E": 0, "E-E": 0}


def test_identical_and_overlapping_traces_count_once(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (1, 0)]), (2, "n", [(0, 0), (1, 0)]), (3, "n", [(1, 0), (0, 0)])])
    assert topology.distinct_traces(lines, 0.001).count() == 2
    assert topology.branches_of(lines, 1.0, 0.001).count() == 1


def test_empty_and_null_lines(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (1, 0)])]).unionByName(spark.createDataFrame([(2, "n", None), (3, "n", [])], f"trace_id long, network string, pts {geom.LINE}"))
    assert grid.segments_of(lines).count() == 1
    assert joins.crossings(lines.limit(0), 1.0).count() == 0
    assert topology.branches_of(lines, 1.0, 0.001).count() == 1


@pytest.mark.parametrize(
    ("line", "p", "snap", "want"),
    [
        ([(0, 0), (1, 0), (2, 0), (3, 0)], (1.25, 0.1), 0.01, [(0, 0), (1, 0), (1.25, 0.1), (2, 0), (3, 0)]),
        ([(0, 0), (1, 0), (2, 0), (3, 0)], (2.25, 0.1), 0.01, [(0, 0), (1, 0), (2, 0), (2.25, 0.1), (3, 0)]),
        ([(0, 0), (1, 0), (2, 0)], (1.001, 0.0), 0.01, [(0, 0), (1.001, 0.0), (2, 0)]),
        ([(0, 0), (1, 0)], (1, 0), 0.01, [(0, 0), (1, 0)]),
        ([(0, 0), (10, 0)], (1, 0.1), 0.2, [(0, 0), (1, 0.1), (10, 0)]),
    ],
)
def test_points_are_put_in_beside_the_nearest_vertex(line, p, snap, want):
    assert topology._insert(line, p, snap) == want


def test_ends_snap_to_vertices_but_not_across(spark):
    near = lines_from(spark, [(1, "n", [(0, 0), (3, 0)]), (2, "n", [(3.0001, -3), (3.0001, 0), (3, 3)])])
    got = dict(points(topology.snap_traces(near, 1.0, 0.001)))
    assert got[1] == [(0, 0), (3.0001, 0)]
    over = lines_from(spark, [(1, "n", [(0, 0), (3.0002, 0)]), (2, "n", [(3.0001, -3), (3.0001, 0), (3, 3)])])
    moved, _ = topology.snap_round(over, 1.0, 0.001)
    assert dict(points(moved))[1] == [(0, 0), (3.0002, 0)]


def test_ends_are_inserted_into_other_traces(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (4, 0)]), (2, "n", [(2, 0.0005), (2, 3)])])
    got = dict(points(topology.snap_traces(lines, 1.0, 0.001)))
    assert got[1] == [(0, 0), (2, 0.0005), (4, 0)]
    branches, nodes = topology.branches_and_nodes(lines, None, 0.001, 1.0)
    assert branches.count() == 3 and nodes.where("class = 'Y'").count() == 1


def test_clip_keeps_parts_and_attributes(spark):
    lines = lines_from(spark, [(1, "n", [(-9, 0), (9, 0)]), (2, "n", [(0, 0), (1, 1)]), (3, "n", [(8, 8), (9, 9)])]).withColumn("name", F.lit("k"))
    ring = [(-5, -5), (5, -5), (5, 5), (1, 5), (1, -1), (-1, -1), (-1, 5), (-5, 5), (-5, -5)]  # a notch about x = 0
    got = overlay.clip(lines, areas_from(spark, [(1, "n", [ring])]), 2.0)
    assert points(got.where("trace_id = 1")) == [(1, [(-5, 0), (-1, 0)]), (1, [(1, 0), (5, 0)])]
    assert {r.name for r in got.collect()} == {"k"}
    assert got.where("trace_id = 3").count() == 0


def test_circular_weights(spark):
    lines = lines_from(spark, [(1, "n", [(-9, 0), (9, 0)]), (2, "n", [(0, 1), (9, 1)]), (3, "n", [(0, 2), (3, 2)])])
    areas = areas_from(spark, [(1, "n", [BOX])])
    weighted = Network(lines, areas, 0.001, circular=True, cell=2.0).traces.agg(F.sum("length")).first()[0]
    plain = Network(lines, areas, 0.001, circular=False, cell=2.0).traces.agg(F.sum("length")).first()[0]
    assert (weighted, plain) == (13.0, 18.0)  # 0 x 10 + 2 x 5 + 1 x 3; 10 + 5 + 3


def test_parameters_by_their_formulas(spark):
    x, y, i, e, area = 268, 826, 476, 114, 1237.9
    nodes = spark.createDataFrame([("n", k) for k, n in (("X", x), ("Y", y), ("I", i), ("E", e)) for _ in range(n)], "network string, class string")
    traces = spark.createDataFrame([("n", float(k)) for k in (1, 2, 3)], "network string, length double")
    p = params.topology_parameters(traces, spark.createDataFrame([("n", area)], "network string, area double"), nodes, traces, circular=True).first()
    assert (p["Number of Traces"], p["Number of Branches"]) == (651, 2013)
    assert [round(p[k], 2) for k in ("Areal Frequency P20", "Areal Frequency B20", "Connections per Trace", "Connections per Branch", "Connection Frequency")] == [0.53, 1.63, 3.36, 1.76, 0.88]
    assert p["Fracture Intensity (Mauldon)"] == pytest.approx(p["Trace Mean Length (Mauldon)"] * p["Fracture Density (Mauldon)"])


def test_relations(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (0, 2)]), (2, "n", [(0, 1), (2, 1)]), (3, "n", [(-1, 0.5), (1, 0.5)])]).withColumn("of", F.expr("CASE trace_id WHEN 1 THEN '1' ELSE '2' END"))
    nodes = spark.createDataFrame([("n", 0.0, 1.0, "Y"), ("n", 0.0, 0.5, "X"), ("n", 2.0, 1.0, "I")], "network string, x double, y double, class string")
    got = params.relations(lines, nodes, "of", ["1", "2", "3"], 0.001, 1.0).collect()
    assert [tuple(r) for r in got] == [("n", "1", "2", 1, 0, 1, 0)]


def test_anisotropy_and_ternary(spark):
    b = spark.createDataFrame([("n", 0.0, 2.0, "C-C"), ("n", 90.0, 1.0, "C-C"), ("n", 45.0, 9.0, "C-I")], "network string, azimuth double, length double, connection string")
    got = {r.angle: round(r.value, 6) for r in params.anisotropy(b).collect()}
    assert got[0] == 2.0 and got[90] == 1.0 and got[30] == pytest.approx(2 * 0.866025 + 0.5, abs=1e-5)
    c = spark.createDataFrame([("n", 1, 2, 1), ("m", 0, 0, 0)], "network string, X int, Y int, I int")
    assert {r.network: (r.p1, r.p2, r.p3) for r in params.ternary(c, ("X", "Y", "I")).collect()} == {"n": (25, 25, 50), "m": (None, None, None)}


def test_rose(spark):
    lines = spark.createDataFrame([("n", a, w) for a, w in ((25.0, 5.0), (50.0, 5.0), (145.0, 10.0), (160.0, 60.0))], "network string, azimuth double, length double")
    got = [(r.width, r.height) for r in params.rose(lines).orderBy("bin").collect()]
    assert got == [(45, 5), (45, 5), (45, 0), (45, 70)]


def test_line_merge(spark):
    lines = lines_from(spark, [(1, "n", [(0, 0), (0, 2)]), (2, "n", [(0, 2.001), (0, 4)]), (3, "n", [(0, 6), (0, 4.001)]), (4, "n", [(5, 0), (5, 2)])])
    assert points(overlay.line_merge(lines, 5.0, 0.01)) == [(1, [(0, 0), (0, 2), (0, 4), (0, 6)]), (4, [(5, 0), (5, 2)])]


def test_censoring_area(spark):
    first = areas_from(spark, [(1, "n", [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]])])
    second = areas_from(spark, [(1, "n", [[(2, 2), (6, 2), (2, 6), (2, 2)]])])
    assert overlay.polygon_overlaps(first, second).first()["area"] == pytest.approx(4.0)


def test_network_description_and_comparison(spark):
    lines = lines_from(spark, [(k * 10 + j, n, [(-4 + j, -4), (4 - j, 4)]) for k, n in enumerate("ab") for j in range(4)])
    net = Network(lines, areas_from(spark, [(1, "a", [BOX]), (2, "b", [BOX])]), 0.001, cell=2.0)
    rows = net.description().collect()
    assert {r["network"] for r in rows} == {"a", "b"} and all(r["Number of Traces (Real)"] == 4 for r in rows)
    compared = MultiNetwork(net).compared(["a", "b"], ["Area", "Number of Traces (Real)"]).collect()
    assert {r["parameter"]: (r["a"], r["b"]) for r in compared} == {"Area": (100, 100), "Number of Traces (Real)": (4, 4)}
    assert net.contour_grid(4.0).count() == 8
    assert net.rose().count() and net.anisotropy().count() and net.xyi_points().count() == 2


def test_outlines_and_inner_points(spark):
    from riftspark.operators import sampling

    ring = [(0, 0), (10, 0), (10, 4), (6, 4), (6, 1), (4, 1), (4, 4), (0, 4), (0, 0)]
    areas = areas_from(spark, [(1, "n", [ring]), (2, "n", [BOX])])
    inside = sampling.representative_points(areas).join(areas.select("area_id", "rings"), "area_id").select(geom.point_in_rings(F.col("x"), F.col("y"), "rings").alias("v")).collect()
    assert [r.v for r in inside] == [True, True]
    box = sampling.bounding_polygons(lines_from(spark, [(1, "n", [(0, 0), (4, 2)])])).select(geom.polygon_area("rings").alias("a")).first()
    assert box.a == 8 * 4


def test_circular_mean_and_heat_map(spark):
    d = spark.createDataFrame([("n", 350.0), ("n", 10.0)], "network string, azimuth double")
    r = params.circular_mean(d).first()
    assert min(r.mean, 360 - r.mean) == pytest.approx(0, abs=1e-6) and r.spread == pytest.approx(10)
    p = spark.createDataFrame([("n", 50.0, 20.0), ("n", 50.0, 20.0)], "network string, p1 double, p2 double")
    heat = params.ternary_heatmap(p).collect()
    assert sum(r.n for r in heat) == 2 and sum(r.smooth for r in heat) == pytest.approx(2.0, abs=1e-3)
    assert params.random_branch_curve()[5] == (0.25, 0.5, 0.25)
    assert params.connections_line(1.5)[0][0] == 0.0


def test_points_on_a_side_are_not_inside(spark):
    areas = areas_from(spark, [(1, "n", [BOX])])
    at = [(-5, 0), (5, 0), (0, -5), (0, 5), (-5, -5), (5, 5), (0, 0), (4.75, -4.75), (6, 0), (-6, 5)]
    df = spark.createDataFrame([(k, "n", float(x), float(y)) for k, (x, y) in enumerate(at)], "id int, network string, x double, y double")
    assert sorted(r.id for r in joins.inside_areas(df, areas, 2.0).collect()) == [6, 7]
    lines = lines_from(spark, [(1, "n", [(-5, 0), (0, 0)]), (2, "n", [(-5, 0), (-9, 0)]), (3, "n", [(5, 0), (0, 0)]), (4, "n", [(5, 0), (9, 0)])])
    got = {r.trace_id: (r.near, r.through) for r in joins.boundary_flags(lines, areas, 2.0, 0.01).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, False), 4: (True, True)}
