import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.sources.vector import lines_from


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def line(*pts):
    return F.array(*[geom.point(x, y) for x, y in pts])


def test_length_and_bounds(spark):
    p = line((0, 0), (3, 4), (3, 5))
    assert value(spark, geom.length(p)) == 6.0
    assert tuple(value(spark, geom.bounds(p))) == (0, 0, 3, 5)
    assert value(spark, geom.length(line((1, 1)))) == 0.0


@pytest.mark.parametrize(("to", "azimuth", "half"), [((0, 1), 0, 0), ((1, 0), 90, 90), ((0, -1), 180, 0), ((-1, 0), 270, 90), ((1, 1), 45, 45), ((-1, -1), 225, 45)])
def test_azimuth(spark, to, azimuth, half):
    p = line((0, 0), to)
    assert value(spark, geom.azimuth(p, False)) == pytest.approx(azimuth)
    assert value(spark, geom.azimuth(p)) == pytest.approx(half)


def test_regression_azimuth_of_a_flat_line_is_zero(spark):
    assert value(spark, geom.regression_azimuth(line((0, 0), (1, 0), (2, 0)))) == 0.0
    assert value(spark, geom.regression_azimuth(line((0, 0), (1, 1), (2, 2)))) == pytest.approx(45)


def test_sets_are_inclusive_and_may_run_around(spark):
    ranges, names = [(0, 60), (60, 120), (150, 20)], ["a", "b", "c"]
    get = lambda v, **k: value(spark, geom.set_of(F.lit(float(v)), ranges[:2] if "strict" in k else ranges, names[:2] if "strict" in k else names, around=True, **k))
    assert [get(30), get(60), get(90), get(160), get(130)] == ["a", "a", "b", "c", "-1"]
    with pytest.raises(Exception, match="more than one range"):
        get(60, strict=True)


def test_boundary_weight(spark):
    assert [value(spark, geom.boundary_weight(F.lit(n))) for n in range(3)] == [1, 2, 0]
    with pytest.raises(Exception, match="0, 1 or 2"):
        value(spark, geom.boundary_weight(F.lit(3)))


def test_polygons(spark):
    box = geom.box_rings(0, 0, 4, 2)
    assert value(spark, geom.polygon_area(box)) == 8.0
    assert tuple(value(spark, geom.ring_centroid(box[0]))) == (2, 1)
    assert value(spark, geom.point_in_rings(F.lit(1.0), F.lit(1.0), box)) is True
    assert value(spark, geom.point_in_rings(F.lit(5.0), F.lit(1.0), box)) is False
    assert value(spark, geom.polygon_area(geom.circle_polygon(F.lit(0.0), F.lit(0.0), F.lit(1.0)))) == pytest.approx(3.1365, abs=1e-4)


def test_interpolate_and_segmentize(spark):
    p = line((0, 0), (2, 0), (2, 2))
    assert tuple(value(spark, geom.interpolate(p, F.lit(3.0)))) == (2, 1)
    assert tuple(value(spark, geom.interpolate(p, F.lit(9.0)))) == (2, 2)
    assert [tuple(x) for x in value(spark, geom.segmentize(p, 1.5))] == [(0, 0, 1.5, 0), (1.5, 0, 2, 1), (2, 1, 2, 2)]


def test_neighbours_and_replacement(spark):
    p = line((0, 0), (1, 0), (2, 0))
    assert tuple(value(spark, geom.next_vertex(p, geom.point(2, 0)))) == (1, 0)
    assert value(spark, geom.next_vertex(p, geom.point(1, 0))) is None
    assert [tuple(v) for v in value(spark, geom.replace_vertex(p, 1, geom.point(5, 5)))] == [(0, 0), (5, 5), (2, 0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=6))
def test_length_is_that_of_python(spark, pts):
    df = lines_from(spark, [(1, "n", pts)])
    got = df.select(geom.length("pts").alias("v")).first()[0]
    assert got == pytest.approx(sum(math.dist(a, b) for a, b in zip(pts, pts[1:], strict=False)))


def test_names_and_colours(spark):
    assert value(spark, geom.plain_name(F.lit("a b-c_1!"))) == "abc_1"
    assert [value(spark, geom.class_colour(F.lit(c))) for c in ("X", "C-I", "I", "E")] == ["green", "blue", "black", "red"]
    assert value(spark, geom.strike(F.lit(30.0))) == 300.0
    assert value(spark, geom.azimuths_close(F.lit(179.0), F.lit(2.0), 4.0)) is True
    assert value(spark, geom.azimuths_close(F.lit(179.0), F.lit(2.0), 4.0, False)) is False
