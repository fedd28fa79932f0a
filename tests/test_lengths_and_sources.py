import itertools
import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftspark.operators import lengths, overlay, sampling
from riftspark.sources import vector


def lines(spark, values, name="n"):
    return spark.createDataFrame([(name, float(v)) for v in values], "network string, length double")


def test_ccm(spark):
    got = lengths.ccm(lines(spark, [2, 4, 8, 16, 32])).orderBy("length").collect()
    assert [r.ccm for r in got] == [1.0, 0.8, 0.6, 0.4, 0.2]
    areas = spark.createDataFrame([("n", 10.0)], "network string, area double")
    assert [round(r.ccm, 9) for r in lengths.ccm(lines(spark, [2, 4, 8, 16, 32]), areas=areas).orderBy("length").collect()] == [0.1, 0.08, 0.06, 0.04, 0.02]
    assert [r.ccm for r in lengths.ccm(lines(spark, [1, 1, 2, 0])).orderBy("length").collect()] == [1.0, pytest.approx(1 / 3)]


def brute(x):
    """xmin of least distance, and that distance, by trying all."""
    x = np.sort(np.array(x, float))
    best = None
    for xmin in np.unique(x)[:-1]:
        t = x[x >= xmin]
        alpha = 1 + len(t) / np.log(t / xmin).sum()
        d = max(abs(np.searchsorted(t, v, "left") / len(t) - (1 - (v / xmin) ** (1 - alpha))) for v in np.unique(t))
        if best is None or d < best[0]:
            best = (d, xmin, alpha)
    return best


def test_automatic_fit_is_that_of_brute_force(spark):
    x = np.round((1 + np.random.default_rng(3).pareto(2.5, 80)) * 2, 3)
    d, xmin, alpha = brute(x)
    got = lengths.powerlaw_fit(lines(spark, x)).first()
    assert (got.d, got.xmin, got.alpha) == (pytest.approx(d), xmin, pytest.approx(alpha))
    coarse = lengths.powerlaw_fit(lines(spark, x), candidates=10).first()
    assert coarse.d >= d - 1e-12


def test_fits_in_numpy():
    rng = np.random.default_rng(1)
    power = lengths.describe((1 + rng.pareto(2.0, 4000)), 1.0)
    assert power["power_law_alpha"] == pytest.approx(3.0, abs=0.15)
    assert power["power_law_vs_exponential_r"] > 2
    expo = lengths.describe(rng.exponential(2.0, 4000) + 1e-3, 0.01)
    assert expo["exponential_lambda"] == pytest.approx(0.5, abs=0.03)
    assert expo["power_law_vs_exponential_r"] < -2
    logn = lengths.describe(np.exp(rng.normal(1.0, 0.5, 4000)), 0.1)
    assert (logn["lognormal_mu"], logn["lognormal_sigma"]) == (pytest.approx(1.0, abs=0.05), pytest.approx(0.5, abs=0.05))
    assert all(math.isnan(v) for v in lengths.describe(np.array([1.0]), 1.0).values())


def test_optimised_cut_offs_prefer_the_straight_part(spark):
    x = np.concatenate([np.linspace(0.1, 1, 300), 1 / (1 - np.linspace(0, 0.99, 300))])
    got = lengths.optimised_cut_offs(lines(spark, x), spark.createDataFrame([("n", 1.0)], "network string, area double")).first()
    assert got.q >= 0.4


def test_geojson_round_trip(spark, tmp_path):
    raw = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1.5, 2, 7]]}, "properties": {"name": "a", "n": 1, "tags": None}},
            {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, "properties": {"name": "b", "n": 2.5}},
            {"type": "Feature", "geometry": None, "properties": {}},
        ],
    }
    path = tmp_path / "x.geojson"
    path.write_text(json.dumps(raw, indent=1))
    got = vector.read_traces(spark, str(path)).orderBy("trace_id").collect()
    assert [(len(r.parts) if r.parts else None, r.pts is None, r["name"], r["n"]) for r in got] == [(1, False, "a", 1.0), (2, True, "b", 2.5), (None, True, None, None)]
    assert tuple(got[0].pts[1]) == (1.5, 2.0)
    assert overlay.dissolve(vector.read_traces(spark, str(path)).drop("pts")).count() == 3
    whole = vector.read_traces(spark, str(path)).where("pts is not null").drop("parts")
    vector.write_collection(whole, str(tmp_path / "y.geojson"))
    again = vector.read_traces(spark, str(tmp_path / "y.geojson")).first()
    assert [tuple(p) for p in again.pts] == [(0, 0), (1.5, 2)] and again["name"] == "a"
    vector.write_features(whole, str(tmp_path / "z"))
    assert vector.read_traces(spark, str(tmp_path / "z"), lines=True).count() == 1
    with pytest.raises(TypeError):
        vector.read_areas(spark, str(path))
    with pytest.raises(ValueError):
        vector.check_not_empty(whole.limit(0), "traces")


def test_areas_and_wkt(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {}}]}))
    assert len(vector.read_areas(spark, str(path)).first().rings) == 2
    df = vector.read_wkt(spark.createDataFrame([("MULTILINESTRING ((0 0, 1 1 5), (2 2, 3 3))",), ("LINESTRING(0 0,1 2)",)], "wkt string"))
    assert [[tuple(p) for p in part] for part in df.first().parts] == [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]
    said = df.withColumn("pts", F.col("parts")[0]).select(vector.to_wkt("pts").alias("w"))
    assert said.collect()[1].w == "LINESTRING (0.0 0.0, 1.0 2.0)"


def test_columns_and_crs(spark):
    assert vector.unique_columns(["a", "A", "B", "fid", "b"]) == ["a", "b"]
    x = spark.range(1).withColumn("g", F.lit(1))
    a, b = vector.match_crs(vector.with_crs(x, "g", 3067), x, ("g", "g"))
    assert vector.crs_of(a, "g") == vector.crs_of(b, "g") == 3067


def test_cells_go_down_columns_from_the_top_left(spark):
    t = vector.lines_from(spark, [(1, "n", [(1, 1), (2, 2)]), (2, "n", [(2, 2), (-2, 5)]), (3, "n", [(3, 0), (2, 2)])])
    got = sampling.cells(sampling.total_bounds(t), 0.1).orderBy("cell_id").limit(2).collect()
    assert [(round(r.x0, 6), round(r.y1, 6), round(r.y0, 6)) for r in got] == [(-2, 5, 4.9), (-2, 4.9, 4.8)]


def test_circles_hold_clipped_lengths(spark):
    t = vector.lines_from(spark, [(1, "n", [(-9, 0), (9, 0)]), (2, "n", [(0, 0), (0, 1)]), (3, "n", [(50, 50), (51, 51)])])
    c = spark.createDataFrame([("n", 7, 0.0, 0.0, 2.0)], "network string, id long, x double, y double, r double")
    assert {r.line: round(r.length, 9) for r in sampling.lengths_in_circles(t, c, 1.0).collect()} == {1: 4.0, 2: 1.0}


def test_random_draws_repeat_and_stay_inside(spark):
    areas = spark.createDataFrame([("n", 5.0, 5.0, 10.0)], "network string, x double, y double, r double")
    one, two = (sampling.random_circles(areas, 50, 1.0, seed=4).orderBy("id").collect() for _ in range(2))
    assert one == two and all(math.dist((r.x, r.y), (5, 5)) + r.r <= 10 + 1e-9 and r.r >= 1 for r in one)
    box = spark.createDataFrame([("n", [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]])], "network string, rings array<array<struct<x: double, y: double>>>")
    pts = sampling.random_points(box, 30).collect()
    assert len(pts) == 30 and all(p.x + p.y <= 4 for p in pts)
    rows = spark.createDataFrame([(k, float(k)) for k in range(20)], "k long, w double")
    assert sampling.weighted_choice(rows, "k", "w", 5).count() == 5
    assert sampling.one_of_each(rows.withColumn("g", F.col("k") % 3), ["g"]).count() == 3


def test_command_line(tmp_path, capsys):
    from riftspark import cli

    assert cli.main(["info"]) == 0
    assert "pyspark" in json.loads(capsys.readouterr().out)


def test_command_line_network_and_validation(spark, tmp_path):
    from riftspark import cli

    feature = lambda kind, c: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"k": 1}}
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("LineString", [[-4, 0], [4, 0]]), feature("LineString", [[0, -4], [0, 4]])]}))
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [[[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]]])]}))
    t, a = str(tmp_path / "t.geojson"), str(tmp_path / "a.geojson")
    assert cli.main(["network", t, a, "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/branches.parquet")).count() == 4
    assert cli.main(["validate", t, a, "--output", str(tmp_path / "v.geojson")]) == 0
    assert vector.read_traces(spark, str(tmp_path / "v.geojson")).count() == 2
    assert cli.main(["snap", t, "--output", str(tmp_path / "s.geojson")]) == 0
    assert cli.main(["network", t, a, "--output", str(tmp_path / "plain"), "--no-topology", "--name", "crossing", "--censoring", a]) == 0
    row = spark.read.parquet(str(tmp_path / "plain/parameters.parquet")).first()
    assert (row["network"], row["Censoring"], row["Number of Traces (Real)"]) == ("crossing", 100.0, 2) and math.isnan(row["Connections per Trace"])
    assert not (tmp_path / "plain/branches.parquet").exists()
    assert cli.main(["validate", t, a, "--output", str(tmp_path / "o.geojson"), "--only-areas", "--no-empty"]) == 0
    (tmp_path / "far.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [[[50, 50], [60, 50], [60, 60], [50, 50]]])]}))
    with pytest.raises(ValueError, match="EMPTY TARGET AREA"):
        cli.main(["validate", t, str(tmp_path / "far.geojson"), "--output", str(tmp_path / "e.geojson"), "--no-empty"])


def test_thin_polygons_get_all_their_points(spark):
    thin = [(0.0, 0.0), (100.0, 100.0), (100.0, 100.2), (0.0, 0.0)]
    areas = vector.areas_from(spark, [(1, "n", [thin])])
    got = sampling.random_points(areas, 30).collect()
    assert len({r.id for r in got}) == len(got) == 30
    assert all(r.x - 1e-9 <= r.y <= r.x * 1.002 + 1e-9 for r in got)
    with pytest.raises(ValueError, match="no area"):
        sampling.random_points(vector.areas_from(spark, [(1, "n", [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])]), 3)


def test_too_many_properties_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "MOST_PROPERTIES", 2)
    (tmp_path / "f.geojson").write_text('{"features": [{"geometry": null, "properties": {"a": 1, "b": 2, "c": 3}}]}')
    with pytest.raises(ValueError, match="properties"):
        vector.features(spark, str(tmp_path / "f.geojson"))


def test_fit_descriptions_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.sort(rng.lognormal(0.3, 0.9, 300))
    fits = lengths.powerlaw_fit(lines(spark, x), xmin=0.8)
    got = lengths.describe_fits(lines(spark, x), fits).first().asDict()
    t = x[x >= 0.8]
    n, below = len(t), np.arange(len(t)) / len(t)
    alpha, rate = 1 + n / np.log(t / 0.8).sum(), 1 / (t - 0.8).mean()
    power, exponential = np.log((alpha - 1) / 0.8) - alpha * np.log(t / 0.8), np.log(rate) - rate * (t - 0.8)
    assert got["power_law_alpha"] == pytest.approx(alpha) and got["exponential_lambda"] == pytest.approx(rate)
    assert got["power_law_d"] == pytest.approx(np.abs(1 - (t / 0.8) ** (1 - alpha) - below).max())
    assert got["exponential_d"] == pytest.approx(np.abs(1 - np.exp(-rate * (t - 0.8)) - below).max())
    d = power - exponential
    r = d.sum() / (d.std() * math.sqrt(n))
    assert got["power_law_vs_exponential_r"] == pytest.approx(r) and got["power_law_vs_exponential_p"] == pytest.approx(math.erfc(abs(r) / math.sqrt(2)))
    # by brute force over a fine lattice of parameters
    at = np.exp(np.linspace(math.log(0.8), math.log(t[-1] * 60), 20_001))
    best = max(((-a * np.log(t / 0.8) - b * (t - 0.8)).sum() - n * math.log(np.trapezoid((at / 0.8) ** -a * np.exp(-b * (at - 0.8)), at)), a, b) for a in np.linspace(0.3, 2.5, 45) for b in np.linspace(0.01, 0.9, 45))
    assert got["truncated_power_law_loglikelihood"] >= best[0] - 1e-3 and abs(got["truncated_power_law_alpha"] - best[1]) < 0.1 and got["truncated_power_law_exponent"] == pytest.approx(1 - got["truncated_power_law_alpha"])
    # the power law is a case of the truncated one: p of twice the difference of the likelihoods
    more = got["truncated_power_law_loglikelihood"] - got["power_law_loglikelihood"]
    assert more > 0 and got["power_law_vs_truncated_power_law_p"] == pytest.approx(math.erfc(math.sqrt(more)), rel=1e-6)
    normal = lambda v: 0.5 * math.erfc(-(v - got["lognormal_mu"]) / (got["lognormal_sigma"] * math.sqrt(2)))
    share = np.array([(normal(math.log(v)) - normal(math.log(0.8))) / (1 - normal(math.log(0.8))) for v in t])
    assert got["lognormal_d"] == pytest.approx(np.abs(share - below).max(), abs=1e-9)


def test_running_sums_are_those_of_one_window(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.exp(rng.normal(0, 4, 500)), 3) + 0.001
    rows = spark.createDataFrame([(None if k % 3 == 0 else "b", float(v), k % 5 + 1) for k, v in enumerate(np.unique(x))], "network string, length double, k int")
    for falling in (False, True):
        got = lengths.running(rows, ["network"], {"s": F.col("k")}, falling).toPandas()
        for _, group in got.groupby("network", dropna=False):
            group = group.sort_values("length", ascending=not falling)
            assert group["s"].tolist() == group["k"].cumsum().tolist() and set(group["s_all"]) == {group["k"].sum()}


@pytest.mark.parametrize("blocks", [1, 3, 16, 1000])
def test_pruned_cut_offs_are_those_of_all_lengths(spark, blocks):
    rng = np.random.default_rng(blocks)
    x = np.round(np.concatenate([rng.pareto(1.6, 150) + 1, rng.uniform(0.1, 1.5, 80)]), 2)
    sizes = lengths.sizes_of(lines(spark, x))
    tried = lengths.least_distances(sizes, lengths.tails(sizes).select("network", "xmin", "n", "alpha"), blocks=blocks).collect()
    every = {}
    for xmin in np.unique(x)[:-1]:
        above = np.sort(x[x >= xmin])
        alpha = 1 + len(above) / np.log(above / xmin).sum()
        every[xmin] = np.abs(np.searchsorted(above, above) / len(above) - (1 - (above / xmin) ** (1 - alpha))).max()
    assert {r.xmin: pytest.approx(every[r.xmin], abs=1e-9) for r in tried} == {r.xmin: r.d for r in tried}
    best = min(every, key=lambda v: (every[v], v))
    assert best in {r.xmin for r in tried}
    if blocks == 1000:  # a block for each length bounds the gaps exactly
        assert {r.d for r in tried} == {min(r.d for r in tried)}


def test_own_cut_offs_are_the_best_of_all_choices(spark):
    rng = np.random.default_rng(3)
    sets = {"a": rng.pareto(1.5, 120) + 1, "b": np.concatenate([rng.uniform(2, 9, 150), 9 * (rng.pareto(1.5, 60) + 1)]), "c": rng.exponential(3, 90)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in sets.items() for v in x], "network string, length double")
    areas = spark.createDataFrame([("a", 10.0), ("b", 90.0), ("c", 20.0)], "network string, area double")
    qs = [0.0, 0.3, 0.6, 0.9]
    got = lengths.own_cut_offs(rows, areas, qs).orderBy("network").collect()
    points = {}
    for k, x in sets.items():
        u = np.unique(x)
        share = np.array([(x >= v).mean() for v in u]) / {"a": 10.0, "b": 90.0, "c": 20.0}[k]
        points[k] = [(np.log(u[u >= np.quantile(u, q)]), np.log(share[u >= np.quantile(u, q)])) for q in qs]
    scores = {}
    for choice in itertools.product(range(len(qs)), repeat=3):
        a, b = (np.concatenate([points[k][i][j] for k, i in zip("abc", choice, strict=True)]) for j in (0, 1))
        scores[tuple(qs[i] for i in choice)] = abs(1 - np.corrcoef(a, b)[0, 1] ** 2)
    best = min(scores, key=scores.get)
    assert tuple(r.q for r in got) == best and got[0].score == pytest.approx(scores[best], abs=1e-9)
    assert lengths.own_cut_offs(rows.limit(0), areas).count() == 0


def _geopackage(path, layers):
    """A GeoPackage with as much as a reader needs: layers of name to rows (blob, text)."""
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    for name, rows in layers.items():
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", [name])
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", [name])
        db.execute(f"CREATE TABLE {name} (fid INTEGER PRIMARY KEY, geom BLOB, note TEXT)")
        db.executemany(f"INSERT INTO {name} (geom, note) VALUES (?, ?)", rows)
    db.commit()
    db.close()


def test_geopackage(spark, tmp_path):
    head = lambda box=0, empty=0: b"GP\0" + bytes([1 | box << 1 | empty << 4]) + struct.pack("<i", 3067) + bytes([0, 32, 48, 48, 64][box])
    flat = lambda pts: struct.pack(f"<{sum(map(len, pts))}d", *[v for p in pts for v in p])
    line = lambda pts, kind=2: b"\1" + struct.pack("<II", kind, len(pts)) + flat(pts)
    two = b"\1" + struct.pack("<II", 5, 2) + line([(0, 0), (1, 1)]) + line([(2, 2), (1, 1)])
    big = b"\0" + struct.pack(">II", 2, 2) + struct.pack(">4d", 7, 8, 9, 10)
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    polygon = b"\1" + struct.pack("<III", 3, 1, 5) + flat(square)
    traces = [(head(1) + line([(0, 0), (3, 4)]), "plain"), (head() + line([(1, 2, 3), (4, 5, 6)], 1002), "with z"), (head() + two, "two parts"), (head() + big, None), (head(0, 1) + line([]), "empty"), (None, "null")]
    path = str(tmp_path / "net.gpkg")
    _geopackage(path, {"traces": traces, "areas": [(head() + polygon, "a")]})
    got = {r.note: r for r in vector.read_traces(spark, path, layer="traces").collect()}
    xy = lambda pts: [(p.x, p.y) for p in pts]
    assert xy(got["plain"].pts) == [(0, 0), (3, 4)] and xy(got["with z"].pts) == [(1, 2), (4, 5)] and xy(got[None].pts) == [(7, 8), (9, 10)]
    assert got["two parts"].pts is None and [xy(p) for p in got["two parts"].parts] == [[(0, 0), (1, 1)], [(2, 2), (1, 1)]]
    assert got["empty"].pts is None and got["null"].pts is None and got["plain"].network == "net"
    assert [xy(r) for r in vector.read_areas(spark, path, layer="areas").first().rings] == [square]
    for wrong in (None, "nodes"):
        with pytest.raises(Exception, match="layer"):
            vector.read_traces(spark, path, layer=wrong).collect()
    with pytest.raises(ValueError, match="no layers"):
        vector.read_traces(spark, str(tmp_path / "t.geojson"), layer="x")


def test_samples_are_networks_of_their_own(spark):
    from riftspark.plans.network import Network

    circle = [[(10 * math.cos(2 * math.pi * (k % 64) / 64), 10 * math.sin(2 * math.pi * (k % 64) / 64)) for k in range(65)]]
    traces = vector.lines_from(spark, [(1, "n", [(-9, 0), (9, 0.0)]), (2, "n", [(0, -9), (0.0, 9)]), (3, "n", [(-9, 1), (9, 1.5)])])
    net = Network(traces, vector.areas_from(spark, [(1, "n", circle)]), circular=True)
    samples = net.sample_networks(4, 8.0, seed=2)
    found = {r.network: r for r in samples.parameters().collect()}
    assert sorted(found) == [f"n/{k}" for k in range(4)]
    whole = {f"{r.network}/{r.id}": r for r in net.subsample(4, 8.0, seed=2).collect()}
    for name, row in found.items():
        assert row["Area"] == pytest.approx(whole[name]["Area"]) and row["Number of Traces (Real)"] == 3
        assert row["Fracture Intensity P21"] > 0 and row["Number of Branches (Real)"] == 7
    for samples, radius in ((0, 1.0), (3, 0.0), (3, -1.0)):
        with pytest.raises(ValueError, match="above 0"):
            net.subsample(samples, radius)
    with pytest.raises(Exception, match="smaller than the least radius"):
        net.subsample(3, 11.0).collect()
