"""Readers and writers of line and polygon tables: GeoJSON, GeoPackage (reading only), WKT and Parquet.

GeoJSON is read by Spark's JSON reader, from any store that Spark reads: a file with one feature collection is one row that
is exploded; newline-delimited features are split among tasks and scale. Properties become columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftspark.functions import geom
from riftspark.sources import geopackage

_COORDINATES = {"LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "Point": "array<double>"}


#: Columns that a table of features may have; the names of all properties reach the driver.
MOST_PROPERTIES = 10_000


class WrongGeometry(TypeError):
    """A table has no geometry, or one of a type that the caller can't use."""


def features(spark: SparkSession, path: str, lines: bool = False, layer: str | None = None) -> DataFrame:
    """(kind, coordinates, properties...) of GeoJSON: one collection in a file, or a feature on each line; or of a layer of
    files whose names end in .gpkg."""
    if path.rstrip("/").lower().endswith(".gpkg"):
        raw = geopackage.read_features(spark, path, layer)
    elif layer is not None:
        raise ValueError(f"{path} has no layers")
    elif lines:
        raw = spark.read.text(path).select(F.col("value").alias("f"))
    else:
        # geometry stays text until its type is known
        whole = spark.read.text(path, wholetext=True)
        raw = whole.select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("f"))
    raw = raw.where(F.length(F.trim("f")) > 1)
    parsed = raw.select(F.from_json("f", "geometry string, properties string").alias("r")).select("r.*")
    sample = parsed.select("properties").where("properties is not null")
    kinds = _properties_schema(sample)
    out = parsed.withColumn("g", F.from_json("geometry", "type string, coordinates string"))
    if kinds is not None:
        out = out.withColumn("p", F.from_json("properties", kinds))
        names = [f.name for f in kinds.fields if f.name.lower() not in ("kind", "coordinates")]
        return out.select(F.col("g.type").alias("kind"), F.col("g.coordinates").alias("coordinates"), *[F.col("p")[n].alias(n) for n in names])
    return out.select(F.col("g.type").alias("kind"), F.col("g.coordinates").alias("coordinates"))


def _properties_schema(sample: DataFrame) -> T.StructType | None:
    """The schema of all properties, from every row; null where there is none. More than MOST_PROPERTIES names are an error."""
    keys = sample.select(F.explode(F.json_object_keys("properties")).alias("k")).distinct()
    names = [r[0] for r in keys.limit(MOST_PROPERTIES + 1).collect()]
    if len(names) > MOST_PROPERTIES:
        raise ValueError(f"more than {MOST_PROPERTIES} different properties; a table can't have a column for each")
    if not names:
        return None
    names.sort()
    kinds = sample.agg(*[_kind_of(n).alias(f"k{i}") for i, n in enumerate(names)]).first()
    types = {0: T.StringType(), 1: T.BooleanType(), 2: T.LongType(), 3: T.DoubleType(), 4: T.StringType()}
    return T.StructType([T.StructField(n, types[k or 0]) for n, k in zip(names, kinds, strict=True)])


def _kind_of(name: str):
    """The widest kind of a property: 1 boolean, 2 whole number, 3 number, 4 text."""
    v = F.get_json_object("properties", "$['" + name.replace("'", "\\'") + "']")
    kind = F.when(v.isNull(), 0).when(v.isin("true", "false"), 1).when(v.rlike(r"^-?[0-9]{1,18}$"), 2).when(v.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), 3).otherwise(4)
    low, high = F.min(F.when(kind > 0, kind)), F.max(kind)
    return F.when((low == 1) & (high > 1), 4).otherwise(high)


def _line(coordinates, kind: str):
    points = F.from_json(coordinates, _COORDINATES[kind])
    to = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    if kind == "LineString":
        return F.array(F.transform(points, to))
    if kind in ("MultiLineString", "Polygon"):
        return F.transform(points, lambda r: F.transform(r, to))
    return F.flatten(F.transform(points, lambda p: F.transform(p, lambda r: F.transform(r, to))))


def read_traces(spark: SparkSession, path: str, network: str = "", lines: bool = False, layer: str | None = None) -> DataFrame:
    """(trace_id, network, pts, parts, properties...): lines of GeoJSON or GeoPackage. pts is null for more than one part. A collection's
    ids follow its order."""
    found = check_kinds(features(spark, path, lines, layer), ("LineString", "MultiLineString"))
    c = F.col("coordinates")
    parts = F.when(F.col("kind") == "LineString", _line(c, "LineString")).when(F.col("kind") == "MultiLineString", _line(c, "MultiLineString"))
    own = [n for n in found.columns if n not in ("kind", "coordinates", "trace_id", "network", "pts", "parts")]
    out = found.select(F.monotonically_increasing_id().alias("trace_id"), F.lit(network or plain_stem(path)).alias("network"), parts.alias("parts"), *own)
    return out.select("trace_id", "network", F.when(F.size("parts") == 1, F.col("parts")[0]).alias("pts"), "parts", *own)


def read_areas(spark: SparkSession, path: str, network: str = "", lines: bool = False, layer: str | None = None) -> DataFrame:
    """(area_id, network, rings, properties...): polygons of GeoJSON or GeoPackage; the rings of several polygons stand together."""
    found = check_kinds(features(spark, path, lines, layer), ("Polygon", "MultiPolygon"))
    c = F.col("coordinates")
    rings = F.when(F.col("kind") == "Polygon", _line(c, "Polygon")).when(F.col("kind") == "MultiPolygon", _line(c, "MultiPolygon"))
    own = [n for n in found.columns if n not in ("kind", "coordinates", "area_id", "network", "rings")]
    return found.select(F.monotonically_increasing_id().alias("area_id"), F.lit(network or plain_stem(path)).alias("network"), rings.alias("rings"), *own)


def plain_stem(path: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "", path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])


def check_kinds(found: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """found, if all its geometries are of accepted types or null."""
    wrong = found.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*accepted)).select("kind").limit(1).collect()
    if wrong:
        raise WrongGeometry(f"expected {' or '.join(accepted)}, not {wrong[0][0]}")
    return found


def check_not_empty(df: DataFrame, label: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{label}: there are no rows")
    return df


def read_wkt(df: DataFrame, column: str = "wkt") -> DataFrame:
    """df with parts (lines or rings) of a WKT column: LINESTRING, MULTILINESTRING, POLYGON, MULTIPOLYGON; z is dropped."""
    text = F.upper(F.trim(F.col(column)))
    paths = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(p):
        v = F.split(F.trim(p), r"\s+")
        return F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))

    return df.withColumn("parts", F.transform(paths, lambda s: F.transform(F.split(s, ","), point)))


def to_wkt(pts: str) -> Column:
    """The WKT of a line column."""
    said = F.transform(pts, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.when(F.size(F.col(pts)) > 0, F.concat(F.lit("LINESTRING ("), F.array_join(said, ", "), F.lit(")"))).otherwise("LINESTRING EMPTY")


# Coordinate systems: a number in the column's metadata, never reprojected


def with_crs(df: DataFrame, column: str, srid: int | None) -> DataFrame:
    return df.withMetadata(column, {"srid": srid} if srid else {})


def crs_of(df: DataFrame, column: str) -> int | None:
    return df.schema[column].metadata.get("srid")


def match_crs(first: DataFrame, second: DataFrame, columns: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """If just one of the two has a coordinate system, the other gets it."""
    a, b = crs_of(first, columns[0]), crs_of(second, columns[1])
    if a and not b:
        return first, with_crs(second, columns[1], a)
    if b and not a:
        return with_crs(first, columns[0], b), second
    return first, second


# Sinks


def _geometry(df: DataFrame, digits: int | None):
    """A GeoJSON geometry of pts, rings, or x and y."""
    number = (lambda v: F.round(v, digits)) if digits is not None else (lambda v: v)
    pair = lambda p: F.array(number(p["x"]), number(p["y"]))
    if "pts" in df.columns:
        return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("pts", pair).alias("coordinates")))
    if "rings" in df.columns:
        return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, pair)).alias("coordinates")))
    if {"x", "y"} <= set(df.columns):
        return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(number(F.col("x")), number(F.col("y"))).alias("coordinates")))
    raise WrongGeometry("no pts, rings, or x and y")


def as_features(df: DataFrame, digits: int | None = None) -> DataFrame:
    """One GeoJSON feature for each row, properties sorted by name; lists become text."""
    own = sorted(c for c in unique_columns(df.columns) if c not in ("pts", "rings", "x", "y", "parts"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [(F.to_json(F.col(f"`{c}`")) if isinstance(kinds[c], T.ArrayType | T.StructType | T.MapType) else F.col(f"`{c}`")).alias(c) for c in own]
    properties = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if own else F.lit("{}")
    return df.select(F.concat(F.lit('{"type": "Feature", "geometry": '), _geometry(df, digits), F.lit(', "properties": '), properties, F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, digits: int | None = None, mode: str = "error") -> None:
    """Newline-delimited GeoJSON features, a file for each task."""
    as_features(df, digits).write.mode(mode).text(path)


def write_collection(df: DataFrame, path: str, digits: int | None = None) -> None:
    """One GeoJSON collection on the driver's disk, for results that a person opens; features are fetched one partition at
    a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for i, row in enumerate(as_features(df, digits).toLocalIterator()):
            f.write((",\n" if i else "\n") + row[0])
        f.write("\n]}\n")


def unique_columns(columns: list[str]) -> list[str]:
    """Columns without those that differ from another one only by case (the lower-case one stays), and without fid."""
    lower = {c for c in columns if c == c.lower()}
    out, seen = [], set()
    for c in columns:
        k = c.lower()
        if k == "fid" or k in seen or (c != k and k in lower):
            continue
        seen.add(k)
        out.append(c)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lines_from(spark: SparkSession, rows: list[tuple[int, str, list[tuple[float, float]]]]) -> DataFrame:
    """A small trace table of Python rows (trace_id, network, vertices)."""
    return spark.createDataFrame([(i, n, [(float(x), float(y)) for x, y in p]) for i, n, p in rows], f"trace_id long, network string, pts {geom.LINE}")


def areas_from(spark: SparkSession, rows: list[tuple[int, str, list[list[tuple[float, float]]]]]) -> DataFrame:
    """A small area table of Python rows (area_id, network, rings)."""
    return spark.createDataFrame([(i, n, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, n, rings in rows], f"area_id long, network string, rings {geom.RINGS}")
