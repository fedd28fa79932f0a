"""GeoPackage layers as GeoJSON features, with the standard library's SQLite.

A file is opened in the memory of one task, so that files are read in parallel and a file has to fit into a task.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of the box in a geometry's header, by the three bits of its flags that name its kind (fixed values).
BOX = (0, 32, 48, 48, 64)
#: Names of the geometry types of well-known binary (fixed values).
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
#: Rows fetched at once.
FETCH = 1000


def read_features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(f): each row of a layer as a GeoJSON feature, z and m dropped. Without a layer, each file must have just one."""

    def rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in files:
            for content in found["content"]:
                for some in features_of(content, layer):
                    yield pd.DataFrame({"f": some})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "f string")


def layers_of(db: sqlite3.Connection) -> list[str]:
    return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def pick_layer(layers: list[str], layer: str | None) -> str:
    """The layer asked for, or the only one."""
    if layer is not None:
        if layer not in layers:
            raise ValueError(f"there is no layer {layer!r}; the layers are {layers}")
        return layer
    if len(layers) != 1:
        raise ValueError(f"name one of the layers {layers}")
    return layers[0]


def features_of(content: bytes, layer: str | None = None) -> Iterator[list[str]]:
    """Features of a file's bytes, by the thousand."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(bytes(content))
        table = pick_layer(layers_of(db), layer)
        column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [table]).fetchone()[0]
        found = db.execute('SELECT * FROM "' + table.replace('"', '""') + '"')
        names = [d[0] for d in found.description]
        while some := found.fetchmany(FETCH):
            yield [_feature(dict(zip(names, r, strict=True)), column) for r in some]
    finally:
        db.close()


def _feature(row: dict, column: str) -> str:
    blob = row.pop(column)
    own = {k: v.hex() if isinstance(v, bytes) else v for k, v in row.items()}
    return json.dumps({"type": "Feature", "geometry": geometry_of(blob) if blob is not None else None, "properties": own})


def geometry_of(blob: bytes) -> dict | None:
    """The GeoJSON geometry of a GeoPackage blob; None for an empty one."""
    if blob[:2] != b"GP":
        raise ValueError("this isn't a GeoPackage geometry")
    flags = blob[3]
    if flags & 16:
        return None
    return _wkb(blob, 8 + BOX[flags >> 1 & 7])[0]


def _wkb(b: bytes, at: int) -> tuple[dict, int]:
    order = "<" if b[at] else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    at += 5
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    if kind & 0x20000000:
        at += 4
    kind &= 0x1FFFFFFF
    dims, kind = dims + (0, 1, 1, 2)[kind // 1000], kind % 1000

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", b, at - 4)[0]

    def points(n: int) -> list[list[float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * dims}d", b, at)
        at += 8 * n * dims
        return [list(flat[i : i + 2]) for i in range(0, len(flat), dims)]

    if kind == 1:
        coordinates = points(1)[0]
    elif kind == 2:
        coordinates = points(count())
    elif kind == 3:
        coordinates = [points(count()) for _ in range(count())]
    elif kind in KINDS:
        parts = []
        for _ in range(count()):
            part, at = _wkb(b, at)
            parts.append(part)
        if kind == 7:
            return {"type": KINDS[kind], "geometries": parts}, at
        coordinates = [p["coordinates"] for p in parts]
    else:
        raise ValueError(f"geometry type {kind} isn't read")
    return {"type": KINDS[kind], "coordinates": coordinates}, at
