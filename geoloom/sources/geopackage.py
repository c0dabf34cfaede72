"""GeoPackage files and well-known binary geometry, read from and written to bytes."""

from __future__ import annotations

import json
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession

POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTI_POINT: "MultiPoint", MULTI_LINE: "MultiLineString", MULTI_POLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}
#: Bytes of the bounding box in a geometry's header, by the kind of box.
BOX_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def parse(wkb: bytes, at: int = 0) -> tuple[str, list, int]:
    """(type, parts, place after it) of a geometry: a part is a list of rings, a ring a list of (x, y); heights are
    dropped. A collection has the parts of all its members."""
    order = "<" if wkb[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", wkb, at + 1)
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) if code & 0xE0000000 else {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000]
    at += 5 + 4 * bool(code & 0x20000000)
    kind = (code & 0x0FFFFFFF) % 1000

    def points(n: int) -> list:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * dims}d", wkb, at)
        at += 8 * n * dims
        return [(flat[i], flat[i + 1]) for i in range(0, n * dims, dims)]

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", wkb, at - 4)[0]

    if kind == POINT:
        return NAMES[kind], [[points(1)]], at
    if kind == LINE:
        return NAMES[kind], [[points(number())]], at
    if kind == POLYGON:
        return NAMES[kind], [[points(number()) for _ in range(number())]], at
    parts = []
    for _ in range(number()):
        _, p, at = parse(wkb, at)
        parts += p
    return NAMES[kind], parts, at


def polygon_wkb(rings: list) -> bytes:
    """A polygon of rings of (x, y)."""
    body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    return struct.pack("<BII", 1, POLYGON, len(rings)) + body


def features(content: bytes) -> list[tuple]:
    """(layer, srid, fid, type, parts, attributes as JSON) of every feature of a GeoPackage."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    out = []
    for layer, column, srid in con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
        cursor = con.execute(f'SELECT rowid, * FROM "{layer}"')
        names = [d[0] for d in cursor.description][1:]
        place = names.index(column)
        for fid, *values in cursor:
            blob = values[place]
            kind, parts = None, []
            if blob:
                kind, parts, _ = parse(blob, 8 + BOX_BYTES[blob[3] >> 1 & 7])
            rest = {n: v for n, v in zip(names, values, strict=True) if n != column and not isinstance(v, bytes)}
            rings = [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]
            out.append((layer, srid, fid, kind, rings, json.dumps(rest)))
    return out


def geopackage(layer: str, srid: int, rows: list[tuple[list, dict]]) -> bytes:
    """The bytes of a GeoPackage with one layer of polygons: (rings of (x, y), attributes) rows."""
    con = sqlite3.connect(":memory:")
    names = list(dict.fromkeys(k for _, a in rows for k in a))
    con.executescript(
        f"""PRAGMA application_id = 1196444487;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);
INSERT INTO gpkg_spatial_ref_sys VALUES ('EPSG:{int(srid)}', {int(srid)}, 'EPSG', {int(srid)}, 'undefined', NULL);"""
    )
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srid))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
    con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f", \"{n}\"" for n in names)})')
    head = b"GP" + struct.pack("<BBi", 0, 1, srid)
    con.executemany(f'INSERT INTO "{layer}" VALUES (NULL, ?{", ?" * len(names)})', [(head + polygon_wkb(r), *[a.get(n) for n in names]) for r, a in rows])
    con.commit()
    return con.serialize()


def read(spark: SparkSession, folder: str, pattern: str = "*.gpkg") -> DataFrame:
    """(path, error, layer, srid, fid, type, parts, attributes) of the features of all GeoPackages below a folder."""
    from .tables import decode_files

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return decode_files(files, features, "layer string, srid int, fid long, type string, parts array<array<array<struct<x:double,y:double>>>>, attributes string")
