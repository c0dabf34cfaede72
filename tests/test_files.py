import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.sources import geopackage as G
from geoloom.sources import tiff as T


def picture(dtype, bands=2, h=70, w=90):
    return np.random.default_rng(1).integers(0, 200, (bands, h, w)).astype(dtype)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
def test_written_files_are_read(dtype):
    a = picture(dtype)
    data = T.write(a, (3.0, 0.0, 500.0, 0.0, -3.0, 9000.0), 32607, 255, tile=32)
    h = T.info(data)
    assert (h.width, h.height, h.bands, h.epsg, h.nodata, h.transform) == (90, 70, 2, 32607, 255.0, (3.0, 0.0, 500.0, 0.0, -3.0, 9000.0))
    assert (T.read(data) == a).all()
    assert (T.read(data, [2], (10, 20, 50, 33)) == a[1:, 20:53, 10:60]).all()
    assert T.read(data, None, (80, 60, 50, 50)).shape == (2, 10, 10)


def lzw(data):
    out, held, have = bytearray(), 0, 0

    def put(code, bits):
        nonlocal held, have
        held, have = held << bits | code, have + bits
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1

    table, w = {bytes([i]): i for i in range(256)}, b""
    size, bits = 258, 9
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w], bits)
        table[w + c] = size
        size += 1
        bits = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size == 4094:
            put(256, bits)
            table, size, bits = {bytes([i]): i for i in range(256)}, 258, 9
        w = c
    if w:
        put(table[w], bits)
        size += 1
        bits = 9 + (size > 511) + (size > 1023) + (size > 2047)
    put(257, bits)
    put(0, 7)
    return bytes(out)


def striped(a, compression, pack, predictor=1, order="<"):
    """An interleaved file in strips of 16 rows."""
    bands, h, w = a.shape
    x = np.moveaxis(a, 0, -1).astype(a.dtype.newbyteorder(order))
    strips = []
    for r in range(0, h, 16):
        s = x[r : r + 16]
        if predictor == 2:
            s = np.concatenate([s[:, :1], np.diff(s, axis=1).astype(s.dtype)], axis=1).astype(s.dtype)
        strips.append(pack(s.tobytes()))
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    fields = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (8 * a.dtype.itemsize,) * bands), (259, 3, (compression,)), (273, 4, offsets), (277, 3, (bands,)), (278, 3, (16,)), (279, 4, [len(s) for s in strips]), (317, 3, (predictor,))]
    head, extra, after = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        p = struct.pack(order + {3: "H", 4: "I"}[kind] * len(v), *v)
        if len(p) > 4:
            place, extra = struct.pack(order + "I", after + len(extra)), extra + p
        else:
            place = p.ljust(4, b"\0")
        head += struct.pack(order + "HHI", tag, kind, len(v)) + place
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"".join(strips) + struct.pack(order + "H", len(fields)) + head + b"\0" * 4 + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_strips_lzw_and_differences(order, predictor):
    a = picture("uint16", 3)
    for compression, pack in ((1, bytes), (5, lzw), (32773, lambda b: b"".join(bytes([0, x]) for x in b))):
        data = striped(a, compression, pack, predictor, order)
        assert (T.read(data) == a).all()
        assert (T.read(data, [3, 1], (5, 30, 10, 10)) == a[[2, 0], 30:40, 5:15]).all()


def test_files_as_tables(spark, tmp_path):
    a = picture("uint16", 2, 40, 50)
    a[0, 3, 4] = 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tif").write_bytes(T.write(a, nodata=0))
    (tmp_path / "in/b.tif").write_bytes(b"II*\0 broken")
    found = {r.path[-5:]: r for r in T.catalog(spark, f"{tmp_path}/in").collect()}
    assert found["a.tif"].height == 40 and found["a.tif"].error is None and found["b.tif"].error
    tiles = T.tiles(spark, f"{tmp_path}/in", size=16)
    assert tiles.filter("error IS NOT NULL").count() == 1
    px = T.pixels(tiles)
    got = np.zeros_like(a)
    for r in px.filter("value IS NOT NULL").collect():
        got[r.band - 1, r.r, r.c] = r.value
    assert (got == a).all() and px.filter("value IS NULL").count() == int((a == 0).sum())
    assert T.pixels(T.tiles(spark, f"{tmp_path}/in", size=16, bands=[2], window=(5, 5, 20, 7))).count() == 140
    out = T.encoded(px.withColumn("raster_id", F.lit("copy.tif")), dtype="uint16")
    assert T.save(out, f"{tmp_path}/out") == 1
    assert (T.read((tmp_path / "out/copy.tif").read_bytes()) == a).all()


def test_geopackages(spark, tmp_path):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]]
    (tmp_path / "x.gpkg").write_bytes(G.geopackage("trees", 32607, [(square, {"area": 1.5}), (square[:1], {"name": "b"})]))
    (tmp_path / "y.gpkg").write_bytes(b"nothing")
    rows = G.read(spark, str(tmp_path)).orderBy("path", "fid").collect()
    assert [(r.layer, r.srid, r.type, [len(p) for p in r.parts or []]) for r in rows] == [("trees", 32607, "Polygon", [2]), ("trees", 32607, "Polygon", [1]), (None, None, None, [])]
    assert [(p.x, p.y) for p in rows[0].parts[0][1]] == square[1] and '"area": 1.5' in rows[0].attributes and rows[2].error


def test_heights_and_collections():
    z = struct.pack("<BIII", 1, 1003, 1, 2) + struct.pack("<6d", 0, 1, 9, 2, 3, 9)
    assert G.parse(z)[:2] == ("Polygon", [[[(0, 1), (2, 3)]]])
    e = struct.pack("<BIII", 1, 0x80000003, 1, 2) + struct.pack("<6d", 0, 1, 9, 2, 3, 9)
    assert G.parse(e)[1] == G.parse(z)[1]
    both = struct.pack("<BII", 1, 7, 2) + struct.pack("<BI2d", 1, 1, 5, 6) + z
    assert G.parse(both)[:2] == ("GeometryCollection", [[[(5, 6)]], [[(0, 1), (2, 3)]]])


def test_a_layer_is_cut_into_files(spark, monkeypatch):
    from geoloom.queries import QUERIES, source_queries
    from geoloom.sources import tables

    sizes = []
    read = tables.decode_files
    monkeypatch.setattr(source_queries, "FILE_FEATURES", 40)
    monkeypatch.setattr(tables, "decode_files", lambda files, decode, schema: sizes.extend(r.n for r in files.selectExpr("length(content) n").collect()) or read(files, decode, schema))
    rows = QUERIES["geopackage_round_trip"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert sum(r.n for r in rows) == n and len(rows) == 7
    assert len(sizes) > n / 40 * 0.9 and max(sizes) < 60_000


def test_files_are_decoded_one_by_one(spark):
    from geoloom.sources import tables

    files = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b"x")), ("c", bytearray())], "path string, content binary").coalesce(1)
    got = tables.decode_files(files, lambda c: [(int(chr(x)),) for x in c], "v int").collect()
    assert sorted((r.path, r.v, r.error is None) for r in got) == [("a", 1, True), ("a", 2, True), ("b", None, False)]


def test_parts_hold_all_rows_once(spark):
    from geoloom.sources import tables

    df = spark.range(1000).selectExpr("id", "if(id < 900, 1, cast(null as int)) g")
    got = tables.parted(df, ["g"], "id", "part", 100).groupBy("g", "part").count().collect()
    assert sum(r["count"] for r in got) == 1000 and sum(r.g == 1 for r in got) == 9 and sum(r.g is None for r in got) == 1
