"""GeoTIFF files: a reader of the baseline format with its common extensions, a writer, and their DataFrames.

Read: 8 to 64 bit integers and floats, strips or tiles, planar or interleaved bands, no compression, LZW, deflate or
packed bits, horizontal differences. Written: tiled, deflate. Files come in as (path, content) of Spark's binaryFile
reader, so any store that Spark reads will do; a window decodes only the strips or tiles that it meets.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of tags, sizes of field types, and sample formats of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KIND = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


class TiffError(ValueError):
    """Not a file that can be read here."""


@dataclass(frozen=True)
class Info:
    """What the header says. transform is (a, b, c, d, e, f) with x = a*col + b*row + c and y = d*col + e*row + f."""

    width: int
    height: int
    bands: int
    dtype: str
    block: tuple[int, int]
    compression: int
    predictor: int
    planar: bool
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    transform: tuple[float, ...]
    epsg: int | None
    nodata: float | None


def info(data: bytes) -> Info:
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:1] == b"I" else ">"
    try:
        tags = _tags(data, order)
        tiled = TILES in tags
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        bands = tags.get(SAMPLES, (1,))[0]
        bits, kind = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
        if bits not in (8, 16, 32, 64) or kind not in KIND:
            raise TiffError(f"samples of {bits} bits and format {kind}")
        block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(ROWS, (height,))[0]), width)
        nodata = b"".join(tags[NODATA]).split(b"\0")[0].strip() if NODATA in tags else b""
        return Info(
            width, height, bands, f"{order}{KIND[kind]}{bits // 8}", block, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0] == 2, tiled,
            tuple(tags[TILES if tiled else STRIPS]), tuple(tags[TILE_BYTES if tiled else STRIP_BYTES]), _transform(tags), _epsg(tags), float(nodata) if nodata else None,
        )
    except (KeyError, struct.error, IndexError) as e:
        raise TiffError(f"broken directory: {e!r}") from e


def _tags(data: bytes, order: str) -> dict[int, tuple]:
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in FIELD:
            form = FIELD[kind] * count if len(FIELD[kind]) == 1 else FIELD[kind] * count
            place = at + 10 + 12 * i
            if struct.calcsize("=" + form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(order + form, data, place)
    return tags


def _transform(tags: dict[int, tuple]) -> tuple[float, ...]:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        return (m[0], m[1], m[3], m[4], m[5], m[7])
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINT]
        return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def _epsg(tags: dict[int, tuple]) -> int | None:
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return found.get(PROJECTED_KEY, found.get(GEOGRAPHIC_KEY))


def _lzw(data: bytes) -> bytes:
    out, table, bits, held, have, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < bits:
            continue
        have -= bits
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 256:
            table, bits, last = table[:258], 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            raise TiffError("broken LZW data")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        bits = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def read(data: bytes, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """(bands, rows, columns) of a window (column, row, width, height), which is cut at the borders; bands from 1."""
    h = info(data)
    x, y, w, n = window or (0, 0, h.width, h.height)
    x1, y1, x, y = min(h.width, x + w), min(h.height, y + n), max(0, x), max(0, y)
    chosen = [b - 1 for b in bands] if bands else list(range(h.bands))
    out = np.zeros((len(chosen), max(0, y1 - y), max(0, x1 - x)), np.dtype(h.dtype).newbyteorder("="))
    bh, bw = h.block
    across = -(-h.width // bw)
    down = -(-h.height // bh)
    for plane in range(h.bands if h.planar else 1):
        if h.planar and plane not in chosen:
            continue
        depth = 1 if h.planar else h.bands
        for r in range(y // bh, -(-y1 // bh)):
            for c in range(x // bw, -(-x1 // bw)):
                block = _block(data, h, plane * across * down + r * across + c, bh if h.tiled else min(bh, h.height - r * bh), bw, depth)
                r0, c0 = max(y, r * bh), max(x, c * bw)
                r1, c1 = min(y1, r * bh + block.shape[0]), min(x1, c * bw + bw)
                part = block[r0 - r * bh : r1 - r * bh, c0 - c * bw : c1 - c * bw]
                for k, b in enumerate(chosen):
                    if not h.planar or b == plane:
                        out[k, r0 - y : r1 - y, c0 - x : c1 - x] = part[..., 0 if h.planar else b]
    return out


def _block(data: bytes, h: Info, i: int, rows: int, cols: int, depth: int) -> np.ndarray:
    raw = data[h.offsets[i] : h.offsets[i] + h.sizes[i]]
    if h.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif h.compression == 5:
        raw = _lzw(raw)
    elif h.compression == 32773:
        raw = _unpack_bits(raw)
    elif h.compression != 1:
        raise TiffError(f"compression {h.compression}")
    need = rows * cols * depth
    a = np.frombuffer(raw, h.dtype, min(need, len(raw) // np.dtype(h.dtype).itemsize))
    if len(a) < need:
        raise TiffError("a block is too short")
    a = a.reshape(rows, cols, depth)
    if h.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=np.dtype(h.dtype).newbyteorder("="))
    elif h.predictor != 1:
        raise TiffError(f"predictor {h.predictor}")
    return a


def write(a: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, tile: int = 256) -> bytes:
    """A tiled, deflated file of (bands, rows, columns), bands in planes."""
    bands, height, width = a.shape
    a = a.astype(a.dtype.newbyteorder("<"))
    blocks = []
    for b in range(bands):
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                t = np.zeros((tile, tile), a.dtype)
                part = a[b, r : r + tile, c : c + tile]
                t[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(t.tobytes()))
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[a.dtype.kind]
    starts, at = [], 8
    for x in blocks:
        starts.append(at)
        at += len(x) + len(x) % 2
    fields = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8 * a.dtype.itemsize,) * bands), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (bands,)), (PLANAR, 3, (2,)),
        (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)), (TILES, 4, tuple(starts)), (TILE_BYTES, 4, tuple(map(len, blocks))), (FORMAT, 3, (kind,) * bands),
    ]
    if transform:
        p, q, x, d, e, y = transform
        fields.append((TRANSFORM, 12, (p, q, 0.0, x, d, e, 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if epsg:
        flat = epsg == 4326
        fields.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, GEOGRAPHIC_KEY if flat else PROJECTED_KEY, 0, 1, epsg)))
    if nodata is not None:
        fields.append((NODATA, 2, tuple(bytes([c]) for c in f"{nodata:g}\0".encode())))
    body = b"".join(x + b"\0" * (len(x) % 2) for x in blocks)
    directory, extra, after = [], b"", at + 2 + 12 * len(fields) + 4
    for tag, k, v in sorted(fields):
        packed = struct.pack("<" + FIELD[k] * len(v), *v)
        if len(packed) > 4:
            place = struct.pack("<I", after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        directory.append(struct.pack("<HHI", tag, k, len(v)) + place)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + b"".join(directory) + b"\0\0\0\0" + extra


# ---- DataFrames ----


def catalog(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, error, width, height, bands, dtype, transform, epsg, nodata) of the files below a folder."""
    from .tables import decode_files

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def decode(content: bytes) -> list[tuple]:
        h = info(content)
        return [(h.width, h.height, h.bands, np.dtype(h.dtype).name, list(h.transform), h.epsg, h.nodata)]

    return decode_files(files, decode, "width int, height int, bands int, dtype string, transform array<double>, epsg int, nodata double")


def tiles(spark: SparkSession, folder: str, pattern: str = "*.tif", size: int = 256, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, error, band, row_off, col_off, h, w, data) of the files' tiles; nodata is null in data. Tiles are decoded
    one at a time, so a task holds a file's bytes and one tile."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(frames):
        import pandas as pd

        columns = ["path", "error", "band", "row_off", "col_off", "h", "w", "data"]
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    data = bytes(content)
                    h = info(data)
                    x, y, w, n = window or (0, 0, h.width, h.height)
                    for r in range(max(0, y), min(h.height, y + n), size):
                        for c in range(max(0, x), min(h.width, x + w), size):
                            a = read(data, bands, (c, r, min(size, x + w - c), min(size, y + n - r)))
                            for k, b in enumerate(bands or range(1, h.bands + 1)):
                                v = a[k].astype(float).ravel()
                                values = [None if (h.nodata is not None and q == h.nodata) or q != q else q for q in v.tolist()]
                                yield pd.DataFrame([(path, None, b, r, c, a.shape[1], a.shape[2], values)], columns=columns)
                except (TiffError, zlib.error) as e:
                    yield pd.DataFrame([(path, str(e), None, None, None, None, None, None)], columns=columns).astype({c: object for c in columns})

    return files.mapInPandas(run, "path string, error string, band int, row_off int, col_off int, h int, w int, data array<double>")


def pixels(tile_rows: DataFrame) -> DataFrame:
    """(raster_id, band, r, c, value) of tiles: a raster table."""
    flat = tile_rows.filter("error IS NULL").select(F.col("path").alias("raster_id"), "band", "row_off", "col_off", "w", F.posexplode("data").alias("k", "value"))
    return flat.select("raster_id", "band", (F.col("row_off") + F.floor(F.col("k") / F.col("w"))).alias("r"), (F.col("col_off") + F.col("k") % F.col("w")).alias("c"), "value")


def encoded(df: DataFrame, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float = 0.0, dtype: str = "float32") -> DataFrame:
    """(raster_id, content) of a raster table: a file for each raster, made in one task; pixels that aren't there are
    nodata."""
    def run(pdf):
        import pandas as pd

        bands = sorted(pdf["band"].unique())
        a = np.full((len(bands), int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), nodata, dtype)
        v = pdf["value"].to_numpy(float)
        a[np.searchsorted(bands, pdf["band"]), pdf["r"], pdf["c"]] = np.where(np.isnan(v), nodata, v).astype(dtype)
        return pd.DataFrame({"raster_id": [pdf["raster_id"].iloc[0]], "content": [write(a, transform, epsg, nodata)]})

    return df.groupBy("raster_id").applyInPandas(run, "raster_id string, content binary")


def save(files: DataFrame, folder: str, name: str = "raster_id", content: str = "content") -> int:
    """Writes (name, content) rows as files, one at a time, to any store that Spark writes; returns their number."""
    spark, n = files.sparkSession, 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in files.select(name, content).toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row[0]}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytes(row[1]))
        out.close()
        n += 1
    return n
