"""Queries through file formats, and of merged feature files and augmented frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import CENTROIDS, RECTS, TILES, centroids, rects, tiles
from ..operators import kernels, projection, vector
from ..registry import query
from ..sources import geopackage, tables, tiff

col, r6 = F.col, lambda c: F.round(c, 6)
A = ("x0", "y0", "x1", "y1")
#: Features of a written file, about.
FILE_FEATURES = 4_000


@query("geotiff_round_trip", f"SELECT CAST(tile // 25 AS BIGINT) AS image, CAST(((tile // 5) % 5) * 8 + r AS BIGINT) AS r, CAST((tile % 5) * 8 + c AS BIGINT) AS c, round(v, 5) AS v FROM ({TILES}) WHERE ((tile // 5) % 5) * 8 + r BETWEEN 4 AND 33")
def geotiff_round_trip(t):
    px = tiles(t).selectExpr("cast(tile div 25 as string) raster_id", "1 band", "((tile div 5) % 5) * 8 + r r", "(tile % 5) * 8 + c c", "v value")
    files = tiff.encoded(px, nodata=-9999.0).withColumnRenamed("raster_id", "path")

    def decode(content):
        a = tiff.read(content, window=(0, 4, 40, 30))
        return [(r + 4, c, float(v)) for (_, r, c), v in np.ndenumerate(a) if v != -9999]

    back = tables.decode_files(files, decode, "r long, c long, v double")
    return back.select(col("path").cast("bigint").alias("image"), "r", "c", F.round("v", 5).alias("v"))


@query("geopackage_round_trip", f"SELECT CAST(id % 7 AS BIGINT) AS layer, CAST(count(*) AS BIGINT) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area FROM ({RECTS}) GROUP BY 1")
def geopackage_round_trip(t):
    def pack(pdf):
        import pandas as pd

        rows = [([[(p["x"], p["y"]) for p in g]], {"id": int(i)}) for g, i in zip(pdf["g"], pdf["id"], strict=True)]
        return pd.DataFrame({"path": [f"{pdf['layer'].iloc[0]}/{pdf['part'].iloc[0]}"], "content": [geopackage.geopackage("trees", 32607, rows)]})

    # a task holds one file, so a layer is as many files as its features need
    r = rects(t).select("id", (col("id") % 7).alias("layer"), *A)
    files = tables.parted(r, ["layer"], "id", "part", FILE_FEATURES).select("id", "layer", "part", vector.rectangle(*A).alias("g")).groupBy("layer", "part").applyInPandas(pack, "path string, content binary")
    back = tables.decode_files(files, geopackage.features, "layer string, srid int, fid long, type string, parts array<array<array<struct<x:double,y:double>>>>, attributes string")
    area = vector.ring_area(col("parts")[0][0])
    return back.groupBy(F.substring_index("path", "/", 1).cast("bigint").alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"))


@query("merge_features", f"SELECT id, CAST(5 AS BIGINT) AS corners, id % 3 AS source FROM ({CENTROIDS})")
def merge_features(t):
    p = lambda d, e: F.struct((col("lon") + d).alias("x"), (col("lat") + e).alias("y"))
    ring = F.array(p(0, 0), p(0.005, 0), p(0.01, 0), p(0.01, 0.01), p(0, 0.01), p(0, 0))
    layers = [centroids(t).filter(col("id") % 3 == i).select("id", ring.alias("g")) for i in range(3)]
    # each file is simplified before it is projected, in degrees, then measured and joined with the others by name
    done = [tables.described(d.select("id", projection.reproject(kernels.simplified(col("g"), 0.0001), "utm", 7).alias("g")), {"g": "UTM"}).withColumn("source", F.lit(i).cast("bigint")) for i, d in enumerate(layers)]
    merged = tables.union_view(done, "geoloom_merged")
    return merged.withColumn("area", vector.ring_area(col("g"))).filter("area > 0").select("id", F.size("g").cast("bigint").alias("corners"), "source")


@query("augmented_frames")
def augmented_frames(t):
    x = tiles(t).groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("px"))
    return kernels.augmented(x.select("tile", F.transform("px", lambda p: p["v"]).alias("values")), "tile", "values", 8, 8).select("tile", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("raster_bounds", f"SELECT id, round(lon - 0.0015, 6) AS x0, round(lat, 6) AS y1, round(lon + 0.0285, 6) AS x1, round(lat - 0.02, 6) AS y0 FROM ({CENTROIDS})")
def raster_bounds(t):
    c = centroids(t).select("id", (col("lon") - 0.0015).alias("a"), col("lat").alias("b"))
    w, h = F.lit(10.0), F.lit(5.0)
    x1, y0 = col("a") + w * 0.003, col("b") - h * 0.004
    return c.select("id", r6("a").alias("x0"), r6("b").alias("y1"), r6(x1).alias("x1"), r6(y0).alias("y0"))


@query("sql_functions", f"SELECT id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS perimeter, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, x0 < 500 AND 100 < x1 AND y0 < 500 AND 100 < y1 AS inside FROM ({RECTS})")
def sql_functions(t):
    from ..functions import sql

    sql.register(t.spark)
    rects(t).createOrReplaceTempView("geoloom_rects")
    return t.spark.sql("""SELECT id, gl_area(g) AS area, gl_perimeter(g) AS perimeter, round(gl_centroid(g).x, 6) AS cx, round(gl_centroid(g).y, 6) AS cy, gl_overlaps(x0, y0, x1, y1, 100, 100, 500, 500) AS inside
FROM (SELECT *, gl_box(x0, y0, x1, y1) AS g FROM geoloom_rects)""")
