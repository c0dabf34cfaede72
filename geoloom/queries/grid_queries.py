"""Queries of grids, patches, resampling and density maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CENTROIDS, PIXELS, RECTS, TILES, centroids, frames, pixels, rects, tiles
from ..operators import grid, pixel, vector
from ..registry import query

col, r6 = F.col, lambda c: F.round(c, 6)
IMAGES = "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(100 + p_size * 7 AS BIGINT) AS w, CAST(80 + p_size * 5 AS BIGINT) AS h FROM part"


def images(t):
    return frames(t).selectExpr("id", "100 + area * 7 as w", "80 + area * 5 as h")


@query("chunk_grid", f"""SELECT id, CAST(i * ceil(w / 5) AS BIGINT) AS col_off, CAST(j * ceil(h / 3) AS BIGINT) AS row_off, CAST(ceil(w / 5) AS BIGINT) AS cw, CAST(ceil(h / 3) AS BIGINT) AS ch
FROM ({IMAGES}), (SELECT unnest(range(5)) AS i), (SELECT unnest(range(3)) AS j)""")  # fmt: skip
def chunk_grid(t):
    sized = images(t).withColumnsRenamed({"w": "width", "h": "height"})
    return grid.chunk_grid(sized, "width", "height", 5, 3).select("id", "col_off", "row_off", col("w").alias("cw"), col("h").alias("ch"))


@query("patch_offsets", f"SELECT id, x, y, CAST((x // 112) * CAST(ceil(h / 112.0) AS BIGINT) + y // 112 AS BIGINT) AS ord FROM (SELECT id, h, unnest(range(0, w, 112)) AS x FROM ({IMAGES})) a, LATERAL (SELECT unnest(range(0, a.h, 112)) AS y)")
def patch_offsets(t):
    return grid.patches(images(t), "w", "h", 128, 112).select("id", "x", "y", "ord")


@query("seq_patches", f"SELECT id, x, y FROM (SELECT id, h, unnest(CASE WHEN w <= 128 THEN [0] ELSE range(0, w - 128, 96) END) AS x FROM ({IMAGES})) a, LATERAL (SELECT unnest(CASE WHEN a.h <= 128 THEN [0] ELSE range(0, a.h - 128, 96) END) AS y)")
def seq_patches(t):
    return grid.patches(images(t), "w", "h", 128, 96, sequential=True).select("id", "x", "y")


@query("batch_assembly", f"""WITH p AS (SELECT id, w, h, x, y, CAST((x // 112) * CAST(ceil(h / 112.0) AS BIGINT) + y // 112 AS BIGINT) AS ord FROM (SELECT id, w, h, unnest(range(0, w, 112)) AS x FROM ({IMAGES})) a, LATERAL (SELECT unnest(range(0, a.h, 112)) AS y)),
n AS (SELECT *, row_number() OVER (ORDER BY id, ord) - 1 AS rn FROM p) SELECT rn // 50 AS batch, count(*) AS n, min(id) AS first, max(id) AS last, CAST(sum(least(128, w - x) * least(128, h - y)) AS BIGINT) AS pixels FROM n GROUP BY 1""")  # fmt: skip
def batch_assembly(t):
    from ..operators.ordered import row_numbers

    # patches in order, fifty to a batch; what a patch has of its image, the rest is padded
    p = row_numbers(grid.patches(images(t), "w", "h", 128, 112), "id", ["ord"], "rn").withColumn("batch", F.floor((col("rn") - 1) / 50))
    own = F.least(F.lit(128), col("w") - col("x")) * F.least(F.lit(128), col("h") - col("y"))
    return p.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum(own).alias("pixels"))


@query("pad_edge", f"""SELECT a.tile, a.r, a.c, round(coalesce(b.v, 0), 6) AS v FROM (SELECT tile, r, c FROM (SELECT DISTINCT tile FROM ({TILES})), (SELECT unnest(range(10)) AS r), (SELECT unnest(range(10)) AS c)) a
LEFT JOIN ({TILES}) b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c""")  # fmt: skip
def pad_edge(t):
    return grid.padded(tiles(t), ["tile"], 10, "r", "c", "v").withColumn("v", r6("v"))


#: Tiles as overlapping patches of an image of 5 x 5 patches with stride 4.
PATCHED = f"SELECT tile // 25 AS image, (tile % 5) * 4 + c AS x, ((tile // 5) % 5) * 4 + r AS y, (tile % 5) * 5 + (tile // 5) % 5 AS ord, v FROM ({TILES})"


def patched(t):
    return tiles(t).selectExpr("tile div 25 image", "(tile % 5) * 4 + c x", "((tile div 5) % 5) * 4 + r y", "(tile % 5) * 5 + (tile div 5) % 5 ord", "v")


for _name, _sql in {
    "max": "greatest(0, max(v))",
    "min": "least(1, min(v))",
    "mean": "list_reduce(list_prepend(0.0, list(v ORDER BY ord)), lambda a, b: (a + b) / 2)",
    "replace": "arg_max(v, ord)",
}.items():

    def _combined(t, how=_name.upper()):
        return patched(t).groupBy("image", "x", "y").agg(r6(grid.combine(how, "v", "ord")).alias("v"))

    query(f"patch_combine_{_name}", f"SELECT image, x, y, round({_sql}, 6) AS v FROM ({PATCHED}) GROUP BY image, x, y")(_combined)


@query("max_merge", f"SELECT image, x, y, round(max(v), 6) AS v FROM ({PATCHED}) GROUP BY image, x, y")
def max_merge(t):
    return patched(t).groupBy("image", "x", "y").agg(r6(F.max("v")).alias("v"))


@query("overlay_last", f"SELECT image, x, y, round(arg_max(v, ord), 6) AS v FROM (SELECT * FROM ({PATCHED}) WHERE (x + y + ord) % 4 <> 0) GROUP BY image, x, y")
def overlay_last(t):
    p = patched(t).withColumn("v", F.when((col("x") + col("y") + col("ord")) % 4 == 0, F.lit(-1.0e9)).otherwise(col("v")))
    return p.groupBy("image", "x", "y").agg(r6(grid.overlay_last("v", "ord", -1.0e9)).alias("v")).filter("v IS NOT NULL")


@query("rescale_nearest", f"""SELECT t.tile, a.i AS r, b.j AS c, round(t.v, 6) AS v FROM (SELECT unnest(range(12)) AS i) a, (SELECT unnest(range(5)) AS j) b
JOIN ({TILES}) t ON t.r = CAST(floor((a.i + 0.5) * (8 / 12)) AS BIGINT) AND t.c = CAST(floor((b.j + 0.5) * (8 / 5)) AS BIGINT)""")  # fmt: skip
def rescale_nearest(t):
    return grid.rescaled_nearest(tiles(t), ["tile"], 8, 8, 12, 5, "r", "c", "v").withColumn("v", r6("v"))


@query("upsample_bilinear", f"""WITH ax AS (SELECT i, p, greatest(0, 1 - abs(least(greatest((i + 0.5) / 2 - 0.5, 0), 7) - p)) AS w FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(8)) AS p))
SELECT t.tile, a.i AS r, b.i AS c, round(sum(t.v * a.w * b.w), 6) AS v FROM ({TILES}) t JOIN ax a ON a.p = t.r AND a.w > 0 JOIN ax b ON b.p = t.c AND b.w > 0 GROUP BY 1, 2, 3""")  # fmt: skip
def upsample_bilinear(t):
    return grid.upsampled_bilinear(tiles(t), ["tile"], 8, 8, 2, "r", "c", "v").withColumn("v", r6("v"))


@query("cover_map", f"SELECT tile, r // 4 AS cy, c // 4 AS cx, round(avg(CASE WHEN v > 0.02 THEN 1.0 ELSE 0.0 END) * 100, 6) AS cover FROM ({TILES}) GROUP BY 1, 2, 3")
def cover_map(t):
    b = tiles(t).withColumn("b", pixel.above(col("v"), 0.02))
    return b.groupBy("tile", grid.coarse(col("r"), 4).alias("cy"), grid.coarse(col("c"), 4).alias("cx")).agg(r6(F.avg("b") * 100).alias("cover"))


@query("central_latitude", f"SELECT round((min(lat) + max(lat)) / 2, 6) AS lat FROM ({CENTROIDS})")
def central_latitude(t):
    return centroids(t).agg(r6((F.min("lat") + F.max("lat")) / 2).alias("lat"))


@query("global_extent", f"SELECT CAST(x0 % 4 AS BIGINT) AS layer, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({RECTS}) GROUP BY 1")
def global_extent(t):
    return rects(t).groupBy((col("x0") % 4).alias("layer")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


LIMITS = [3.0, 15.0, 50.0, 200.0]
_CLASS = " + ".join(f"CASE WHEN area >= {x} THEN 1 ELSE 0 END" for x in LIMITS)


@query("area_class_bands", f"SELECT CAST({_CLASS} AS BIGINT) AS class, count(*) AS n, round(sum(area), 4) AS area FROM ({CENTROIDS}) GROUP BY 1")
def area_class_bands(t):
    return centroids(t).groupBy(vector.area_class(col("area"), LIMITS).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("area"))


@query("density_map", f"""WITH e AS (SELECT (min(lat) + max(lat)) / 2 AS mid FROM ({CENTROIDS})), p AS (SELECT area, lon, lat, 2000 / (cos(radians(abs(mid))) * 111320) AS dx, 2000 / 110540.0 AS dy FROM ({CENTROIDS}), e)
SELECT CAST(floor(lon / dx) AS BIGINT) AS cx, CAST(floor(lat / dy) AS BIGINT) AS cy, round(count(*) * 0.0025, 6) AS n_all,
{", ".join(f"round(count(CASE WHEN ({_CLASS}) = {i} THEN 1 END) * 0.0025, 6) AS n_{i}" for i in range(1, 5))} FROM p GROUP BY 1, 2""")  # fmt: skip
def density_map(t):
    p = centroids(t)
    mid = p.agg(((F.min("lat") + F.max("lat")) / 2).alias("mid"))  # one row
    dx, dy = pixel.metres_to_degrees(F.lit(2000.0), F.lit(2000.0), col("mid"))
    p = p.crossJoin(F.broadcast(mid)).select(F.floor(col("lon") / dx).alias("cx"), F.floor(col("lat") / dy).alias("cy"), vector.area_class(col("area"), LIMITS).alias("k"))
    burn = 10000 / 2000**2
    return p.groupBy("cx", "cy").agg(r6(F.count(F.lit(1)) * burn).alias("n_all"), *[r6(F.count_if(col("k") == i) * burn).alias(f"n_{i}") for i in range(1, 5)])


@query("density_map_tile_local", f"""WITH o AS (SELECT id, lon, lat, id % 3 AS tile FROM ({CENTROIDS})), e AS (SELECT tile, min(lon) AS x0, max(lat) AS y1 FROM o GROUP BY tile),
d AS (SELECT o.tile, CAST(floor((lon - x0) / 0.05) AS BIGINT) AS cx, CAST(floor((y1 - lat) / 0.05) AS BIGINT) AS cy, count(*) AS n FROM o JOIN e ON o.tile = e.tile GROUP BY 1, 2, 3)
SELECT cx, cy, arg_max(n, tile) AS n FROM d GROUP BY cx, cy""")  # fmt: skip
def density_map_tile_local(t):
    o = centroids(t).withColumn("tile", col("id") % 3)
    e = o.groupBy("tile").agg(F.min("lon").alias("x0"), F.max("lat").alias("y1"))
    d = o.join(e, "tile").groupBy("tile", F.floor((col("lon") - col("x0")) / 0.05).alias("cx"), F.floor((col("y1") - col("lat")) / 0.05).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("cx", "cy").agg(grid.overlay_last("n", "tile").alias("n"))


_OFF = "(VALUES " + ", ".join(f"({i}, {j})" for i, j in grid.disc(1)) + ") AS o(i, j)"


def _step(source, agg):
    return f"(SELECT a.tile, a.r, a.c, {agg}(b.v) AS v FROM {source} a, {_OFF} JOIN {source} b ON b.tile = a.tile AND b.r = a.r + o.i AND b.c = a.c + o.j GROUP BY 1, 2, 3)"


@query("morph_open_close", f"""WITH s0 AS (SELECT tile, r, c, CAST(v > 0.02 AS BIGINT) AS v FROM ({TILES})), s1 AS {_step("s0", "min")}, s2 AS {_step("s1", "max")}, s3 AS {_step("s2", "max")}, s4 AS {_step("s3", "min")}
SELECT tile, r, c, v FROM s4""")  # fmt: skip
def morph_open_close(t):
    return grid.open_close(tiles(t).withColumn("v", pixel.above(col("v"), 0.02)), ["tile"], 1).select("tile", "r", "c", "v")


@query("flip_augmentation", f"SELECT tile, r, 7 - c AS c, round(v, 6) AS v FROM ({TILES}) WHERE tile % 2 = 0 UNION ALL SELECT tile, 7 - r AS r, c, round(v, 6) AS v FROM ({TILES}) WHERE tile % 2 = 1")
def flip_augmentation(t):
    x, even = tiles(t), col("tile") % 2 == 0
    return x.select("tile", F.when(even, col("r")).otherwise(7 - col("r")).alias("r"), F.when(even, 7 - col("c")).otherwise(col("c")).alias("c"), r6("v").alias("v"))


@query("grid_by_years", f"SELECT r, c, y, round(p, 6) AS p FROM (SELECT r, c, y FROM (SELECT DISTINCT r, c FROM ({PIXELS})), (SELECT unnest([2019, 2021, 2023]) AS y)) g LEFT JOIN ({PIXELS}) USING (r, c, y)")
def grid_by_years(t):
    p = pixels(t)
    full = p.select("r", "c").distinct().select("r", "c", F.explode(F.array(*[F.lit(y).cast("bigint") for y in (2019, 2021, 2023)])).alias("y"))
    return full.join(p, ["r", "c", "y"], "left").select("r", "c", "y", r6("p").alias("p"))
