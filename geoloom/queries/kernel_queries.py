"""Queries of components, large morphology, rings, projections and scoring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import CENTROIDS, RECTS, TILES, centroids, rects, tiles
from ..operators import grid, kernels, pixel, projection, vector
from ..operators.ordered import share_drawn, weighted_sample
from ..plans.pipelines import demo_model
from ..registry import ORACLE_SQL, query
from . import grid_queries  # noqa: F401  its SQL is used here
from .stat_queries import _draw
from .vector_queries import corner

col, r6 = F.col, lambda c: F.round(c, 6)
A = ("x0", "y0", "x1", "y1")
_B = f"SELECT tile, r, c, CAST(v > 0.02 AS BIGINT) AS v FROM ({TILES})"


def binary(t, at=0.02):
    return tiles(t).withColumn("v", pixel.above(col("v"), at))


def mosaic(t, at=0.02):
    """Binary tiles laid side by side, 5 x 5 in an image."""
    return binary(t, at).selectExpr("tile div 25 image", "((tile div 5) % 5) * 8 + r r", "(tile % 5) * 8 + c c", "v")


def components(source, by):
    """SQL (by, label, n, n_rings) of the components of set pixels (by, r, c, v), neighbours by an edge. By Euler's formula a component
    of n pixels, e edges between them and q full squares of four has 1 - (n - e + q) holes, and a ring for each and one
    around it."""
    return f"""WITH RECURSIVE b AS (SELECT {by}, r, c, r * 2147483648 + c AS k FROM ({source}) WHERE v > 0),
e AS (SELECT a.{by}, a.k, b.k AS n FROM b a JOIN b ON b.{by} = a.{by} AND abs(a.r - b.r) + abs(a.c - b.c) <= 1),
reach AS (SELECT {by}, k, k AS o FROM b UNION SELECT reach.{by}, reach.k, e.n FROM reach JOIN e ON e.{by} = reach.{by} AND e.k = reach.o),
l AS (SELECT {by}, k, min(o) AS label FROM reach GROUP BY {by}, k),
x AS (SELECT b.{by}, b.r, b.c, l.label, l.k FROM b JOIN l ON l.{by} = b.{by} AND l.k = b.k),
y AS (SELECT x.*, CAST(d.k IS NOT NULL AS INT) + CAST(s.k IS NOT NULL AS INT) AS edges, CAST(d.k IS NOT NULL AND s.k IS NOT NULL AND f.k IS NOT NULL AS INT) AS squares FROM x
 LEFT JOIN x d ON d.{by} = x.{by} AND d.k = x.k + 1 LEFT JOIN x s ON s.{by} = x.{by} AND s.k = x.k + 2147483648 LEFT JOIN x f ON f.{by} = x.{by} AND f.k = x.k + 2147483649),
comp AS (SELECT {by}, label, count(*) AS n, CAST(2 - (count(*) - sum(edges) + sum(squares)) AS INT) AS n_rings, avg(c) + 0.5 AS x, avg(r) + 0.5 AS y FROM y GROUP BY {by}, label)"""  # fmt: skip


@query("polygonize_labels", f"""WITH RECURSIVE b AS (SELECT tile, r, c, r * 2147483648 + c AS k FROM ({_B}) WHERE v = 1),
e AS (SELECT a.tile, a.k, b.k AS n FROM b a JOIN b ON b.tile = a.tile AND abs(a.r - b.r) + abs(a.c - b.c) <= 1),
reach AS (SELECT tile, k, k AS o FROM b UNION SELECT reach.tile, reach.k, e.n FROM reach JOIN e ON e.tile = reach.tile AND e.k = reach.o)
SELECT tile, label, count(*) AS n FROM (SELECT tile, k, min(o) AS label FROM reach GROUP BY tile, k) GROUP BY tile, label""")  # fmt: skip
def polygonize_labels(t):
    lab = kernels.labelled(binary(t).filter("v = 1"), "tile", 8, across=False)
    return lab.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n"))


@query("polygonize_by_chunk", f"""WITH RECURSIVE b AS (SELECT tile, r, c, r * 2147483648 + c AS k FROM ({_B}) WHERE v = 1),
e AS (SELECT a.tile, a.k, b.k AS n FROM b a JOIN b ON b.tile = a.tile AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 AND a.r // 4 = b.r // 4 AND a.c // 4 = b.c // 4),
reach AS (SELECT tile, k, k AS o FROM b UNION SELECT reach.tile, reach.k, e.n FROM reach JOIN e ON e.tile = reach.tile AND e.k = reach.o)
SELECT tile, label, count(*) AS n FROM (SELECT tile, k, min(o) AS label FROM reach GROUP BY tile, k) GROUP BY tile, label""")  # fmt: skip
def polygonize_by_chunk(t):
    lab = kernels.labelled(binary(t).filter("v = 1"), "tile", 4, across=False)
    return lab.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n"))


_MOSAIC = f"SELECT tile // 25 AS image, ((tile // 5) % 5) * 8 + r AS r, (tile % 5) * 8 + c AS c, v FROM ({_B})"


@query("polygonize_across_chunks", f"""WITH RECURSIVE b AS (SELECT image, r, c, r * 2147483648 + c AS k FROM ({_MOSAIC}) WHERE v = 1),
e AS (SELECT a.image, a.k, b.k AS n FROM b a JOIN b ON b.image = a.image AND abs(a.r - b.r) + abs(a.c - b.c) <= 1),
reach AS (SELECT image, k, k AS o FROM b UNION SELECT reach.image, reach.k, e.n FROM reach JOIN e ON e.image = reach.image AND e.k = reach.o)
SELECT image, label, count(*) AS n FROM (SELECT image, k, min(o) AS label FROM reach GROUP BY image, k) GROUP BY image, label""")  # fmt: skip
def polygonize_across_chunks(t):
    _checkpoints(t)
    lab = kernels.labelled(mosaic(t).filter("v = 1"), "image", 8)
    return lab.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))


@query("polygonize_rings", f"SELECT tile, count(*) AS pixels, CAST(count(*) AS DOUBLE) AS area FROM ({_B}) WHERE v = 1 GROUP BY tile")
def polygonize_rings(t):
    p = kernels.polygonised(binary(t), "tile", 8, across=False)
    ring_areas = F.transform("rings", vector.ring_area)
    area = 2 * F.element_at(ring_areas, 1) - F.aggregate(ring_areas, F.lit(0.0), lambda a, x: a + x)  # the outer ring less the holes
    return p.select("tile", "n", area.alias("a")).groupBy("tile").agg(F.sum("n").alias("pixels"), F.sum("a").alias("area"))


_WHOLE = f"SELECT tile, r, c, CASE WHEN v > -0.1 THEN 255 ELSE 0 END AS v FROM ({TILES})"


@query("footprints", components(_WHOLE, "tile") + " SELECT tile, CAST(255 AS BIGINT) AS v, n, n_rings FROM comp")
def footprints(t):
    mask = tiles(t).withColumn("v", F.when(col("v") > -0.1, F.lit(255)).otherwise(F.lit(0)).cast("bigint"))
    return kernels.polygonised(mask, "tile", 8, include_nodata=True, across=False).select("tile", "v", "n", F.size("rings").alias("n_rings"))


def _disc_step(source, agg, radius):
    """One erosion or dilation of images without gaps: the disc's rows are runs, whose extremes are windows along a row."""
    half = {i: max(j for a, j in grid.disc(radius) if a == i) for i in range(-radius, radius + 1)}
    runs = ", ".join(f"{agg}(v) OVER (PARTITION BY image, r ORDER BY c RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS w{w}" for w in sorted(set(half.values())))
    moved = " UNION ALL ".join(f"SELECT image, r + {i} AS r, c, w{w} AS v FROM h" for i, w in half.items())
    return f"(WITH h AS (SELECT image, r, c, {runs} FROM {source}) SELECT m.image, m.r, m.c, {agg}(m.v) AS v FROM ({moved}) m JOIN s0 ON s0.image = m.image AND s0.r = m.r AND s0.c = m.c GROUP BY 1, 2, 3)"


_R6 = ", ".join(f"s{i + 1} AS {_disc_step(f's{i}', agg, 6)}" for i, agg in enumerate(("min", "max", "max", "min")))


@query("morph_open_close_r6", f"WITH s0 AS ({_MOSAIC.replace('0.02', '-0.24')}), {_R6} SELECT image, CAST(sum(v) AS BIGINT) AS ones, count(*) AS n FROM s4 GROUP BY image")
def morph_open_close_r6(t):
    return kernels.open_close_blocks(mosaic(t, -0.24), "image", 6, chunk=16).groupBy("image").agg(F.sum("v").alias("ones"), F.count(F.lit(1)).alias("n"))


@query("morph_blocks_r1", ORACLE_SQL["morph_open_close"])
def morph_blocks_r1(t):
    return kernels.open_close_blocks(binary(t), "tile", 1, chunk=4).select("tile", "r", "c", "v")


@query("convex_hull", f"SELECT id, (x1 - x0) * (y1 - y0) * 0.875 AS hull, round(0.75 / 0.875, 6) AS solidity FROM ({RECTS})")
def convex_hull(t):
    r = rects(t).select("id", corner().alias("ring")).select("id", "ring", kernels.convex_hull("ring").alias("h"))
    return r.select("id", vector.ring_area(col("h")).alias("hull"), r6(vector.ring_area(col("ring")) / vector.ring_area(col("h"))).alias("solidity"))


@query("simplify", f"SELECT id, CAST(7 AS BIGINT) AS n, (x1 - x0) * (y1 - y0) * 0.75 AS area FROM ({RECTS})")
def simplify(t):
    r = rects(t).select("id", corner().alias("g"))
    dense = F.flatten(F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.array(col("g")[i - 1], F.struct(((col("g")[i - 1]["x"] + col("g")[i]["x"]) / 2).alias("x"), ((col("g")[i - 1]["y"] + col("g")[i]["y"]) / 2).alias("y")))))
    s = r.select("id", kernels.simplified(F.concat(dense, F.slice("g", 1, 1)), 0.01).alias("s"))
    return s.select("id", F.size("s").cast("bigint").alias("n"), vector.ring_area(col("s")).alias("area"))


@query("clip_polygons", f"SELECT id, CAST(greatest(0, least(x1, 500) - greatest(x0, 200)) * greatest(0, least(y1, 500) - greatest(y0, 200)) AS DOUBLE) AS area FROM ({RECTS})")
def clip_polygons(t):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    window = F.array(p(200, 200), p(500, 200), p(500, 500), p(200, 500), p(200, 200))
    c = kernels.clipped(vector.rectangle(*A), window)
    return rects(t).select("id", F.when(F.size(c) > 0, vector.ring_area(c)).otherwise(0.0).alias("area"))


@query("validity_filter", f"SELECT id FROM ({RECTS}) WHERE id % 5 <> 0")
def validity_filter(t):
    g = vector.rectangle(*A)
    bow = F.when(col("id") % 5 == 0, F.array(g[0], g[2], g[1], g[3], g[0])).otherwise(g)
    return rects(t).select("id", bow.alias("g")).filter(kernels.is_valid("g")).select("id")


@query("point_in_polygon", f"SELECT id, lon + 140 + lat - 69 < 0.9005 AS inside FROM ({CENTROIDS})")
def point_in_polygon(t):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    triangle = F.array(p(-140.5, 68.5), p(-138.5995, 68.5), p(-140.5, 70.4005), p(-140.5, 68.5))
    return centroids(t).select("id", kernels.contains_point(triangle, col("lon"), col("lat")).alias("inside"))


_EA = f"{projection.A * projection._K0!r}"


@query("equal_area_projection", f"""SELECT id, round(radians(lon) * {_EA}, 3) AS x, round({(1 - projection.E2)!r} * (s / (1 - {projection.E2!r} * s * s) - {1 / (2 * projection.E1)!r} * ln((1 - {projection.E1!r} * s) / (1 + {projection.E1!r} * s))) * {projection.A / (2 * projection._K0)!r}, 3) AS y
FROM (SELECT id, lon, sin(radians(lat)) AS s FROM ({CENTROIDS}))""")  # fmt: skip
def equal_area_projection(t):
    x, y = projection.to_equal_area(col("lon"), col("lat"))
    return centroids(t).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("utm_round_trip", f"SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({CENTROIDS})")
def utm_round_trip(t):
    zone = projection.utm_zone(col("lon"))
    x, y = projection.to_utm(col("lon"), col("lat"), zone)
    p = centroids(t).select("id", zone.alias("zone"), x.alias("x"), y.alias("y"))
    lon, lat = projection.from_utm(col("x"), col("y"), col("zone"))
    return p.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _utm_sql(lon, lat, central):
    """Easting and northing as SQL, by the series of projection.to_utm."""
    k = 2 * math.sqrt(projection.N) / (1 + projection.N)
    t = f"sinh(atanh(sin(radians({lat}))) - {k!r} * atanh({k!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} - ({central}))))", f"atanh(sin(radians({lon} - ({central}))) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(projection.ALPHA, 1)]])
    y = " + ".join([xi, *[f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(projection.ALPHA, 1)]])
    m = projection.SCALE * projection.RADIUS
    return f"500000 + {m!r} * ({x})", f"{m!r} * ({y})"


def _equal_area_sql(lon, lat):
    """The cylindrical equal-area grid as SQL."""
    s, e2, e1 = f"sin(radians({lat}))", projection.E2, projection.E1
    q = f"{1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - {1 / (2 * e1)!r} * ln((1 - {e1!r} * {s}) / (1 + {e1!r} * {s})))"
    return f"radians({lon}) * {_EA}", f"{q} * {projection.A / (2 * projection._K0)!r}"


_SHOELACE = lambda x, y: f"round(abs(sum({x} * next_{y} - next_{x} * {y}) / 2), 1)"


@query("reproject_rings", f"""WITH c AS (SELECT id, k, lon + CASE WHEN k IN (1, 2) THEN 0.01 ELSE 0 END AS lon, lat + CASE WHEN k IN (2, 3) THEN 0.01 ELSE 0 END AS lat FROM ({CENTROIDS}), (SELECT unnest(range(4)) AS k)),
g AS (SELECT id, k, {", ".join(f"{e} AS {n}" for e, n in zip((*_utm_sql("lon", "lat", -141), *_equal_area_sql("lon", "lat")), ("ux", "uy", "ax", "ay"), strict=True))} FROM c),
p AS (SELECT a.*, {", ".join(f"b.{n} AS next_{n}" for n in ("ux", "uy", "ax", "ay"))} FROM g a JOIN g b ON b.id = a.id AND b.k = (a.k + 1) % 4)
SELECT id, {_SHOELACE("ux", "uy")} AS utm_m2, {_SHOELACE("ax", "ay")} AS equal_area_m2 FROM p GROUP BY id""")  # fmt: skip
def reproject_rings(t):
    p = lambda d, e: F.struct((col("lon") + d).alias("x"), (col("lat") + e).alias("y"))
    ring = F.array(p(0, 0), p(0.01, 0), p(0.01, 0.01), p(0, 0.01), p(0, 0))
    utm, flat = projection.reproject(ring, "utm", 7), projection.reproject(ring, "equal_area")
    return centroids(t).select("id", F.round(vector.ring_area(utm), 1).alias("utm_m2"), F.round(vector.ring_area(flat), 1).alias("equal_area_m2"))


@query("batched_inference", "SELECT vec_id AS id, round(1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))), 5) AS p FROM embeddings")
def batched_inference(t):
    p = t.embeddings.select(col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    return kernels.scored(p, demo_model, ["id"]).select("id", F.round(col("scores")[0], 5).alias("p"))


@query("shapes_udtf", f"SELECT id, CAST(k AS BIGINT) AS corner, CAST(CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END AS DOUBLE) AS x, CAST(CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END AS DOUBLE) AS y FROM ({RECTS}), (SELECT unnest([0, 1, 2, 3]) AS k)")
def shapes_udtf(t):
    from pyspark.sql.functions import udtf

    @udtf(returnType="corner bigint, x double, y double")
    class Corners:
        """A row for each corner of a closed ring."""

        def eval(self, ring: list):
            for k, p in enumerate(ring[:-1] if ring else ()):
                yield k, p["x"], p["y"]

    t.spark.udtf.register("geoloom_corners", Corners)
    rects(t).select("id", vector.rectangle(*A).alias("g")).createOrReplaceTempView("geoloom_rings")
    return t.spark.sql("SELECT id, corner, x, y FROM geoloom_rings, LATERAL geoloom_corners(g)")


@query("training_batches", f"""WITH p AS (SELECT tile, r, c, v, CAST(v > 0.02 AS BIGINT) AS label, CASE WHEN v * 5 >= 0.5 THEN 5.0 ELSE 1.0 END AS weight FROM ({TILES})),
f AS (SELECT tile, CAST(1 + sum(label) AS DOUBLE) AS share FROM p GROUP BY tile), u AS (SELECT tile, share, sum(share) OVER (ORDER BY share, tile ROWS UNBOUNDED PRECEDING) AS upto FROM f),
d AS (SELECT id, {_draw(7)} / 4294967296.0 * (SELECT sum(share) FROM f) AS u, CAST(floor({_draw(3)} / 4294967296.0 * 4) AS BIGINT) AS dy, CAST(floor({_draw(4)} / 4294967296.0 * 4) AS BIGINT) AS dx FROM (SELECT unnest(range(128)) AS id))
SELECT d.id // 16 AS batch, d.id AS place, p.tile, p.r - dy AS r, p.c - dx AS c, round(p.v, 6) AS v, p.label, CAST(p.weight AS DOUBLE) AS weight
FROM d JOIN u ON d.u >= u.upto - u.share AND d.u < u.upto JOIN p ON p.tile = u.tile AND p.r BETWEEN dy AND dy + 3 AND p.c BETWEEN dx AND dx + 3""")  # fmt: skip
def training_batches(t):
    """Batches of 16 patches: a frame is drawn in proportion to its labelled pixels, and a place in it."""
    weight = pixel.label_weight(col("v"), col("v") * 5, 5)[1]
    p = tiles(t).withColumn("label", pixel.above(col("v"), 0.02)).withColumn("weight", weight)
    shares = p.groupBy(col("tile").alias("id")).agg((F.sum("label") + 1).cast("double").alias("share"))
    place = lambda seed: F.floor(share_drawn(col("draw_no"), seed) * 4).cast("bigint")
    drawn = weighted_sample(shares, "id", "share", 128).select(F.floor(col("draw_no") / 16).alias("batch"), col("draw_no").alias("place"), col("id").alias("tile"), place(3).alias("dy"), place(4).alias("dx"))
    inside = col("r").between(col("dy"), col("dy") + 3) & col("c").between(col("dx"), col("dx") + 3)
    return p.join(drawn, "tile").filter(inside).select("batch", "place", "tile", (col("r") - col("dy")).alias("r"), (col("c") - col("dx")).alias("c"), r6("v").alias("v"), "label", "weight")


@query("raster_copy_nearest", f"""SELECT t.tile, a.i AS r, b.j AS c, round(t.v, 6) AS v FROM (SELECT unnest(range(9)) AS i) a, (SELECT unnest(range(10)) AS j) b
JOIN ({TILES}) t ON t.r = 1 + CAST(floor((a.i + 0.5) * (6 / 9)) AS BIGINT) AND t.c = 2 + CAST(floor((b.j + 0.5) * (4 / 10)) AS BIGINT)""")  # fmt: skip
def raster_copy_nearest(t):
    w = tiles(t).filter("r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 5")
    return grid.rescaled_nearest(w.withColumns({"r": col("r") - 1, "c": col("c") - 2}), ["tile"], 6, 4, 9, 10, "r", "c", "v").withColumn("v", r6("v"))


def _checkpoints(t):
    """Gives the session a folder for checkpoints where it has none."""
    from ..sources.tables import shared_folder

    shared_folder(t.spark)
