"""Queries of scenes, mosaics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import TILES, tiles
from ..operators import mosaic, projection
from ..registry import query

col, r6 = F.col, lambda c: F.round(c, 6)


def scenes(t):
    """Tiles as scenes on a grid of 30 x 30 places, a tenth of them beyond it."""
    v = F.greatest(F.lit(0), F.floor((col("v") + 0.3) * 100)).cast("bigint")
    return tiles(t).select(col("tile").alias("scene"), F.lit(1).alias("band"), (col("r") + col("tile") % 10 * 3).alias("r"), (col("c") + F.floor(col("tile") / 10) % 10 * 3).alias("c"), v.alias("v"))


def basemap(t):
    b = t.orders.selectExpr("1 band", "o_orderkey % 30 r", "o_custkey % 25 c", "cast(o_totalprice / 1000 as bigint) ref").groupBy("band", "r", "c").agg(F.max("ref").alias("ref"))
    return b.withColumn("ref", F.when(col("c") > 18, F.lit(0)).otherwise(col("ref")))


_SCENES = f"SELECT tile AS scene, r + tile % 10 * 3 AS r, c + tile // 10 % 10 * 3 AS c, greatest(0, CAST(floor((v + 0.3) * 100) AS BIGINT)) AS v FROM ({TILES})"
_MATCHED = f"""WITH s AS ({_SCENES}), ok AS (SELECT * FROM s WHERE v <> 0),
base AS (SELECT r, c, CASE WHEN c > 18 THEN 0 ELSE ref END AS ref FROM (SELECT o_orderkey % 30 AS r, o_custkey % 25 AS c, max(CAST(trunc(o_totalprice / 1000) AS BIGINT)) AS ref FROM orders GROUP BY 1, 2)),
ext AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM base), good AS (SELECT * FROM base WHERE ref <> 0),
box AS (SELECT scene, max(r) < any_value(r0) OR min(r) > any_value(r1) OR max(c) < any_value(c0) OR min(c) > any_value(c1) AS outside FROM ok, ext GROUP BY scene),
under AS (SELECT ok.scene, ref, count(*) AS n FROM ok JOIN good ON good.r = ok.r AND good.c = ok.c GROUP BY 1, 2),
bare AS (SELECT scene FROM box WHERE NOT outside AND scene NOT IN (SELECT scene FROM under)),
refs AS (SELECT * FROM under UNION ALL SELECT scene, ref, n FROM bare, (SELECT ref, count(*) AS n FROM good GROUP BY ref)),
rc AS (SELECT scene, ref, sum(n) OVER (PARTITION BY scene ORDER BY ref) / sum(n) OVER (PARTITION BY scene) AS cdf FROM refs),
ic AS (SELECT scene, v, sum(n) OVER (PARTITION BY scene ORDER BY v) / sum(n) OVER (PARTITION BY scene) AS cdf FROM (SELECT scene, v, count(*) AS n FROM ok GROUP BY 1, 2)),
lk AS (SELECT i.scene, i.v, i.cdf, max(CASE WHEN rc.cdf <= i.cdf THEN rc.cdf END) AS x0, min(CASE WHEN rc.cdf >= i.cdf THEN rc.cdf END) AS x1 FROM ic i JOIN rc ON rc.scene = i.scene GROUP BY ALL),
m AS (SELECT lk.scene, lk.v, CASE WHEN x0 IS NULL THEN f1.ref WHEN x1 IS NULL OR x0 = x1 THEN f0.ref ELSE f0.ref + (lk.cdf - x0) * (f1.ref - f0.ref) / (x1 - x0) END AS matched
 FROM lk LEFT JOIN rc f0 ON f0.scene = lk.scene AND f0.cdf = x0 LEFT JOIN rc f1 ON f1.scene = lk.scene AND f1.cdf = x1),
o AS (SELECT s.scene, s.r, s.c, CASE WHEN s.v = 0 THEN 0.0 WHEN box.outside THEN s.v ELSE coalesce(m.matched, s.v) END AS matched,
 CASE WHEN box.outside THEN 'outside the basemap' WHEN bare.scene IS NOT NULL THEN 'whole basemap' ELSE 'matched' END AS status
 FROM s LEFT JOIN m ON m.scene = s.scene AND m.v = s.v LEFT JOIN box ON box.scene = s.scene LEFT JOIN bare ON bare.scene = s.scene)"""  # fmt: skip


@query("scene_pipeline", f"{_MATCHED} SELECT status, count(DISTINCT scene) AS scenes, round(avg(matched), 6) AS mean FROM o GROUP BY status")
def scene_pipeline(t):
    return mosaic.match_scenes(scenes(t), basemap(t)).groupBy("status").agg(F.countDistinct("scene").alias("scenes"), r6(F.avg("matched")).alias("mean"))


@query("scene_mosaic", f"{_MATCHED} SELECT scene % 4 AS grp, CAST(1 AS INT) AS band, r, c, round(arg_max(CASE WHEN matched <> 0 THEN matched END, scene) FILTER (WHERE matched <> 0), 6) AS matched FROM o GROUP BY scene % 4, r, c")
def scene_mosaic(t):
    m = mosaic.match_scenes(scenes(t), basemap(t)).withColumn("grp", col("scene") % 4)
    return mosaic.mosaicked(m, ["grp"], "matched", "scene").withColumn("matched", r6("matched"))


_G = f"SELECT a.tile, i.i AS tr, j.j AS tc, (i.i + 0.5) * 0.6 + 1 AS y, (j.j + 0.5) * 0.7 AS x FROM (SELECT DISTINCT tile FROM ({TILES})) a, (SELECT unnest(range(10)) AS i) i, (SELECT unnest(range(10)) AS j) j"


@query("warp_nearest", f"SELECT g.tile, g.tr AS r, g.tc AS c, round(t.v, 6) AS v FROM ({_G}) g JOIN ({TILES}) t ON t.tile = g.tile AND t.r = floor(g.y) AND t.c = floor(g.x)")
def warp_nearest(t):
    return mosaic.warped(tiles(t), ["tile"], 10, 10, lambda x, y: (x * 0.7, y * 0.6 + 1)).withColumn("v", r6("v"))


@query("warp_bilinear", f"""SELECT g.tile, g.tr AS r, g.tc AS c, round(sum(t.v * (1 - abs(x - 0.5 - t.c)) * (1 - abs(y - 0.5 - t.r))) / sum((1 - abs(x - 0.5 - t.c)) * (1 - abs(y - 0.5 - t.r))), 6) AS v
FROM ({_G}) g JOIN ({TILES}) t ON t.tile = g.tile AND abs(x - 0.5 - t.c) < 1 AND abs(y - 0.5 - t.r) < 1 GROUP BY 1, 2, 3""")  # fmt: skip
def warp_bilinear(t):
    return mosaic.warped(tiles(t), ["tile"], 10, 10, lambda x, y: (x * 0.7, y * 0.6 + 1), "bilinear").withColumn("v", r6("v"))


def _spline(d):
    return f"CASE WHEN abs({d}) < 1 THEN (4 - 6 * ({d}) * ({d}) + 3 * abs(({d}) * ({d}) * ({d}))) / 6 ELSE pow(2 - abs({d}), 3) / 6 END"


@query("warp_spline", f"""SELECT tile, r, c, round(sum(v * w) / sum(w), 6) AS v FROM (SELECT g.tile, g.tr AS r, g.tc AS c, t.v, ({_spline("x - 0.5 - t.c")}) * ({_spline("y - 0.5 - t.r")}) AS w
FROM ({_G}) g JOIN ({TILES}) t ON t.tile = g.tile AND abs(x - 0.5 - t.c) < 2 AND abs(y - 0.5 - t.r) < 2) GROUP BY 1, 2, 3""")  # fmt: skip
def warp_spline(t):
    return mosaic.warped(tiles(t), ["tile"], 10, 10, lambda x, y: (x * 0.7, y * 0.6 + 1), "spline").withColumn("v", r6("v"))


#: A raster of hundredths of a degree from 140 west, 69.08 north on, copied to an equal-area grid in metres.
_DEGREES, _METRES = [0.01, 0.0, -140.0, 0.0, -0.01, 69.08], [700.0, 0.0, -13508079.0, 0.0, -350.0, 6854300.0]
_BETA = f"asin(y * {2 * projection._K0 / projection.A / projection._QP!r})"
_E2 = projection.E2
_LAT = f"degrees({_BETA} + {_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040!r} * sin(2 * {_BETA}) + {23 * _E2**2 / 360 + 251 * _E2**3 / 3780!r} * sin(4 * {_BETA}) + {761 * _E2**3 / 45360!r} * sin(6 * {_BETA}))"


@query("raster_copy", f"""WITH g AS (SELECT i AS r, j AS c, (j + 0.5) * {_METRES[0]} + ({_METRES[2]}) AS x, (i + 0.5) * {_METRES[4]} + {_METRES[5]} AS y FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(12)) AS j)),
p AS (SELECT r, c, floor((degrees(x / {projection.A * projection._K0!r}) + 140) / 0.01) AS sc, floor(({_LAT} - 69.08) / -0.01) AS sr FROM g
 WHERE (x >= {_METRES[2]} + 500 AND x < {_METRES[2]} + 4000 AND y >= {_METRES[5]} - 2000 AND y < {_METRES[5]} - 100) OR (x >= {_METRES[2]} + 3000 AND x < {_METRES[2]} + 6000 AND y >= {_METRES[5]} - 3500 AND y < {_METRES[5]} - 1000))
SELECT t.tile // 2 AS image, t.tile % 2 AS band, p.r, p.c, round(t.v, 6) AS v FROM p JOIN ({TILES}) t ON t.r = p.sr AND t.c = p.sc WHERE t.tile % 2 = 1""")  # fmt: skip
def raster_copy(t):
    x0, y0 = _METRES[2], _METRES[5]
    cut = t.spark.createDataFrame([(x0 + 500, y0 - 2000, x0 + 4000, y0 - 100), (x0 + 3000, y0 - 3500, x0 + 6000, y0 - 1000)], "cut_x0 double, cut_y0 double, cut_x1 double, cut_y1 double")
    p = tiles(t).select(F.floor(col("tile") / 2).alias("image"), (col("tile") % 2).alias("band"), "r", "c", "v")
    return mosaic.raster_copy(p, ["image"], _DEGREES, _METRES, 12, 12, projection.from_equal_area, [1], cut, cell=1000.0).withColumn("v", r6("v"))


@query("mosaic_report", f"{_MATCHED}, g AS (SELECT scene // 5 % 40 AS grp, scene, any_value(status) AS status FROM o GROUP BY 1, 2) SELECT grp, count(*) AS n, coalesce(string_agg(CAST(scene AS VARCHAR), ',' ORDER BY scene) FILTER (WHERE status LIKE 'outside%'), '') AS failed, CASE WHEN bool_and(status LIKE 'outside%') THEN 'failed' ELSE 'done' END AS status FROM g GROUP BY grp")
def mosaic_report(t):
    m = mosaic.match_scenes(scenes(t), basemap(t)).withColumn("grp", F.floor(col("scene") / 5) % 40)
    return mosaic.report(m, ["grp"]).withColumn("failed", F.array_join(F.col("failed").cast("array<string>"), ","))
