"""Queries of pixel expressions and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AREAS, BANDS, CENTROIDS, GROUPS, PIXELS, TILES, areas, bands, centroids, groups, pixels, tiles
from ..operators import metrics, pixel
from ..registry import query

col, r6 = F.col, lambda c: F.round(c, 6)


@query("yearly_presence", f"""WITH px AS ({PIXELS}), a AS (SELECT r, c, avg(CASE WHEN m <> 0 THEN p END) AS mean, count(CASE WHEN m <> 0 THEN p END) AS n_obs FROM px GROUP BY r, c)
SELECT r, c, round(mean, 6) AS mean, n_obs, CAST(coalesce(mean >= 0.6 AND n_obs > 1, false) AS BIGINT) AS presence FROM a""")  # fmt: skip
def yearly_presence(t):
    return pixel.yearly(pixels(t), ["r", "c"], mode="presence").withColumn("mean", r6("mean"))


@query("yearly_valid", f"""WITH px AS ({PIXELS}) SELECT r, c, round(avg(CASE WHEN m <> 0 THEN p END), 6) AS mean, count(CASE WHEN m <> 0 THEN p END) AS n_obs,
CAST(count(CASE WHEN m <> 0 THEN p END) > 0 AS BIGINT) AS valid FROM px GROUP BY r, c""")  # fmt: skip
def yearly_valid(t):
    return pixel.yearly(pixels(t), ["r", "c"]).withColumn("mean", r6("mean"))


@query("validity_mask", f"SELECT r, c, y, CAST(m <> 0 AS BIGINT) AS valid FROM ({PIXELS})")
def validity_mask(t):
    return pixels(t).select("r", "c", "y", (col("m") != 0).cast("bigint").alias("valid"))


@query("windowed_read", f"SELECT tile, r, c, round(v, 6) AS v FROM ({TILES}) WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 4")
def windowed_read(t):
    return tiles(t).filter("r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 4").select("tile", "r", "c", r6("v").alias("v"))


@query("ndvi", f"""SELECT id, round(CAST(nir - red AS DOUBLE) / nullif(nir + red, 0), 6) AS ndvi, round(CAST(nir - red AS DOUBLE) / nullif((nir + red) % 65536, 0), 6) AS ndvi_wrapped FROM ({BANDS})""")
def ndvi(t):
    return bands(t).select("id", r6(pixel.ndvi(col("red"), col("nir"))).alias("ndvi"), r6(pixel.ndvi(col("red"), col("nir"), True)).alias("ndvi_wrapped"))


@query("ndvi_uint16", f"""WITH b AS (SELECT id, CAST(nir - red AS DOUBLE) / nullif(nir + red, 0) AS v FROM ({BANDS}))
SELECT id, CAST(trunc(least(greatest(v * 10000, -10000), 10000) + 10000) AS BIGINT) AS ndvi FROM b""")  # fmt: skip
def ndvi_uint16(t):
    return bands(t).select("id", pixel.ndvi_uint16(pixel.ndvi(col("red"), col("nir"))).alias("ndvi"))


@query("append_band", f"""WITH b AS (SELECT id, red, nir, CAST(trunc(least(greatest(CAST(nir - red AS DOUBLE) / nullif(nir + red, 0) * 10000, -10000), 10000) + 10000) AS BIGINT) AS x FROM ({BANDS}))
SELECT id, CAST(k AS BIGINT) AS band, CASE k WHEN 1 THEN red WHEN 2 THEN nir ELSE x END AS value FROM b, (SELECT unnest([1, 2, 3]) AS k)""")  # fmt: skip
def append_band(t):
    b = bands(t)
    stack = F.array("red", "nir", pixel.ndvi_uint16(pixel.ndvi(col("red"), col("nir"))))
    return b.select("id", F.posexplode(stack).alias("band", "value")).withColumn("band", (col("band") + 1).cast("bigint"))


@query("dem_encode", """WITH h AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE CAST(c_acctbal AS DOUBLE) / 100 END AS h FROM customer)
SELECT id, CAST(CASE WHEN isnan(h) THEN 0 ELSE trunc(greatest(h, 0.1) * 10) END AS BIGINT) AS dem FROM h""")  # fmt: skip
def dem_encode(t):
    h = t.customer.selectExpr("c_custkey id", "case when c_custkey % 17 = 0 then double('NaN') else cast(c_acctbal as double) / 100 end h")
    return h.select("id", pixel.dem_encode(col("h")).alias("dem"))


@query("dem_mask", f"SELECT id, CASE WHEN red % 5 = 0 THEN 0 ELSE nir END AS dem FROM ({BANDS})")
def dem_mask(t):
    return bands(t).select("id", pixel.masked_by_band(col("nir"), col("red") % 5).alias("dem"))


@query("ndvi_masked_dem", f"""SELECT id % 50 AS raster, round(coalesce(avg(CASE WHEN red < 10000 THEN nir END), 0), 6) AS mean_dem FROM ({BANDS}) GROUP BY 1""")
def ndvi_masked_dem(t):
    return bands(t).groupBy((col("id") % 50).alias("raster")).agg(r6(F.coalesce(F.avg(F.when(col("red") < 10000, col("nir"))), F.lit(0.0))).alias("mean_dem"))


@query("threshold_mask", f"SELECT r, c, y, CAST(p >= 0.5 AS BIGINT) AS mask, CAST(p > 0.5 AS BIGINT) AS strict FROM ({PIXELS})")
def threshold_mask(t):
    return pixels(t).select("r", "c", "y", pixel.threshold(col("p"), 0.5).alias("mask"), pixel.above(col("p")).alias("strict"))


@query("nodata_to_zero", f"""SELECT id, CAST(CASE WHEN id % 13 = 0 THEN 0 ELSE trunc(area) END AS BIGINT) AS v FROM ({AREAS})""")
def nodata_to_zero(t):
    a = areas(t).withColumn("area", F.when(col("id") % 13 == 0, F.lit(float("nan"))).otherwise(col("area")))
    return a.select("id", pixel.to_integer(col("area")).alias("v"))


@query("mask_values", f"SELECT id, CASE WHEN red % 10 IN (2, 5, 7) THEN 0 ELSE red % 10 END AS v, round(nir * 0.0001, 6) AS scaled FROM ({BANDS})")
def mask_values(t):
    return bands(t).select("id", pixel.without_values(col("red") % 10, [2, 5, 7]).alias("v"), r6(col("nir") * 0.0001).alias("scaled"))


@query("label_weight", f"SELECT tile, r, c, CAST(v >= 0.5 OR v * 4 >= 0.5 AS BIGINT) AS label, CASE WHEN v * 5 >= 0.5 THEN 5.0 ELSE 1.0 END AS weight FROM ({TILES})")
def label_weight(t):
    x = tiles(t)
    label, weight = pixel.label_weight(col("v") * 4, col("v") * 5, 5)
    return x.select("tile", "r", "c", label.alias("label"), weight.alias("weight"))


@query("standardize", f"SELECT id, round((v - avg(v) OVER (PARTITION BY first)) / (stddev_pop(v) OVER (PARTITION BY first) + 1e-8), 6) AS z FROM ({GROUPS})")
def standardize(t):
    return pixel.standardised(groups(t), "v", ["first"], "z").select("id", r6("z").alias("z"))


@query("normalize_nodata", f"""WITH v AS (SELECT tile, r, c, CASE WHEN (r + c + tile) % 7 <> 0 THEN v END AS v FROM ({TILES}))
SELECT tile, r, c, round((v - avg(v) OVER (PARTITION BY tile)) / (stddev_pop(v) OVER (PARTITION BY tile) + 1e-8), 5) AS z FROM v""")  # fmt: skip
def normalize_nodata(t):
    x = tiles(t).withColumn("v", F.when((col("r") + col("c") + col("tile")) % 7 == 0, F.lit(-9999.0)).otherwise(col("v")))
    return pixel.standardised(x, "v", ["tile"], "z", nodata=-9999.0).select("tile", "r", "c", F.round("z", 5).alias("z"))


@query("normalize_bands", f"""WITH v AS (SELECT tile // 2 AS image, tile % 2 AS band, r, c, CASE WHEN (r + c + tile) % 7 <> 0 THEN v END AS v FROM ({TILES})),
w AS (SELECT image, band, r, c, CASE WHEN count(v) OVER (PARTITION BY image, r, c) = count(*) OVER (PARTITION BY image, r, c) THEN v END AS v FROM v)
SELECT image, band, r, c, round((v - avg(v) OVER (PARTITION BY image, band)) / (stddev_pop(v) OVER (PARTITION BY image, band) + 1e-8), 5) AS z FROM w""")  # fmt: skip
def normalize_bands(t):
    x = tiles(t).withColumn("v", F.when((col("r") + col("c") + col("tile")) % 7 == 0, F.lit(-9999.0)).otherwise(col("v")))
    x = x.select(F.floor(col("tile") / 2).alias("image"), (col("tile") % 2).alias("band"), "r", "c", "v")
    return pixel.standardised_bands(x, ["image"], ["r", "c"], "band", "v", "z", -9999.0).select("image", "band", "r", "c", F.round("z", 5).alias("z"))


@query("metres_degrees", f"SELECT id, round(100 / (cos(radians(abs(lat))) * 111320), 9) AS dx, round(100 / 110540.0, 9) AS dy, round(0.001 * cos(radians(abs(lat))) * 111320, 6) AS mx, round(0.001 * 110540, 6) AS my FROM ({CENTROIDS})")
def metres_degrees(t):
    dx, dy = pixel.metres_to_degrees(F.lit(100.0), F.lit(100.0), col("lat"))
    mx, my = pixel.degrees_to_metres(F.lit(0.001), F.lit(0.001), col("lat"))
    return centroids(t).select("id", F.round(dx, 9).alias("dx"), F.round(dy, 9).alias("dy"), r6(mx).alias("mx"), r6(my).alias("my"))


@query("unit_conversion", f"SELECT id, round(area / 10000, 6) AS hectares, round(area / 1000000, 6) AS km2, round(area / nullif(dist, 0) * 100, 4) AS percent, round(ln(area + 0.000001), 6) AS log_area FROM ({AREAS})")
def unit_conversion(t):
    a = col("area")
    return areas(t).select("id", r6(a / 10000).alias("hectares"), r6(a / 1e6).alias("km2"), F.round(F.try_divide(a, col("dist")) * 100, 4).alias("percent"), r6(F.log(a + 1e-6)).alias("log_area"))


@query("pseudo_radius", f"SELECT id, round(sqrt(area / pi()), 6) AS radius_m, round(sqrt(area / pi()) / 3, 6) AS radius_px, round(area / 9, 6) AS area_px FROM ({AREAS})")
def pseudo_radius(t):
    radius = F.sqrt(col("area") / F.pi())
    return areas(t).select("id", r6(radius).alias("radius_m"), r6(radius / 3).alias("radius_px"), r6(col("area") / 9).alias("area_px"))


@query("affine_pixels", f"SELECT id, round((lon + 140) / 0.003, 6) AS px, round((lat - 70) / -0.003, 6) AS py, round(-140 + 0.003 * (id % 100), 6) AS x, round(70 - 0.003 * (id % 100), 6) AS y FROM ({CENTROIDS})")
def affine_pixels(t):
    transform = [0.003, 0.0, -140.0, 0.0, -0.003, 70.0]
    px, py = pixel.world_to_pixel(col("lon"), col("lat"), transform)
    x, y = pixel.pixel_to_world(col("id") % 100, col("id") % 100, transform)
    return centroids(t).select("id", r6(px).alias("px"), r6(py).alias("py"), r6(x).alias("x"), r6(y).alias("y"))


@query("select_bands", "SELECT vec_id AS id, round(list_sum([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[4] AS DOUBLE)]), 6) AS total, CAST(3 AS BIGINT) AS n FROM embeddings")
def select_bands(t):
    used = pixel.select_bands(F.slice("embedding", 1, 5), [True, True, False, True, False])
    total = F.aggregate(used, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.embeddings.select(col("vec_id").alias("id"), r6(total).alias("total"), F.size(used).cast("bigint").alias("n"))


@query("band_count_guard", "SELECT vec_id AS id FROM embeddings WHERE 1 + vec_id % 8 >= 5")
def band_count_guard(t):
    return t.embeddings.select(col("vec_id").alias("id"), F.slice("embedding", F.lit(1), (1 + col("vec_id") % 8).cast("int")).alias("bands")).filter(F.size("bands") >= 5).select("id")


@query("finite_filter", f"SELECT id FROM ({AREAS}) WHERE id % 11 NOT IN (0, 1, 2)")
def finite_filter(t):
    k = col("id") % 11
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k != 2, col("area"))
    return areas(t).withColumn("v", v).filter(pixel.finite(col("v"))).select("id")


@query("null_split", f"SELECT clustered, count(*) AS n, round(avg(area), 4) AS mean FROM (SELECT id % 3 <> 0 AS clustered, area FROM ({AREAS})) GROUP BY clustered")
def null_split(t):
    a = areas(t).withColumn("cluster", F.when(col("id") % 3 != 0, col("dist")))
    return a.groupBy(col("cluster").isNotNull().alias("clustered")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area"), 4).alias("mean"))


@query("min_observations", f"SELECT r, c, count(*) AS n FROM ({PIXELS}) WHERE m <> 0 GROUP BY r, c HAVING count(*) > 2")
def min_observations(t):
    return pixels(t).filter("m <> 0").groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


@query("crop_common_shape", f"SELECT r, c, y, round(p, 6) AS p FROM (SELECT * FROM ({PIXELS}) WHERE r < 12 + (y - 2019) // 2) WHERE r < (SELECT min(h) FROM (SELECT max(r) + 1 AS h FROM (SELECT * FROM ({PIXELS}) WHERE r < 12 + (y - 2019) // 2) GROUP BY y)) AND c < (SELECT min(w) FROM (SELECT max(c) + 1 AS w FROM (SELECT * FROM ({PIXELS}) WHERE r < 12 + (y - 2019) // 2) GROUP BY y))")
def crop_common_shape(t):
    return pixel.common_shape(pixels(t).filter("r < 12 + (y - 2019) div 2"), ["y"]).select("r", "c", "y", r6("p").alias("p"))


# ---- metrics ----
TRUTH = "SELECT CAST(quality AS BIGINT) AS t, CAST(toxic AS BIGINT) AS p, doc_id % 7 AS g FROM labels"


def truth(t):
    return t.labels.selectExpr("cast(quality as bigint) t", "cast(toxic as bigint) p", "doc_id % 7 g")


@query("class_balance", f"SELECT count(CASE WHEN t = 1 THEN 1 END) AS ones, count(CASE WHEN t = 0 THEN 1 END) AS zeros FROM ({TRUTH})")
def class_balance(t):
    return truth(t).agg(F.count_if(col("t") == 1).alias("ones"), F.count_if(col("t") == 0).alias("zeros"))


CONFUSION = f"SELECT g, count(CASE WHEN t=0 AND p=0 THEN 1 END) AS tn, count(CASE WHEN t=0 AND p=1 THEN 1 END) AS fp, count(CASE WHEN t=1 AND p=0 THEN 1 END) AS fn, count(CASE WHEN t=1 AND p=1 THEN 1 END) AS tp FROM ({TRUTH}) GROUP BY g"


@query("confusion_matrix", CONFUSION)
def confusion_matrix(t):
    return truth(t).groupBy("g").agg(*metrics.confusion(col("t"), col("p")))


@query("confusion_micro", f"""WITH s AS (SELECT sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM ({CONFUSION}))
SELECT round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy FROM s""")  # fmt: skip
def confusion_micro(t):
    cells = truth(t).groupBy("g").agg(*metrics.confusion(col("t"), col("p"))).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return cells.select(*[r6(c).alias(n) for c, n in zip(metrics.rates(*map(col, ("tn", "fp", "fn", "tp"))), ("sensitivity", "specificity", "accuracy"), strict=True)])


@query("valid_metrics", f"""SELECT g, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity FROM ({CONFUSION})
WHERE coalesce(tp / nullif(tp + fn, 0), 0) > 0 OR coalesce(tn / nullif(tn + fp, 0), 0) > 0 OR coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) > 0""")  # fmt: skip
def valid_metrics(t):
    cells = truth(t).groupBy("g").agg(*metrics.confusion(col("t"), col("p")))
    out = cells.select("g", *metrics.rates(*map(col, ("tn", "fp", "fn", "tp"))))
    return out.filter("sensitivity > 0 OR specificity > 0 OR accuracy > 0").select("g", r6("sensitivity").alias("sensitivity"))


SOFT = f"SELECT y, CAST(m <> 0 AS INT)::DOUBLE AS t, p, CASE WHEN r = 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS w FROM ({PIXELS})"


def soft(t):
    return pixels(t).select("y", (col("m") != 0).cast("double").alias("t"), "p", F.when(col("r") == 0, 5.0).otherwise(1.0).alias("w"))


@query("dice_pixel", f"SELECT y, round(avg((2 * t * p + 1e-5) / (t + p + 1e-5)), 6) AS dice, round(1 - avg((2 * t * p + 1e-5) / (t + p + 1e-5)), 6) AS loss, round((2 * sum(t * p) + 1e-5) / (sum(t) + sum(p) + 1e-5), 6) AS dice_global FROM ({SOFT}) GROUP BY y")
def dice_pixel(t):
    d = metrics.pixel_dice(col("t"), col("p"))
    return soft(t).groupBy("y").agg(r6(d).alias("dice"), r6(1 - d).alias("loss"), r6(metrics.global_dice(col("t"), col("p"))).alias("dice_global"))


@query("weighted_metrics", f"""WITH s AS (SELECT y, sum(round_even(t * p, 0)) AS tp, sum(round_even((1 - t) * (1 - p), 0)) AS tn, sum(round_even((1 - t) * p, 0)) AS fp, sum(round_even(t * (1 - p), 0)) AS fn,
 avg(CASE WHEN round_even(t, 0) = round_even(p, 0) THEN 1.0 ELSE 0.0 END) AS acc FROM ({SOFT}) GROUP BY y)
SELECT y, tp, tn, fp, fn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(acc, 6) AS accuracy FROM s""")  # fmt: skip
def weighted_metrics(t):
    s = soft(t).groupBy("y").agg(*metrics.soft_counts(col("t"), col("p")), metrics.pixel_accuracy(col("t"), col("p")).alias("acc"))
    return s.select("y", "tp", "tn", "fp", "fn", r6(F.try_divide(col("tp"), col("tp") + col("fn"))).alias("sensitivity"), r6(F.try_divide(col("tn"), col("tn") + col("fp"))).alias("specificity"), r6("acc").alias("accuracy"))


@query("tversky", f"""SELECT y, round(1 - sum(w * p * t) / (sum(w * p * t) + 0.7 * sum(w * p * (1 - t)) + 0.3 * sum(w * (1 - p) * t) + 1e-5), 6) AS loss FROM ({SOFT}) GROUP BY y""")
def tversky(t):
    return soft(t).groupBy("y").agg(r6(metrics.tversky_loss(col("t"), col("p"), col("w"), 0.7, 0.3)).alias("loss"))


@query("metrics_text", f"""WITH c AS (SELECT sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM ({CONFUSION}))
SELECT printf('sensitivity: %.4f', tp / (tp + fn)) AS line FROM c UNION ALL SELECT printf('specificity: %.4f', tn / (tn + fp)) FROM c""")  # fmt: skip
def metrics_text(t):
    c = truth(t).agg(*metrics.confusion(col("t"), col("p")))
    m = c.select(*metrics.rates(*map(col, ("tn", "fp", "fn", "tp"))))
    return m.select(F.explode(F.array(*[F.format_string(f"{n}: %.4f", n) for n in ("sensitivity", "specificity")])).alias("line"))
