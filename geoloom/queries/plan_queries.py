"""Queries of the composite runs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import RECTS, ZONES, rects, tiles, zones
from ..plans import pipelines
from ..registry import query
from .kernel_queries import _MOSAIC, _checkpoints, components, mosaic

col, r6 = F.col, lambda c: F.round(c, 6)
CONFIG = pipelines.Config(chunk=16, at=0.55)


def predicted(t, config=CONFIG, model=pipelines.demo_model):
    p = tiles(t).selectExpr("tile div 25 image", "((tile div 5) % 5) * 8 + r r", "(tile % 5) * 8 + c c", "v")
    images = p.groupBy("image").agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h"))
    return pipelines.predict(images, p, None, config, model)


_SRC = "SELECT vec_id // 25 AS image, ((vec_id // 5) % 5) * 8 + (p - 1) // 8 AS r, (vec_id % 5) * 8 + (p - 1) % 8 AS c, CAST(embedding[p] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)"


@query("predict_all", f"SELECT CAST(image AS BIGINT) AS image, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(1 / (1 + exp(-10 * v)), 6) AS p, CAST(1 / (1 + exp(-10 * v)) >= 0.55 AS BIGINT) AS mask FROM ({_SRC})")
def predict_all(t):
    return predicted(t).withColumn("p", r6("p"))


def by_place(x):
    """A model whose scores depend on a pixel's place in its patch, so that overlapping patches differ."""
    return pipelines.demo_model(x) * (1 + np.arange(x.shape[1]) % 7) / 7


_PATCHED = f"""(SELECT image, r, c, (c - dx) * 1000 + r - dy AS ord, 1 / (1 + exp(-10 * v)) * (1 + (dy * 8 + dx) % 7) / 7 AS p FROM (SELECT s.*, r % 4 + 4 * a AS dy, c % 4 + 4 * b AS dx FROM ({_SRC}) s, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) WHERE dy <= r AND dx <= c)"""


@query("predict_operators", f"""SELECT CAST(image AS BIGINT) AS image, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(max(p), 6) AS p_max, round(min(p), 6) AS p_min, round(sum(p * pow(0.5, m - i + 1)), 6) AS p_mean, round(arg_max(p, ord), 6) AS p_replace
FROM (SELECT *, row_number() OVER (PARTITION BY image, r, c ORDER BY ord) AS i, count(*) OVER (PARTITION BY image, r, c) AS m FROM {_PATCHED}) GROUP BY 1, 2, 3""")  # fmt: skip
def predict_operators(t):
    out = None
    for name in ("MAX", "MIN", "MEAN", "REPLACE"):
        one = predicted(t, replace(CONFIG, operator=name), by_place).select("image", "r", "c", r6("p").alias(f"p_{name.lower()}"))
        out = one if out is None else out.join(one, ["image", "r", "c"])
    return out


@query("predict_written", f"""WITH p AS (SELECT CAST(image AS BIGINT) AS image, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, max(p) AS p FROM {_PATCHED} GROUP BY 1, 2, 3)
SELECT image, r, c, CAST(CASE WHEN (c + 0.5 >= image % 5 AND c + 0.5 < 20 AND r + 0.5 >= 2 AND r + 0.5 < 30) OR (c + 0.5 >= 15 AND c + 0.5 < 30.5 AND r + 0.5 >= 25 AND r + 0.5 < 38) THEN CAST(p >= 0.55 AS INT) ELSE 255 END AS BIGINT) AS mask FROM p""")  # fmt: skip
def predict_written(t):
    p = predicted(t, CONFIG, by_place)
    images = t.embeddings.select(F.floor(col("vec_id") / 25).alias("image")).distinct()
    areas = images.selectExpr("image", "inline(array(struct(double(image % 5) ax0, 2D ay0, 20D ax1, 30D ay1), struct(15D ax0, 25D ay0, 30.5D ax1, 38D ay1)))")
    return pipelines.written_mask(p, CONFIG, areas)


@query("postprocess_cover", f"SELECT CAST(image AS BIGINT) AS image, CAST(c // 4 AS BIGINT) AS cx, CAST(r // 4 AS BIGINT) AS cy, round(avg(CASE WHEN 1 / (1 + exp(-10 * v)) >= 0.55 THEN 1.0 ELSE 0.0 END) * 100, 6) AS cover FROM ({_SRC}) GROUP BY ALL")
def postprocess_cover(t):
    return pipelines.postprocess(predicted(t), CONFIG, ("cover",))["cover"].withColumn("cover", r6("cover"))


_CLASSES = ", ".join(f"count(CASE WHEN n >= {a}{f' AND n < {b}' if b else ''} THEN 1 END) AS n_{i}" for i, (a, b) in enumerate(zip(CONFIG.area_limits, [*CONFIG.area_limits[1:], None], strict=True), 1))


@query("postprocess_density", components(_MOSAIC, "image") + f" SELECT image, CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy, count(*) AS n, {_CLASSES} FROM comp GROUP BY 1, 2, 3")
def postprocess_density(t):
    _checkpoints(t)
    m = mosaic(t).select("image", "r", "c", col("v").alias("mask"))
    return pipelines.postprocess(m, CONFIG, ("density",))["density"]


@query("postprocess_features", components(_MOSAIC, "image") + " SELECT image, label, n, n_rings FROM comp")
def postprocess_features(t):
    _checkpoints(t)
    m = mosaic(t).select("image", "r", "c", col("v").alias("mask"))
    return pipelines.postprocess(m, CONFIG, ("features",))["features"].select("image", "label", "n", F.size("rings").alias("n_rings"))


@query("preprocess_frames", f"""WITH z AS (SELECT zid, px, unnest(range(zy0, zy1)) AS py FROM (SELECT zid, unnest(range(zx0, zx1)) AS px, zy0, zy1 FROM ({ZONES}))),
p AS (SELECT DISTINCT o_orderkey % 1000 AS px, o_custkey % 1000 AS py FROM orders) SELECT z.zid AS area, count(*) AS pixels FROM z JOIN p ON z.px = p.px AND z.py = p.py GROUP BY z.zid""")  # fmt: skip
def preprocess_frames(t):
    areas = zones(t).toDF("area", "ax0", "ay0", "ax1", "ay1")
    px = t.orders.selectExpr("o_orderkey % 1000 c", "o_custkey % 1000 r", "1.0 v").distinct()
    return pipelines.frames(areas, rects(t), px, CONFIG).groupBy("area").agg(F.count(F.lit(1)).alias("pixels"))


_GROWN = f"(SELECT id, (x0 + x1) / 2.0 - (x1 - x0) * 0.75 AS x0, (y0 + y1) / 2.0 - (y1 - y0) * 0.75 AS y0, (x0 + x1) / 2.0 + (x1 - x0) * 0.75 AS x1, (y0 + y1) / 2.0 + (y1 - y0) * 0.75 AS y1 FROM ({RECTS}))"


@query("evaluate_frames", f"""WITH hit AS (SELECT DISTINCT c, unnest(range(y0, y1)) AS r FROM (SELECT unnest(range(x0, x1)) AS c, y0, y1 FROM ({RECTS}))),
common AS (SELECT greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM {_GROWN} a JOIN {_GROWN} b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
edge AS (SELECT DISTINCT c, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS r FROM (SELECT unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS c, y0, y1 FROM common)),
p AS (SELECT DISTINCT (o_orderkey * 7 + 3) % 1000 AS c, (o_custkey * 5 + 1) % 1000 AS r FROM orders),
f AS (SELECT CAST(h.c IS NOT NULL AS INT) AS t, ((p.r * 31 + p.c * 17) % 100) / 100.0 AS p, CASE WHEN e.c IS NOT NULL AND h.c IS NULL THEN 10.0 ELSE 1.0 END AS w
 FROM p JOIN ({ZONES}) z ON p.c >= zx0 AND p.c < zx1 AND p.r >= zy0 AND p.r < zy1 LEFT JOIN hit h ON h.c = p.c AND h.r = p.r LEFT JOIN edge e ON e.c = p.c AND e.r = p.r),
s AS (SELECT avg((2 * t * p + 1e-5) / (t + p + 1e-5)) AS dice, sum(w * p * t) AS tp, sum(w * p * (1 - t)) AS fp, sum(w * (1 - p) * t) AS fn,
 count(CASE WHEN t = 1 AND p > 0.55 THEN 1 END) AS htp, count(CASE WHEN t = 1 AND p <= 0.55 THEN 1 END) AS hfn, count(CASE WHEN t = 0 AND p > 0.55 THEN 1 END) AS hfp, count(CASE WHEN t = 0 AND p <= 0.55 THEN 1 END) AS htn FROM f)
SELECT round(dice, 6) AS dice, round(1 - tp / (tp + 0.4 * fp + 0.6 * fn + 1e-5), 6) AS loss, round(coalesce(htp / nullif(htp + hfn, 0), 0), 6) AS sensitivity, round(coalesce(htn / nullif(htn + hfp, 0), 0), 6) AS specificity, round((htp + htn) / (htp + htn + hfp + hfn), 6) AS accuracy FROM s""")  # fmt: skip
def evaluate_frames(t):
    areas = zones(t).toDF("area", "ax0", "ay0", "ax1", "ay1")
    px = t.orders.selectExpr("(o_orderkey * 7 + 3) % 1000 c", "(o_custkey * 5 + 1) % 1000 r", "1.0 v").distinct()
    truth = pipelines.frames(areas, rects(t), px, CONFIG)
    p = px.select("r", "c", (((col("r") * 31 + col("c") * 17) % 100) / 100).alias("p"))
    return pipelines.evaluate(truth, p, CONFIG).select(*[r6(c).alias(c) for c in ("dice", "loss", "sensitivity", "specificity", "accuracy")])
