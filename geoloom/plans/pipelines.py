"""The three composite runs: predict patches of images, turn predictions into features and maps, build frames and
evaluate. Each is one lazy plan over tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, kernels, metrics, pixel, vector


class ConfigError(ValueError):
    """A parameter that can't be."""


@dataclass(frozen=True)
class Config:
    """Parameters of a run."""

    patch: int = 8
    stride: int = 4
    operator: str = "MAX"
    at: float = 0.5
    chunk: int = 64
    resolution: float = 4.0
    boundary_weight: float = 10.0
    boundary_scale: float = 1.5
    alpha: float = 0.4
    beta: float = 0.6
    area_limits: tuple[float, ...] = (3.0, 15.0, 50.0, 200.0)
    batch: int = 50

    def validate(self) -> Config:
        if self.patch < 1 or not 1 <= self.stride <= self.patch:
            raise ConfigError("the stride must be from 1 to the patch size")
        if not 0 <= self.at <= 1:
            raise ConfigError("the threshold must be from 0 to 1")
        if list(self.area_limits) != sorted(self.area_limits) or not self.area_limits:
            raise ConfigError("area limits must ascend")
        for f in fields(self):
            if isinstance(getattr(self, f.name), int | float) and getattr(self, f.name) < 0:
                raise ConfigError(f"{f.name} is negative")
        return self


def demo_model(x: np.ndarray) -> np.ndarray:
    """A deterministic stand-in for a trained model: a logistic of each pixel."""
    return 1 / (1 + np.exp(-10 * x))


def predict(images: DataFrame, pixels: DataFrame, masks: DataFrame | None, config: Config, model=demo_model) -> DataFrame:
    """(image, r, c, p, mask) from images (image, w, h) and pixels (image, r, c, v): patches are laid out, those that
    meet no mask box (image, mx0, my0, mx1, my1) are left out, the rest are scored in batches, combined where they
    overlap, and thresholded. Pixels that an image lacks count as 0 in their patches, but have no row."""
    config.validate()
    n = config.patch
    patches = grid.patches(images, "w", "h", n, config.stride).withColumns({"px1": F.col("x") + n, "py1": F.col("y") + n})
    if masks is not None:
        m = masks.select(F.col("image").alias("m_image"), "mx0", "my0", "mx1", "my1")
        on = (F.col("image") == F.col("m_image")) & vector.overlap(("x", "y", "px1", "py1"), ("mx0", "my0", "mx1", "my1"), True)
        patches = patches.join(m, on, "left_semi")
    # a pixel finds its patches by arithmetic: those that begin at most a patch before it
    first = lambda v: F.greatest(F.lit(0), F.ceil((F.col(v) - n + 1) / config.stride)) * config.stride
    near = lambda v: F.sequence(first(v), F.floor(F.col(v) / config.stride) * config.stride, F.lit(config.stride).cast("bigint"))
    sent = pixels.select("image", "r", "c", "v", F.explode(near("c")).alias("x")).select("*", F.explode(near("r")).alias("y"))
    held = sent.join(patches.select("image", "x", "y", "ord"), ["image", "x", "y"])
    cells = held.groupBy("image", "x", "y", "ord").agg(F.collect_list(F.struct(((F.col("r") - F.col("y")) * n + F.col("c") - F.col("x")).cast("int").alias("k"), "v")).alias("cells"))
    filled = cells.select("image", "x", "y", "ord", F.map_from_entries("cells").alias("m")).select(
        "image", "x", "y", "ord", F.map_keys("m").alias("there"), F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values")
    )
    done = kernels.scored(filled, model, ["image", "x", "y", "ord", "there"], batch=config.batch)
    # a score for each pixel that the image has
    own = F.explode(F.transform("there", lambda k: F.struct(k.alias("k"), F.get("scores", k).alias("p")))).alias("s")
    flat = done.select("image", "x", "y", "ord", own).select("image", "x", "y", "ord", "s.k", "s.p").select("image", (F.col("y") + F.floor(F.col("k") / n)).alias("r"), (F.col("x") + F.col("k") % n).alias("c"), "ord", "p")
    inside = flat.join(images.select("image", "w", "h"), "image").filter("r < h AND c < w")  # edge patches reach over
    out = inside.groupBy("image", "r", "c").agg(grid.combine(config.operator, "p", "ord").alias("p"))
    return out.withColumn("mask", pixel.threshold(F.col("p"), config.at))


def written_mask(prediction: DataFrame, config: Config, areas: DataFrame | None = None, nodata: int = 255) -> DataFrame:
    """(image, r, c, mask) as it is written, of a prediction (image, r, c, p): 1 from the threshold on, else 0, and nodata
    where there is no value or where the centre lies in no box of areas (image, ax0, ay0, ax1, ay1) of the image."""
    config.validate()
    out = prediction.select("image", "r", "c", pixel.threshold(F.col("p"), config.at).alias("mask"))
    if areas is not None:
        centres = out.select("image", "r", "c", (F.col("c") + 0.5).alias("cut_x"), (F.col("r") + 0.5).alias("cut_y"))
        boxes = areas.select(F.col("image").alias("cut_image"), "ax0", "ay0", "ax1", "ay1")
        inside = vector.points_in(centres, boxes, "cut_x", "cut_y", ("ax0", "ay0", "ax1", "ay1"), float(config.chunk)).filter("image = cut_image").select("image", "r", "c", F.lit(1).alias("cut_in")).distinct()
        out = out.join(inside, ["image", "r", "c"], "left").withColumn("mask", F.when(F.col("cut_in") == 1, F.col("mask")))
    return out.select("image", "r", "c", F.coalesce("mask", F.lit(nodata)).cast("bigint").alias("mask"))


def postprocess(mask: DataFrame, config: Config, wanted: tuple[str, ...] = ("features", "centroids", "density", "cover")) -> dict[str, DataFrame]:
    """Of predicted pixels (image, r, c, mask) what is wanted: features (image, label, v, n, rings), centroids (image,
    label, x, y, area), density and cover. Components are found, in jobs of their own, only where they are needed."""
    config.validate()
    p = mask.select("image", "r", "c", F.col("mask").alias("v"))
    out = {}
    if "features" in wanted:
        out["features"] = kernels.polygonised(p, "image", config.chunk)
    if "centroids" in wanted or "density" in wanted:
        labels = kernels.labelled(p.filter("v = 1"), "image", config.chunk)
        out["centroids"] = labels.groupBy("image", "label").agg((F.avg("c") + 0.5).alias("x"), (F.avg("r") + 0.5).alias("y"), F.count(F.lit(1)).cast("double").alias("area"))
    if "density" in wanted:
        limits = list(config.area_limits)
        cell = [grid.coarse(F.col(a), config.resolution).alias(b) for a, b in (("x", "cx"), ("y", "cy"))]
        k = vector.area_class(F.col("area"), limits)
        out["density"] = out["centroids"].groupBy("image", *cell).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k == i).alias(f"n_{i}") for i in range(1, len(limits) + 1)])
    if "cover" in wanted:
        out["cover"] = p.groupBy("image", grid.coarse(F.col("c"), config.resolution).alias("cx"), grid.coarse(F.col("r"), config.resolution).alias("cy")).agg((F.avg("v") * 100).alias("cover"))
    return out


def frames(areas: DataFrame, labels: DataFrame, pixels: DataFrame, config: Config, cell: float = 16.0) -> DataFrame:
    """(area, r, c, v, label, weight): the pixels (r, c, v) of each area (area, ax0, ay0, ax1, ay1) with the label
    boxes (id, x0, y0, x1, y1) burned in, and a weight where the scaled boxes of two labels meet outside both."""
    config.validate()
    box, small = ("ax0", "ay0", "ax1", "ay1"), ("x0", "y0", "x1", "y1")
    burned = vector.rasterised(labels, small, 1, False, []).distinct().select(F.col("px").alias("c"), F.col("py").alias("r"), F.lit(1).cast("bigint").alias("hit"))
    grown = vector.scaled(labels.select("id", *small), small, config.boundary_scale, small)
    edge = vector.met_pixels(grown, "id", small).select(F.col("px").alias("c"), F.col("py").alias("r"), F.lit(1).alias("edge"))
    # pixels get what they bear before they are dealt to areas
    out = vector.points_in(pixels.join(burned, ["r", "c"], "left").join(edge, ["r", "c"], "left"), areas, "c", "r", box, cell)
    label = F.coalesce("hit", F.lit(0)).cast("bigint")
    weight = F.when(F.col("edge").isNotNull() & (label == 0), config.boundary_weight).otherwise(1.0)
    return out.select("area", "r", "c", "v", label.alias("label"), weight.alias("weight"))


def evaluate(truth: DataFrame, prediction: DataFrame, config: Config) -> DataFrame:
    """One row of metrics of predicted (r, c, p) against frames (area, r, c, label, weight)."""
    config.validate()
    both = truth.join(prediction.select("r", "c", "p"), ["r", "c"])
    t, p, w = F.col("label").cast("double"), F.col("p"), F.col("weight")
    hard = pixel.above(p, config.at)
    sums = both.agg(*metrics.confusion(F.col("label"), hard), metrics.pixel_dice(t, p).alias("dice"), metrics.tversky_loss(t, p, w, config.alpha, config.beta).alias("loss"))
    return sums.select("dice", "loss", *metrics.rates(*map(F.col, ("tn", "fp", "fn", "tp"))))
