"""Scenes matched to a basemap and laid over each other, and rasters resampled into another grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid, ordered, pixel, vector


def match_scenes(scenes: DataFrame, basemap: DataFrame, nodata: int = 0) -> DataFrame:
    """(scene, band, r, c, v, matched, status) from scenes (scene, band, r, c, v) and a basemap (band, r, c, ref).

    The reference of a scene is what the basemap has under its valid pixels; where that is nothing but nodata, the
    whole basemap (status 'whole basemap'). A scene outside the basemap's extent keeps its values, and its status says
    so. Nodata stays nodata. Distributions are tables of values, so only the lookup under the scene touches pixels.
    """
    valid, base = scenes.filter(F.col("v") != nodata), basemap.filter(F.col("ref") != nodata)
    extent = F.broadcast(basemap.agg(F.min("r").alias("b_r0"), F.max("r").alias("b_r1"), F.min("c").alias("b_c0"), F.max("c").alias("b_c1")))  # one row
    boxes = valid.groupBy("scene").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).crossJoin(extent)
    outside = boxes.filter("b_r0 IS NULL OR r1 < b_r0 OR r0 > b_r1 OR c1 < b_c0 OR c0 > b_c1").select("scene", F.lit("outside the basemap").alias("outside"))
    under = ordered.cdf(valid.select("scene", "band", "r", "c").join(base, ["band", "r", "c"]), ["scene", "band"], "ref").select("scene", "band", "ref", "cdf")
    bare = valid.select("scene", "band").distinct().join(outside.select("scene"), "scene", "left_anti").join(under.select("scene", "band").distinct(), ["scene", "band"], "left_anti")
    whole = bare.join(ordered.cdf(base, ["band"], "ref").select("band", "ref", "cdf"), "band").select("scene", "band", "ref", "cdf")
    mine = ordered.cdf(valid, ["scene", "band"], "v")
    lookup = ordered.interpolated(mine, under.unionByName(whole), ["scene", "band"], "cdf", "cdf", "ref", "matched").select("scene", "band", "v", "matched")
    out = scenes.join(lookup, ["scene", "band", "v"], "left").join(outside, "scene", "left").join(bare.withColumn("bare", F.lit("whole basemap")), ["scene", "band"], "left")
    matched = F.when(F.col("v") == nodata, F.lit(float(nodata))).when(F.col("outside").isNotNull(), F.col("v").cast("double")).otherwise(F.coalesce("matched", F.col("v").cast("double")))
    return out.select("scene", "band", "r", "c", "v", matched.alias("matched"), F.coalesce("outside", "bare", F.lit("matched")).alias("status"))


def mosaicked(scenes: DataFrame, by: list[str], value: str, order: str, nodata: float = 0) -> DataFrame:
    """One raster of each group: of scenes laid over each other the last with a value."""
    return scenes.groupBy(*by, "band", "r", "c").agg(grid.overlay_last(value, order, nodata).alias(value))


def _weight(d: Column, how: str) -> Column:
    """Weight of a neighbour at distance d along one axis."""
    if how == "bilinear":
        return 1 - d
    if how != "spline":
        raise ValueError(f"no resampling {how}")
    return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).otherwise((2 - d) * (2 - d) * (2 - d) / 6)


def report(matched: DataFrame, by: list[str]) -> DataFrame:
    """Of each group of matched scenes (match_scenes): how many there are, the list of those that failed, and whether
    the mosaic is done, or failed as it has no scene inside the basemap."""
    scenes = matched.groupBy(*by, "scene").agg(F.first("status").alias("status"))
    bad = F.when(F.col("status") == "outside the basemap", F.col("scene"))
    out = scenes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(bad)).alias("failed"))
    return out.withColumn("status", F.when(F.size("failed") == F.col("n"), "failed").otherwise("done"))


def raster_copy(
    pixels: DataFrame, by: list[str], transform: list[float], to_transform: list[float], height: int, width: int,
    to_source: Callable[[Column, Column], tuple[Column, Column]] | None = None, bands: list[int] | None = None, cutline: DataFrame | None = None, how: str = "nearest", cell: float = 64.0,
) -> DataFrame:
    """Copies rasters (by, band, r, c, v) into another grid of height x width pixels: the wanted bands, resampled as
    ``how`` says, inside a cutline.

    The transforms (a, b, c, d, e, f) take columns and rows to world coordinates of source and target; the target's
    offset and size are its bounds. to_source takes target coordinates to the source's reference system, and is left
    out where both have one. The cutline is boxes (cut_x0, cut_y0, cut_x1, cut_y1) in target coordinates: pixels whose
    centre lies in none of them are left out.
    """
    if bands is not None:
        pixels = pixels.filter(F.col("band").isin(bands))

    def source(x: Column, y: Column) -> tuple[Column, Column]:
        at = pixel.pixel_to_world(x, y, to_transform)
        return pixel.world_to_pixel(*(to_source(*at) if to_source else at), transform)

    inside = None
    if cutline is not None:
        x, y = pixel.pixel_to_world(F.col("c") + 0.5, F.col("r") + 0.5, to_transform)
        places = places_of(pixels.sparkSession, height, width, 1).select("r", "c", x.alias("cut_x"), y.alias("cut_y"))
        inside = vector.points_in(places, cutline, "cut_x", "cut_y", ("cut_x0", "cut_y0", "cut_x1", "cut_y1"), cell).select("r", "c").distinct()
    return warped(pixels, [*by, "band"], height, width, source, how, within=inside).select(*by, "band", "r", "c", "v")


#: Rows of a table of places that is copied to all tasks at most; a larger one is shuffled.
FEW_PLACES = 200_000


def places_of(spark: SparkSession, height: int, width: int, reach: int) -> DataFrame:
    """(r, c, i, j) of a grid, with i and j each below reach: one range, whose size the planner knows."""
    n = F.col("id")
    axis = lambda step, size: (F.floor(n / step) % size).cast("bigint")
    return spark.range(height * width * reach * reach).select(axis(reach * reach * width, height).alias("r"), axis(reach * reach, width).alias("c"), axis(reach, reach).alias("i"), axis(1, reach).alias("j"))


def warped(
    pixels: DataFrame, by: list[str], height: int, width: int, source: Callable[[Column, Column], tuple[Column, Column]], how: str = "nearest", row: str = "r", col: str = "c", value: str = "v", within: DataFrame | None = None,
) -> DataFrame:
    """Each group's pixels in a target grid of height x width. source(column, row) gives the place of a target pixel's
    centre in the source, in pixels with centres at halves; what has no source pixel is left out. how: nearest, bilinear, or spline, the cubic B-spline over four by four
    neighbours; weights are normalised over the neighbours that exist. within: target pixels (r, c), if not all are wanted.

    What a target pixel takes from is the same in all groups, so it is found once, and pixels look up there which
    targets they bear on. The planner can't know how many rows arrays of pixels hold, so they are never broadcast."""
    reach = {"nearest": (0,), "bilinear": (0, 1), "spline": (-1, 0, 1, 2)}.get(how)
    if reach is None:
        raise ValueError(f"no resampling {how}")
    places = places_of(pixels.sparkSession, height, width, len(reach))
    if within is not None:
        places = places.join(within, ["r", "c"], "left_semi")
    x, y = source(F.col("c") + 0.5, F.col("r") + 0.5)
    half, names = (0.0 if how == "nearest" else 0.5), {"r": "t_r", "c": "t_c"}
    places = places.select(F.col("r").alias("t_r"), F.col("c").alias("t_c"), "i", "j", x.alias("s_x"), y.alias("s_y"))
    near = lambda v, k: (F.floor(F.col(v) - half) + reach[0] + F.col(k)).cast("bigint")
    places = places.select(*names.values(), "s_x", "s_y", near("s_y", "i").alias("s_r"), near("s_x", "j").alias("s_c"))
    if how == "nearest":
        places = places.drop("s_x", "s_y")
    else:
        weight = lambda v, at: _weight(F.abs(F.col(v) - 0.5 - F.col(at)), how)
        places = places.select("t_r", "t_c", "s_r", "s_c", (weight("s_x", "s_c") * weight("s_y", "s_r")).alias("s_w")).filter("s_w > 0")
    mine = pixels.dropna(subset=by).select(*by, F.col(row).cast("bigint").alias("s_r"), F.col(col).cast("bigint").alias("s_c"), value)
    few = height * width * len(reach) ** 2 <= FEW_PLACES
    found = mine.join(F.broadcast(places) if few else places.hint("merge"), ["s_r", "s_c"])
    if how == "nearest":
        return found.select(*by, F.col("t_r").alias(row), F.col("t_c").alias(col), value)
    mixed = found.groupBy(*by, "t_r", "t_c").agg((F.sum(F.col(value) * F.col("s_w")) / F.sum("s_w")).alias(value))
    return mixed.select(*by, F.col("t_r").alias(row), F.col("t_c").alias(col), value)
