"""Pixel expressions: band algebra, encodings, masks, thresholds. All are columns, evaluated inside a projection.

NaN and nodata are made null on the way in (clean()); comparisons with null are then false where a mask is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(v: Column, nodata: float | None = None) -> Column:
    """NaN, and the nodata value, as null."""
    out = F.when(~F.isnan(v.cast("double")), v)
    return out if nodata is None else F.when(out != nodata, out)


def ndvi(red: Column, nir: Column, wrap16: bool = False) -> Column:
    """(nir - red) / (nir + red), null where the sum is 0. With wrap16 the sum wraps at 65536 as unsigned 16-bit sums do."""
    total = nir + red
    return F.try_divide((nir - red).cast("double"), F.pmod(total, F.lit(65536)) if wrap16 else total)


def ndvi_uint16(v: Column) -> Column:
    """An index in [-1, 1] as 0 to 20000, truncated."""
    return (F.least(F.greatest(v * 10000, F.lit(-10000.0)), F.lit(10000.0)) + 10000).cast("bigint")


def dem_encode(h: Column) -> Column:
    """Heights in tenths from 1 up; NaN and null become 0, which is nodata. NaN is asked for first, as it is the
    greatest of all."""
    return F.when(h.isNull() | F.isnan(h), F.lit(0)).otherwise((F.greatest(h, F.lit(0.1)) * 10).cast("bigint"))


def masked_by_band(value: Column, band: Column) -> Column:
    """0 where the band is 0."""
    return F.when(band == 0, F.lit(0)).otherwise(value)


def to_integer(v: Column) -> Column:
    """Truncated; NaN and null become 0."""
    return F.coalesce(clean(v), F.lit(0.0)).cast("bigint")


def threshold(p: Column, at: float) -> Column:
    """1 from the threshold on, else 0; null where there is no value."""
    return (clean(p) >= at).cast("bigint")


def above(p: Column, at: float = 0.5) -> Column:
    """1 strictly above, else 0, also where there is no value."""
    return F.coalesce(clean(p) > at, F.lit(False)).cast("bigint")


def without_values(v: Column, values: list) -> Column:
    """0 in place of any of the values."""
    return F.when(v.isin(values), F.lit(0)).otherwise(v)


def label_weight(label: Column, weight: Column, boundary: float) -> tuple[Column, Column]:
    """Annotation and weight made binary again after resampling."""
    return (label >= 0.5).cast("bigint"), F.when(weight >= 0.5, F.lit(float(boundary))).otherwise(F.lit(1.0))


def finite(*values: Column) -> Column:
    """Whether all values are there and finite."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def select_bands(bands: Column, used: list[bool]) -> Column:
    """The elements of an array of bands that are used, in order."""
    return F.filter(bands, lambda x, i: F.element_at(F.array(*[F.lit(u) for u in used]), i + 1))


def standardised(df: DataFrame, value: str, by: list[str], out: str, epsilon: float = 1e-8, nodata: float | None = None) -> DataFrame:
    """(v - mean) / (population deviation + epsilon) over each group; null where there is no value. The groups' numbers
    are partial aggregates, joined back: no group's pixels come together in one task."""
    v = clean(F.col(value), nodata)
    stats = df.groupBy(*[F.col(c).alias(f"s_{c}") for c in by]).agg(F.avg(v).alias("s_mean"), F.stddev_pop(v).alias("s_sd"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    joined = df.join(stats, same) if by else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(out, (v - F.col("s_mean")) / (F.col("s_sd") + epsilon)).drop("s_mean", "s_sd", *[f"s_{c}" for c in by])


def standardised_bands(df: DataFrame, by: list[str], place: list[str], band: str, value: str, out: str, nodata: float, epsilon: float = 1e-8) -> DataFrame:
    """Each band standardised as by standardised(), where a pixel without a value in any band has none in all."""
    holes = df.filter(clean(F.col(value), nodata).isNull()).select(*by, *place, F.lit(True).alias("sb_hole")).distinct()
    whole = df.join(holes, [*by, *place], "left").withColumn(value, F.when(F.col("sb_hole").isNull(), F.col(value))).drop("sb_hole")
    return standardised(whole, value, [*by, band], out, epsilon)


def metres_to_degrees(dx: Column, dy: Column, lat: Column) -> tuple[Column, Column]:
    return dx / (F.cos(F.radians(F.abs(lat))) * 111320), dy / 110540


def degrees_to_metres(dx: Column, dy: Column, lat: Column) -> tuple[Column, Column]:
    return dx * F.cos(F.radians(F.abs(lat))) * 111320, dy * 110540


def world_to_pixel(x: Column, y: Column, transform: list[float]) -> tuple[Column, Column]:
    """Pixel coordinates of world ones under an affine transform (a, b, c, d, e, f): x = a*col + b*row + c."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    return ((x - c) * e - (y - f) * b) / det, ((y - f) * a - (x - c) * d) / det


def pixel_to_world(col: Column, row: Column, transform: list[float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = transform
    return col * a + row * b + c, col * d + row * e + f


def yearly(df: DataFrame, by: list[str], value: str = "p", mask: str = "m", at: float = 0.6, min_obs: int = 1, mode: str = "valid") -> DataFrame:
    """Masked mean and number of observations over the years of each pixel, and a flag: with mode 'valid' that there
    is an observation, with 'presence' that the mean reaches ``at`` over more than ``min_obs`` observations."""
    seen = F.when(F.col(mask) != 0, clean(F.col(value)))
    out = df.groupBy(*by).agg(F.avg(seen).alias("mean"), F.count(seen).alias("n_obs"))
    if mode == "valid":
        return out.withColumn("valid", (F.col("n_obs") > 0).cast("bigint"))
    return out.withColumn("presence", F.coalesce((F.col("mean") >= at) & (F.col("n_obs") > min_obs), F.lit(False)).cast("bigint"))


def common_shape(df: DataFrame, raster: list[str], row: str = "r", col: str = "c") -> DataFrame:
    """The pixels inside the smallest height and width of all rasters, whose origin they share."""
    sizes = df.groupBy(*raster).agg((F.max(row) + 1).alias("h"), (F.max(col) + 1).alias("w")).agg(F.min("h").alias("h"), F.min("w").alias("w"))
    return df.crossJoin(F.broadcast(sizes)).filter((F.col(row) < F.col("h")) & (F.col(col) < F.col("w"))).drop("h", "w")  # one row
