"""Chunks, patches, resampling, aggregation onto coarser grids and stencils, over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_grid(df: DataFrame, width: str, height: str, cols: int, rows: int) -> DataFrame:
    """A row for each chunk of a grid of cols x rows over each raster; the last may reach over the border."""
    w, h = F.ceil(F.col(width) / cols), F.ceil(F.col(height) / rows)
    out = df.withColumn("cw", w).withColumn("ch", h).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return out.select(*df.columns, (F.col("i") * F.col("cw")).cast("bigint").alias("col_off"), (F.col("j") * F.col("ch")).cast("bigint").alias("row_off"), F.col("cw").cast("bigint").alias("w"), F.col("ch").cast("bigint").alias("h"))


def starts(size: Column, patch: int, stride: int, sequential: bool = False) -> Column:
    """Offsets of patches along one axis: all multiples of the stride below the size, or, sequential, below size -
    patch, and 0 where the patch doesn't fit."""
    if not sequential:
        return F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(stride).cast("bigint"))
    last = size - patch - 1
    return F.when(size <= patch, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)), F.lit(stride).cast("bigint")))


def patches(df: DataFrame, width: str, height: str, patch: int, stride: int, sequential: bool = False) -> DataFrame:
    """A row for each patch of each raster, ord counting them column by column."""
    x = df.withColumn("xs", starts(F.col(width), patch, stride, sequential)).withColumn("ys", starts(F.col(height), patch, stride, sequential))
    out = x.select(*df.columns, "ys", F.posexplode("xs").alias("i", "x")).select(*df.columns, F.size("ys").alias("n"), "i", "x", F.posexplode("ys").alias("j", "y"))
    return out.select(*df.columns, "x", "y", (F.col("i") * F.col("n") + F.col("j")).cast("bigint").alias("ord"))


def padded(df: DataFrame, by: list[str], size: int, row: str, col: str, value: str) -> DataFrame:
    """Each group's pixels on a full size x size grid, 0 where there is none."""
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    full = df.select(*by).distinct().select(*by, F.explode(axis).alias(row)).select(*by, row, F.explode(axis).alias(col))
    return full.join(df, [*by, row, col], "left").select(*by, row, col, F.coalesce(value, F.lit(0.0)).alias(value))


def combine(operator: str, value: str, order: str) -> Column:
    """How overlapping patches meet in a pixel; an unknown name means REPLACE, as the last patch in order.

    MAX and MIN start from 0 and 1; MEAN averages each value with the mean so far, from 0 on, in order; nulls and NaN
    don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    if operator == "MAX":
        return F.greatest(F.lit(0.0), F.max(v))
    if operator == "MIN":
        return F.least(F.lit(1.0), F.min(v))
    if operator == "MEAN":
        values = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v")))))
        return F.aggregate(values, F.lit(0.0), lambda a, x: (a + x["v"]) / 2)
    return F.max_by(value, order)


def overlay_last(value: str, order: str, nodata: float | None = None) -> Column:
    """Of sources laid over each other the last with a value."""
    v = F.col(value) if nodata is None else F.when(F.col(value) != nodata, F.col(value))
    return F.max_by(v, F.when(v.isNotNull(), F.col(order)))


def around(low: Column, high: Column, size: int) -> Column:
    """The whole numbers from low to high, one more on either side, within 0 to size - 1."""
    return F.sequence(F.greatest(F.floor(low) - 1, F.lit(0)).cast("bigint"), F.least(F.ceil(high) + 1, F.lit(size - 1)).cast("bigint"))


def rescaled_nearest(df: DataFrame, by: list[str], height: int, width: int, to_height: int, to_width: int, row: str, col: str, value: str) -> DataFrame:
    """Nearest-neighbour resize. Each source pixel makes the target pixels it is nearest to: no join."""
    def targets(at: str, size: int, to: int) -> Column:
        near = around(F.col(at) * (to / size) - 0.5, (F.col(at) + 1) * (to / size) - 0.5, to)
        return F.filter(near, lambda i: F.floor((i + 0.5) * (size / to)) == F.col(at))

    rows = df.select(*by, F.explode(targets(row, height, to_height)).alias("nr"), col, value)
    return rows.select(*by, F.col("nr").alias(row), F.explode(targets(col, width, to_width)).alias(col), value)


def upsampled_bilinear(df: DataFrame, by: list[str], height: int, width: int, k: int, row: str, col: str, value: str) -> DataFrame:
    """Bilinear upsampling by k, borders clamped. Each source pixel sends its weighted value to the targets that it is
    a neighbour of, and the weights of a target add up to 1: one partial aggregate, no join."""
    def weights(at: str, size: int) -> Column:
        axis = around((F.col(at) - 0.5) * k - 0.5, (F.col(at) + 1.5) * k - 0.5, size * k)

        def place(i):
            return F.least(F.greatest((i + 0.5) / k - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
        return F.filter(F.transform(axis, lambda i: F.struct(i.cast("bigint").alias("i"), F.greatest(F.lit(0.0), 1 - F.abs(place(i) - F.col(at))).alias("w"))), lambda x: x["w"] > 0)

    rows = df.select(*by, F.explode(weights(row, height)).alias("a"), col, value).select(*by, "a", F.explode(weights(col, width)).alias("b"), value)
    return rows.groupBy(*by, F.col("a.i").alias(row), F.col("b.i").alias(col)).agg(F.sum(F.col(value) * F.col("a.w") * F.col("b.w")).alias(value))


def coarse(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical structuring element."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def stencil(df: DataFrame, by: list[str], radius: int, grow: bool, row: str, col: str, value: str) -> DataFrame:
    """Dilation (grow) or erosion by a disc; what is outside a raster doesn't count. Each pixel sends its value to its
    neighbourhood and maxima or minima are taken, partially in each task; targets outside have no pixel and are
    dropped, as every pixel also sends to itself."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(radius)])
    sent = df.select(*by, row, col, value, F.explode(offsets).alias("o"))
    agg = F.max if grow else F.min
    return sent.groupBy(*by, (F.col(row) + F.col("o.i")).alias(row), (F.col(col) + F.col("o.j")).alias(col)).agg(
        agg(value).alias(value), F.bool_or((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own")
    ).filter("own").drop("own")


def open_close(df: DataFrame, by: list[str], radius: int, row: str = "r", col: str = "c", value: str = "v") -> DataFrame:
    """Morphological opening, then closing."""
    for grow in (False, True, True, False):
        df = stencil(df, by, radius, grow, row, col, value)
    return df
