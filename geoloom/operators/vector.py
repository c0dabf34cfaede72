"""Rectangles: joins by overlap, containment and points, without nested loops.

A box is copied to the grid cells that it reaches into, so that a spatial join is an equi-join on cells; a pair that
shares several cells is kept in one of them only, that of the lower corner of what the two have in common. Hot cells
are split by adaptive execution like any skewed join key. Cells have sizes by level, each four times the one below: a box
is in at most four cells of its own level, the first whose cells are as large as it, and goes to higher levels only
as far as the other side has boxes there. So a very large box makes few rows. Cells should be about as large as most boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import parted

Box = tuple[str, str, str, str]


#: Levels beyond this one aren't made: cells are 4^30 times as large there.
TOP = 30


def level(box: Box, cell: float) -> Column:
    """The first level whose cells are as large as a box."""
    x0, y0, x1, y1 = map(F.col, box)
    side = F.greatest(x1 - x0, y1 - y0)
    return F.when(side <= cell, 0).otherwise(F.least(F.ceil(F.log(4.0, side / cell)), F.lit(TOP))).cast("int")


def highest(df: DataFrame, box: Box, cell: float) -> Column:
    """The highest level of df's boxes: a scalar subquery, an aggregate of one number."""
    return F.coalesce(df.agg(F.max(level(box, cell))).scalar(), F.lit(0))


def size_at(k: Column, cell: float) -> Column:
    return cell * F.pow(F.lit(4.0), k)


def celled(df: DataFrame, box: Box, cell: float, top: Column | None = None, own: str = "cell_own") -> DataFrame:
    """A row for each cell (cell_k, cell_x, cell_y) that a box reaches into, at its own level and up to level top."""
    x0, y0, x1, y1 = box
    at = lambda c: F.floor(F.col(c) / size_at(F.col("cell_k"), cell))
    out = df.withColumn(own, level(box, cell))
    if top is None:
        out = out.withColumn("cell_k", F.col(own))
    else:
        out = out.withColumn("cell_top", F.greatest(own, top)).withColumn("cell_k", F.explode(F.sequence(own, "cell_top"))).drop("cell_top")
    return out.withColumn("cell_x", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cell_y", F.explode(F.sequence(at(y0), at(y1))))


def overlap(a: Box, b: Box, touch: bool) -> Column:
    """Whether two boxes have an area in common, or with touch a point."""
    c = F.col
    less = (lambda x, y: x <= y) if touch else (lambda x, y: x < y)
    return less(c(a[0]), c(b[2])) & less(c(b[0]), c(a[2])) & less(c(a[1]), c(b[3])) & less(c(b[1]), c(a[3]))


def overlap_join(left: DataFrame, right: DataFrame, a: Box, b: Box, cell: float, touch: bool = False, dealt: bool = False) -> DataFrame:
    """All pairs whose boxes overlap, each once, with the columns of both (names must differ). With dealt both sides are
    dealt by cell: where pairs become many rows, a broadcast would leave all of them to the few tasks of a small side."""
    others = celled(right, b, cell, highest(left, a, cell), "cell_other")
    pairs = celled(left, a, cell, highest(right, b, cell)).join(others.hint("merge") if dealt else others, ["cell_k", "cell_x", "cell_y"])
    at = lambda x, y: F.floor(F.greatest(x, y) / size_at(F.col("cell_k"), cell))
    reference = (F.col("cell_k") == F.greatest("cell_own", "cell_other")) & (F.col("cell_x") == at(a[0], b[0])) & (F.col("cell_y") == at(a[1], b[1]))
    return pairs.filter(overlap(a, b, touch) & reference).drop("cell_k", "cell_x", "cell_y", "cell_own", "cell_other")


#: Keys in one row of a stack, about.
STACK = 4_096


def stacked(df: DataFrame, box: Box, key: str, keys: str = "keys") -> DataFrame:
    """A row for each distinct box, with the array (of structs, as null keys count) of the keys of all rows that have
    it; a box of many rows has several such rows. Joined instead of the rows, so that equal boxes are compared once,
    and unstacked by F.inline. Rows without a box are left out, as they overlap nothing."""
    some = df.select(key, *box).dropna(subset=list(box))
    return parted(some, list(box), key, "stack", STACK).groupBy(*box, "stack").agg(F.collect_list(F.struct(key)).alias(keys)).drop("stack")


def one_by_one(keys: str, key: str) -> Column:
    """A row for each key of a stack, each asked for when the one before is done with. Generated loops hold all rows that
    they make of one row, so two stacks unstacked in one loop hold the product of their sizes. The function in it keeps
    this generator out of the loop of what follows, which then holds the rows of its own stack only."""
    return F.explode(F.transform(keys, lambda k: k[key])).alias(key)


def alike(df: DataFrame, box: Box, *more: Column | str, copies: str = "copies") -> DataFrame:
    """A row for each distinct box (and what else is given), with the number of rows that have it."""
    return df.groupBy(*box, *more).agg(F.count(F.lit(1)).alias(copies))


def overlapping(left: DataFrame, right: DataFrame, key: str, a: Box, b: Box, cell: float, touch: bool = False) -> DataFrame:
    """The keys of left that overlap anything of right: a semi-join on cells, so a match is looked for only once in each."""
    small = celled(right.select(*b), b, cell, highest(left, a, cell))
    on = (F.col("l.cell_k") == F.col("r.cell_k")) & (F.col("l.cell_x") == F.col("r.cell_x")) & (F.col("l.cell_y") == F.col("r.cell_y"))
    return celled(left.select(key, *a), a, cell, highest(right, b, cell)).alias("l").join(small.alias("r"), on & overlap(a, b, touch), "left_semi").select(key).distinct()


def semi(left: DataFrame, right: DataFrame, key: str, a: Box, b: Box, cell: float, touch: bool = False) -> DataFrame:
    return left.join(overlapping(left, right, key, a, b, cell, touch), key, "left_semi")


def anti(left: DataFrame, right: DataFrame, key: str, a: Box, b: Box, cell: float, touch: bool = False) -> DataFrame:
    return left.join(overlapping(left, right, key, a, b, cell, touch), key, "left_anti")


def within_join(left: DataFrame, right: DataFrame, a: Box, b: Box, cell: float) -> DataFrame:
    """Pairs whose left box lies in the right one."""
    c = F.col
    return overlap_join(left, right, a, b, cell, touch=True).filter((c(a[0]) >= c(b[0])) & (c(a[1]) >= c(b[1])) & (c(a[2]) <= c(b[2])) & (c(a[3]) <= c(b[3])))


def points_in(points: DataFrame, zones: DataFrame, x: str, y: str, box: Box, cell: float) -> DataFrame:
    """Pairs of a point and a zone that it lies in; lower borders belong to a zone, upper ones don't. A zone is in cells
    of its own level only and a point has one cell of each level, so no pair comes twice."""
    at = lambda v: F.floor(F.col(v) / size_at(F.col("cell_k"), cell))
    p = points.withColumn("cell_top", highest(zones, box, cell)).withColumn("cell_k", F.explode(F.sequence(F.lit(0), "cell_top"))).drop("cell_top")
    p = p.withColumn("cell_x", at(x)).withColumn("cell_y", at(y))
    pairs = p.join(celled(zones, box, cell), ["cell_k", "cell_x", "cell_y"])
    c = F.col
    return pairs.filter((c(x) >= c(box[0])) & (c(x) < c(box[2])) & (c(y) >= c(box[1])) & (c(y) < c(box[3]))).drop("cell_k", "cell_x", "cell_y", "cell_own")


def common_box(a: Box, b: Box) -> list[Column]:
    """What two overlapping boxes have in common."""
    return [F.greatest(a[0], b[0]).alias("ix0"), F.greatest(a[1], b[1]).alias("iy0"), F.least(a[2], b[2]).alias("ix1"), F.least(a[3], b[3]).alias("iy1")]


def area(x0: str, y0: str, x1: str, y1: str) -> Column:
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def scaled(df: DataFrame, box: Box, factor: float, names: Box) -> DataFrame:
    """Boxes scaled about their centres."""
    made = {}
    for lo, hi, nlo, nhi in ((box[0], box[2], names[0], names[2]), (box[1], box[3], names[1], names[3])):
        middle, half = (F.col(lo) + F.col(hi)) / 2, (F.col(hi) - F.col(lo)) * factor / 2
        made |= {nlo: middle - half, nhi: middle + half}
    return df.withColumns(made)


def rasterised(df: DataFrame, box: Box, size: float, all_touched: bool, keep: list[str]) -> DataFrame:
    """The pixels (px, py) of each box: those whose centre it holds, or all that it touches."""
    def axis(lo: str, hi: str) -> Column:
        a, b = F.col(lo) / size, F.col(hi) / size
        first, last = (F.floor(a), F.ceil(b) - 1) if all_touched else (F.ceil(a - 0.5), F.ceil(b - 0.5) - 1)
        return F.when(last >= first, F.sequence(first, last))

    out = df.select(*keep, axis(box[1], box[3]).alias("ys"), F.explode(axis(box[0], box[2])).alias("px"))
    return out.select(*keep, "px", F.explode("ys").alias("py"))


def met_pixels(df: DataFrame, key: str, box: Box) -> DataFrame:
    """The pixels (px, py; of size 1) that the common box of any two rows with different keys touches.

    Of two boxes that overlap the common one touches what both touch, and boxes that overlap and touch a pixel overlap
    in it. So pixels are asked one by one: two boxes overlap for certain if those that touch a pixel have more area in
    it than it has; only in the other pixels, which hold little, boxes are compared.
    """
    x0, y0, x1, y1 = box
    c = F.col
    rows = df.select(key, *box).filter(c(key).isNotNull()).withColumn("single", F.count(F.lit(1)).over(Window.partitionBy(key)) == 1)
    boxes = rows.groupBy(*box).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("single").alias("single"))
    twin = (c("lo") < c("hi")) & (c(x0) < c(x1)) & (c(y0) < c(y1))
    touched = rasterised(boxes.withColumn("twin", twin), box, 1, True, [*box, "lo", "hi", "single", "twin"])
    inner = (F.least(c(x1), c("px") + 1) - F.greatest(c(x0), c("px"))) * (F.least(c(y1), c("py") + 1) - F.greatest(c(y0), c("py")))
    # boxes whose key has others too may overlap those only, and so don't make certain
    held = touched.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(c("single"), inner)), F.lit(0.0)).alias("held"), F.max("twin").alias("twin"))
    sure = c("twin") | (c("held") > 1 + 1e-6)
    open_ = held.filter(~sure & (c("n") > 1)).select("px", "py")
    few = touched.join(open_, ["px", "py"], "left_semi").select("px", "py", *box, "lo", "hi")
    other = ("o_x0", "o_y0", "o_x1", "o_y1")
    both = few.join(few.toDF("px", "py", *other, "o_lo", "o_hi"), ["px", "py"]).filter(overlap(box, other, False) & (F.least("lo", "o_lo") < F.greatest("hi", "o_hi")))
    return held.filter(sure).select("px", "py").unionByName(both.select("px", "py").distinct())


def area_class(a: Column, limits: list[float]) -> Column:
    """Number of the class [limit, next limit) of an area; the last has no upper limit, 0 is below the first."""
    return sum((F.when(a >= x, 1).otherwise(0) for x in limits), F.lit(0)).cast("bigint")


# ---- rings: array<struct<x, y>>, closed ----


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2))


def ring_length(ring: Column) -> Column:
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.sqrt((p["b"]["x"] - p["a"]["x"]) ** 2 + (p["b"]["y"] - p["a"]["y"]) ** 2))


def rectangle(x0: str, y0: str, x1: str, y1: str) -> Column:
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def flat(ring: Column) -> Column:
    """The ring without heights."""
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def shape_features(a: Column, perimeter: Column, width: Column, height: Column, hull: Column, vertices: Column) -> list[Column]:
    """Compactness (with pi as 3.1416), box area, aspect (0 without height), solidity, vertices by area (null without area)."""
    return [
        F.try_divide(4 * 3.1416 * a, perimeter**2).alias("compactness"),
        (width * height).alias("bbox_area"),
        F.when(height != 0, width / height).otherwise(0.0).alias("aspect"),
        F.try_divide(a, hull).alias("solidity"),
        F.try_divide(vertices.cast("double"), a).alias("vertex_density"),
    ]


# ---- polygons: array of rings, the outer one first ----


def hole_count(rings: Column) -> Column:
    """Interior rings of a polygon."""
    return F.greatest(F.size(rings) - 1, F.lit(0)).cast("bigint")


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less those of the holes."""
    areas = F.transform(rings, ring_area)
    return F.aggregate(F.slice(areas, 2, 1 << 30), F.element_at(areas, 1), lambda a, x: a - x)


def geometry_type(points: Column) -> Column:
    """Of an array of points: a point, a closed ring of three corners or more, or else a line."""
    n = F.size(points)
    closed = (F.element_at(points, 1) == F.element_at(points, -1)) & (n >= 4)
    return F.when(n == 1, "Point").when(n < 1, None).when(closed, "Polygon").otherwise("LineString")


#: Metres; the sphere of an ellipsoid's mean radius, as spherical area is an approximation anyway.
MEAN_RADIUS = 6371008.8


def spherical_area(ring: Column, radius: float = MEAN_RADIUS) -> Column:
    """Square metres of a ring in degrees on a sphere: trapezoids between each side and the equator."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    side = lambda p: F.radians(p["b"]["x"] - p["a"]["x"]) * (2 + F.sin(F.radians(p["a"]["y"])) + F.sin(F.radians(p["b"]["y"])))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + side(p))) * (radius * radius / 2)


def ring_centroid(ring: Column) -> Column:
    """Centroid of a ring's area as struct<x, y>; of a ring without area its first point. Sums are taken from the first
    point on, so that large coordinates lose no digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, p):
        ax, ay, bx, by = p["a"]["x"] - x0, p["a"]["y"] - y0, p["b"]["x"] - x0, p["b"]["y"] - y0
        w = ax * by - bx * ay
        return F.struct((s["w"] + w).alias("w"), (s["x"] + w * (ax + bx)).alias("x"), (s["y"] + w * (ay + by)).alias("y"))

    return F.aggregate(pairs, start, add, lambda s: F.struct((x0 + F.coalesce(F.try_divide(s["x"], 3 * s["w"]), F.lit(0.0))).alias("x"), (y0 + F.coalesce(F.try_divide(s["y"], 3 * s["w"]), F.lit(0.0))).alias("y")))
