"""Decisions on nulls, NaN, ties, borders and orders, each with a small case."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import catalog, grid, metrics, mosaic, ordered, pixel, stats, vector
from geoloom.plans import pipelines
from geoloom.sources import tables
from geoloom.streaming import ingest

NAN = float("nan")
col = F.col


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_index_without_a_sum_and_with_a_wrapping_one(spark):
    df = spark.createDataFrame([(0, 0), (40000, 30000), (10, 20)], "red long, nir long")
    got = values(df, pixel.ndvi(col("red"), col("nir")), pixel.ndvi(col("red"), col("nir"), True))
    assert got[0] == (None, None) and got[2][0] == pytest.approx(1 / 3)
    assert got[1] == (pytest.approx(-10000 / 70000), pytest.approx(-10000 / (70000 - 65536)))


def test_heights_nan_before_greatest(spark):
    df = spark.createDataFrame([(NAN,), (None,), (-3.0,), (2.76,)], "h double")
    assert values(df, pixel.dem_encode(col("h"))) == [(0,), (0,), (1,), (27,)]


def test_nan_is_never_above(spark):
    df = spark.createDataFrame([(NAN,), (0.5,), (None,)], "p double")
    assert values(df, pixel.threshold(col("p"), 0.5), pixel.above(col("p")), pixel.to_integer(col("p") * 5)) == [(None, 0, 0), (1, 0, 2), (None, 0, 0)]


def test_yearly_modes(spark):
    df = spark.createDataFrame([(0, 0.9, 255), (0, 0.7, 255), (1, 0.9, 255), (1, 0.9, 0), (2, NAN, 255)], "k int, p double, m int")
    assert sorted(values(pixel.yearly(df, ["k"], mode="presence"), "k", "n_obs", "presence")) == [(0, 2, 1), (1, 1, 0), (2, 0, 0)]
    assert sorted(values(pixel.yearly(df, ["k"]), "k", "valid")) == [(0, 1), (1, 1), (2, 0)]


def test_overlapping_patches(spark):
    df = spark.createDataFrame([(0, 0.4), (1, NAN), (2, 0.8)], "o int, v double")
    got = df.agg(*[grid.combine(n, "v", "o").alias(n) for n in ("MAX", "MIN", "MEAN", "other")]).first()
    assert (got.MAX, got.MIN, got.MEAN, got.other) == (0.8, 0.4, pytest.approx((0.2 + 0.8) / 2), 0.8)


def test_patch_offsets(spark):
    df = spark.createDataFrame([(1, 10, 10), (2, 4, 4)], "id int, w long, h long")
    count = lambda d: dict(values(d.groupBy("id").count(), "id", "count"))
    assert count(grid.patches(df, "w", "h", 4, 3)) == {1: 16, 2: 4}
    assert count(grid.patches(df, "w", "h", 4, 3, sequential=True)) == {1: 4, 2: 1}


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(100.0,), (2000.0,), (0.0,), (9999.0,)], "v double")
    assert values(df, stats.right_closed(col("v"), [100, 2000, 7000]), stats.right_closed(col("v"), [100, 2000, 7000], True)) == [(None, 0), (0, 0), (None, None), (None, None)]


def test_most_common_takes_the_first_seen_of_equals(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b")], "o long, v string")
    assert catalog.most_common(df, [], "v", "o").first().v == "b"


def test_rounding_halves_to_even(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 2.5)], "t double, p double")
    assert df.agg(*metrics.soft_counts(col("t"), col("p"))).first().tp == 2.0


def test_dice_of_an_empty_pixel_is_one(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "t double, p double")
    assert df.agg(metrics.pixel_dice(col("t"), col("p"))).first()[0] == 1.0


def test_overlay_takes_the_last_with_a_value(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -9.0)], "o int, v double")
    assert df.agg(grid.overlay_last("v", "o", -9.0)).first()[0] == 2.0


def test_touching_boxes(spark):
    a = spark.createDataFrame([(1, 0, 0, 2, 2)], "id int, x0 int, y0 int, x1 int, y1 int")
    b = spark.createDataFrame([(1, 2, 0, 4, 2), (2, 1, 1, 100, 100), (3, 3, 3, 4, 4)], "z int, u0 int, v0 int, u1 int, v1 int")
    box, other = ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")
    ids = lambda touch: sorted(r.z for r in vector.overlap_join(a, b, box, other, 1.5, touch).collect())
    assert ids(False) == [2] and ids(True) == [1, 2]


def test_running_total_does_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(40)], "id long, v double")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(values(ordered.running_total(df, "v", ["id"], col("v"), "s"), "id", "s")))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_nearest_in_time(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "a", 21)], "id long, k string, t long")
    c = spark.createDataFrame([(7, "a", 8), (5, "a", 12), (6, "a", 12), (9, "a", 30)], "cid long, k string, t long")
    got = {r.id: (r.cid, r.dt) for r in ordered.nearest_in_time(t, c, ["k"], "t", "id", "cid").collect()}
    assert got == {1: (5, 2), 2: (None, None), 3: (5, 9)}


def test_weighted_sampling_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 3.0)], "id long, w double")
    got = dict(values(ordered.weighted_sample(df, "id", "w", 2000).groupBy("id").count(), "id", "count"))
    assert 2 not in got and sum(got.values()) == 2000 and abs(got[3] - 1500) < 120


def test_split_sizes(spark):
    got = dict(values(ordered.split(spark.range(100), "id").groupBy("part").count(), "part", "count"))
    assert got == {"test": 20, "val": 16, "train": 64}


def test_parsing_names(spark):
    df = spark.createDataFrame([("230710_235959",), ("230710_246000",)], "n string")
    assert values(df, catalog.seconds(F.substring_index("n", "_", -1))) == [(86399,), (None,)]
    lines = spark.createDataFrame([(0, "a  1"), (1, "b"), (2, "c d e"), (3, " a 2 "), (4, "")], "n long, line string")
    assert values(catalog.parse_list(lines), "key", "value") == [("a", "2")]


def test_empty_aggregates(spark):
    none = spark.createDataFrame([], "t long, p long")
    cells = none.agg(*metrics.confusion(col("t"), col("p")))
    assert tuple(cells.select(*metrics.rates(*map(col, ("tn", "fp", "fn", "tp")))).first()) == (0, 0, 0)


def test_tables_and_listings(spark, tmp_path):
    p = f"{tmp_path}/raster"
    rows = spark.createDataFrame([("a", b, r, c, float(r * c)) for b in (1, 2) for r in range(4) for c in range(4)], tables.RASTER)
    tables.write_raster(rows, p)
    assert tables.read_raster(spark, p, bands=[2], window=(1, 2, 2, 2)).count() == 4
    assert tables.newest(tables.list_files(spark, p, "*.parquet")).first().path.endswith(".parquet")
    g = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)])], "id long, geom array<struct<x:double,y:double>>")
    tables.write_features(g, f"{tmp_path}/features")
    assert values(tables.read_features(spark, f"{tmp_path}/features", (0.5, 0.5, 2, 2)), "id") == [(1,)]
    once = f"{tmp_path}/once"
    assert tables.write_once(spark.range(3), once).count() == 3 == tables.write_once(spark.range(9), once).count()
    assert tables.union_view([], "nothing") is None and tables.union_view([spark.range(2), spark.range(3)], "u").count() == 5
    assert tables.described(spark.range(1), {"id": "band 1"}).schema["id"].metadata["description"] == "band 1"


def test_files_that_cannot_be_decoded(spark, tmp_path):
    for n, b in (("a", b"12"), ("b", b"x")):
        (tmp_path / n).write_bytes(b)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = tables.decode_files(files, lambda b: [(int(b),)], "v long").collect()
    assert sorted((r.v is None, r.error is None) for r in got) == [(False, True), (True, False)]


def test_work_that_is_done_is_skipped(spark):
    assert catalog.pending(spark.range(5), spark.range(3), "id").count() == 2


def test_configuration():
    assert pipelines.Config().validate()
    for bad in ({"stride": 9}, {"at": 2}, {"area_limits": (5.0, 1.0)}, {"beta": -1.0}):
        with pytest.raises(pipelines.ConfigError):
            pipelines.Config(**bad).validate()


def test_prediction_within_a_mask(spark):
    px = spark.createDataFrame([(1, r, c, 0.1) for r in range(20) for c in range(20)], "image long, r long, c long, v double")
    images = spark.createDataFrame([(1, 20, 20)], "image long, w long, h long")
    mask = spark.createDataFrame([(1, 0, 0, 3, 3)], "image long, mx0 long, my0 long, mx1 long, my1 long")
    config = pipelines.Config(stride=8)
    assert pipelines.predict(images, px, None, config).count() == 400
    assert pipelines.predict(images, px, mask, config).count() == 64


def test_files_are_taken_up_once(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(src)
        ingest.append(ingest.new_rows(spark, src, spark.range(1).schema), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_a_value_that_all_rows_have_is_dealt_to_many_ranges(spark):
    df = spark.range(20_000).selectExpr("id", "1 v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert ordered.ranged(df, "v", ["id"]).select("range_no").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.s for r in ordered.row_numbers(df, "v", ["id"], "s").collect()} == set(range(1, 20_001))


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 0, 6, 3])], "id long, w double")
    got = ordered.weighted_sample(df, "id", "w", 20_000)
    n = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert n.keys() == {1, 3, 4} and sum(n.values()) == 20_000
    assert all(abs(n[i] / 20_000 - share) < 0.02 for i, share in ((1, 0.1), (3, 0.6), (4, 0.3)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ordered.weighted_sample(df.repartition(7), "id", "w", 20_000).collect()))


def test_p_of_t_against_numerical_integration(spark):
    import math

    from geoloom.operators import stats

    def want(t, n, steps=200_000):
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        h = t / steps
        return 1 - 2 * h * c * sum((1 + ((i + 0.5) * h) ** 2 / n) ** (-(n + 1) / 2) for i in range(steps))

    rows = [(t, n) for t in (0.0, 0.3, 1.0, 2.5, 4.0) for n in (1, 2, 3, 4, 7, 30, 801, 802)]
    got = spark.createDataFrame([(float(t), n) for t, n in rows], "t double, n int").select("t", "n", stats.t_two_sided(col("t"), col("n")).alias("p")).collect()
    assert all(abs(r.p - want(r.t, r.n, 4_000)) < 1e-4 for r in got)


def test_shortest_interval_and_regression_of_few_points(spark):
    from geoloom.operators import stats

    df = spark.createDataFrame([(1, v) for v in (0.0, 9.0, 10.0, 11.0, 30.0)] + [(2, 5.0), (3, None)], "g int, v double")
    got = {r.g: (r.low, r.high) for r in stats.hdi(df, "v", ["g"], 0.5).collect()}
    assert got == {1: (9.0, 11.0), 2: (5.0, 5.0)}
    xy = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 0.0, 0.0), (3, 1.0, 1.0), (3, 2.0, 1.0)], "g int, x double, y double")
    p = {r.g: r.p for r in stats.regression(xy, "x", "y", ["g"]).collect()}
    assert p[1] is None and p[2] == 0.0 and 0.3 < p[3] < 0.34


def test_polygons_with_holes_and_geometry_types(spark):
    from geoloom.operators import vector

    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = lambda a, b: F.array(p(a, a), p(b, a), p(b, b), p(a, b), p(a, a))
    one = spark.range(1)
    r = one.select(vector.polygon_area(F.array(box(0, 10), box(1, 2), box(4, 6))).alias("area"), vector.hole_count(F.array(box(0, 10), box(1, 2), box(4, 6))).alias("holes"), vector.polygon_area(F.array(box(0, 3))).alias("plain")).first()
    assert (r.area, r.holes, r.plain) == (95.0, 2, 9.0)
    kinds = one.select(*[vector.geometry_type(g).alias(k) for k, g in (("a", box(0, 1)), ("b", F.slice(box(0, 1), 1, 4)), ("c", F.array(p(0, 0))))]).first()
    assert tuple(kinds) == ("Polygon", "LineString", "Point")
    c = one.select(vector.ring_centroid(box(1e6, 1e6 + 2)).alias("c"), vector.spherical_area(box(0, 0)).alias("s")).first()
    assert (c.c.x, c.c.y, c.s) == (1e6 + 1, 1e6 + 1, 0.0)


def test_empty_lists_are_errors(spark):
    there = spark.createDataFrame([("scenes/a.tif",)], "path string")
    assert catalog.listed_images(spark.createDataFrame([(" a.tif ",), ("b.tif",)], "line string"), there, "scenes").count() == 1
    with pytest.raises(ValueError, match="image of the list"):
        catalog.listed_images(spark.createDataFrame([("b.tif",)], "line string"), there, "scenes")


def test_only_match_wants_one_file(spark):
    tiles = spark.createDataFrame([("113,17",), ("-5,8",), ("7,7",)], "id string")
    names = ["x/a_00113_00017_super.gpkg", "x/a_-0005_00008_super.gpkg", "x/b_-0005_00008_super.gpkg", "x/00113_00017.gpkg"]
    got = catalog.only_match(tiles, spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [tuple(r) for r in got] == [("113,17", names[0])]


def test_spline_reproduces_a_plane_inside(spark):
    px = spark.createDataFrame([(1, r, c, 2.0 * r + 3.0 * c) for r in range(9) for c in range(9)], "k int, r long, c long, v double")
    got = mosaic.warped(px, ["k"], 4, 4, lambda x, y: (x * 0.5 + 3, y * 0.5 + 3), "spline").collect()
    assert len(got) == 16
    for q in got:
        assert q["v"] == pytest.approx(2 * ((q["r"] + 0.5) * 0.5 + 2.5) + 3 * ((q["c"] + 0.5) * 0.5 + 2.5))
    with pytest.raises(ValueError, match="no resampling"):
        mosaic.warped(px, ["k"], 4, 4, lambda x, y: (x, y), "lanczos")


def test_written_mask_has_nodata_outside_areas_and_without_a_value(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.1), (1, 0, 2, None), (1, 0, 3, 0.9), (2, 0, 0, 0.9)], "image long, r long, c long, p double")
    areas = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.0)], "image long, ax0 double, ay0 double, ax1 double, ay1 double")
    got = {(q["image"], q["c"]): q["mask"] for q in pipelines.written_mask(p, pipelines.Config(), areas).collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (1, 2): 255, (1, 3): 255, (2, 0): 255}


def test_joins_of_boxes_of_any_size_find_each_pair_once(spark):
    import random

    draw = random.Random(5)

    def boxes(n):
        out = []
        for k in range(n):
            size = draw.choice([0.5, 3, 40, 900, 20000])
            x, y = draw.uniform(-1000, 1000), draw.uniform(-1000, 1000)
            out.append((k, x, y, x + size * draw.random(), y + size * draw.random()))
        return [*out, (n, None, 0.0, 1.0, 1.0), (n + 1, -1e9, -1e9, 1e9, 1e9)]

    a, b = boxes(120), boxes(90)
    names = lambda p: (f"{p}x0", f"{p}y0", f"{p}x1", f"{p}y1")
    left, right = (spark.createDataFrame(rows, ", ".join([f"{p} long", *[f"{c} double" for c in names(p)]])) for rows, p in ((a, "a"), (b, "b")))
    whole = lambda rows: [r for r in rows if None not in r]
    want = sorted((p[0], q[0]) for p in whole(a) for q in whole(b) if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    got = vector.overlap_join(left, right, names("a"), names("b"), 10.0)
    assert sorted(got.columns) == sorted(left.columns + right.columns)
    assert sorted((q["a"], q["b"]) for q in got.collect()) == want
    assert {q["a"] for q in vector.semi(left, right, "a", names("a"), names("b"), 10.0).collect()} == {p for p, _ in want}
    points = left.selectExpr("a p", "ax0 x", "ay0 y").filter("x IS NOT NULL")
    inside = sorted((p[0], q[0]) for p in whole(a) for q in whole(b) if q[1] <= p[1] < q[3] and q[2] <= p[2] < q[4])
    assert sorted((q["p"], q["b"]) for q in vector.points_in(points, right, "x", "y", names("b"), 10.0).collect()) == inside
    assert vector.celled(right, names("b"), 10.0).groupBy("b").count().filter("count > 9").isEmpty()
    assert vector.overlap_join(left, right.limit(0), names("a"), names("b"), 10.0).isEmpty()


def test_sampler_draws_the_normal_posterior(spark):
    rows = spark.createDataFrame([(k % 2 == 0, float(k % 10) + (3 if k % 2 == 0 else 0)) for k in range(200)], "g boolean, v double")
    known = {r["g"]: (r["m"], r["s"], r["n"]) for r in rows.groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n")).collect()}
    sd = sum(s * s / (n + 1) for _, s, n in known.values()) ** 0.5  # values and prior are normal with the group's deviation
    posterior = stats.group_difference_posterior(rows, "g", "v")
    got = posterior.agg(F.avg("difference").alias("m"), F.stddev("difference").alias("s"), F.count("difference").alias("n")).first()
    assert got["n"] == 2000
    assert got["m"] == pytest.approx(known[True][0] - known[False][0], abs=0.25 * sd)
    assert got["s"] == pytest.approx(sd, rel=0.2)
    assert {tuple(r) for r in posterior.collect()} == {tuple(r) for r in stats.group_difference_posterior(rows.repartition(5), "g", "v").collect()}
