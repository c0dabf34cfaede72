import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import grid, kernels, projection, vector


def pixels(spark, picture, raster=0):
    rows = [(raster, r, c, int(v)) for r, line in enumerate(picture) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "raster long, r long, c long, v long")


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def flood(a):
    lab = np.zeros(a.shape, int) - 1
    for start in zip(*np.nonzero(a), strict=True):
        if lab[start] < 0:
            stack, k = [start], lab.max() + 1
            while stack:
                r, c = stack.pop()
                if 0 <= r < a.shape[0] and 0 <= c < a.shape[1] and a[r, c] == a[start] and lab[r, c] < 0:
                    lab[r, c] = k
                    stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return lab


def test_diagonal_pixels_are_two_components(spark):
    p = pixels(spark, ["1100", "1100", "0011", "0011"]).filter("v = 1")
    assert kernels.labelled(p, "raster", 8).select("label").distinct().count() == 2


def test_a_blob_over_a_border(spark):
    p = pixels(spark, ["00000000", "00111100", "00000000"]).filter("v = 1")
    assert kernels.labelled(p, "raster", 4).select("label").distinct().count() == 1
    assert kernels.labelled(p, "raster", 4, across=False).select("label").distinct().count() == 2


@pytest.mark.parametrize("chunk", [2, 3, 16])
def test_components_do_not_depend_on_chunks(spark, chunk):
    a = np.random.default_rng(1).integers(0, 3, (13, 16))
    p = pixels(spark, ["".join(map(str, r)) for r in a]).filter("v > 0")
    want, got = flood(a), {}
    for r in kernels.labelled(p, "raster", chunk).collect():
        got.setdefault(r.label, set()).add(int(want[r.r, r.c]))
    assert all(len(s) == 1 for s in got.values()) and len(got) == want.max() + 1


def test_nodata_makes_no_feature_unless_asked_for(spark):
    p = pixels(spark, ["10", "02"]).withColumn("v", F.when(F.col("v") == 2, 255).otherwise(F.col("v")).cast("long"))
    assert kernels.polygonised(p, "raster", 4).count() == 1
    assert kernels.polygonised(p, "raster", 4, include_nodata=True).count() == 2


def test_rings_with_holes_and_diagonals(spark):
    a = np.random.default_rng(3).integers(0, 2, (9, 9))
    for f in kernels.polygonised(pixels(spark, ["".join(map(str, r)) for r in a]), "raster", 16).collect():
        areas = [abs(sum(p.x * q.y - q.x * p.y for p, q in zip(g, g[1:]))) / 2 for g in f.rings]
        assert areas[0] - sum(areas[1:]) == f.n
        assert all(g[0] == g[-1] for g in f.rings)
    ring = kernels.polygonised(pixels(spark, ["111", "101", "111"]), "raster", 4).first().rings
    assert [len(g) for g in ring] == [5, 5]


@pytest.mark.parametrize("radius,chunk", [(1, 4), (2, 5), (2, 64)])
def test_blocks_give_what_the_stencil_gives(spark, radius, chunk):
    a = np.random.default_rng(4).integers(0, 2, (11, 9))
    p = pixels(spark, ["".join(map(str, r)) for r in a])
    key = lambda df: sorted((r.r, r.c, r.v) for r in df.collect())
    assert key(kernels.open_close_blocks(p, "raster", radius, chunk)) == key(grid.open_close(p, ["raster"], radius))


def test_opening_removes_and_closing_fills(spark):
    dot = pixels(spark, ["0" * 9] * 4 + ["000010000"] + ["0" * 9] * 4)
    assert grid.open_close(dot, ["raster"], 1).agg(F.sum("v")).first()[0] == 0
    hole = pixels(spark, ["1" * 9] * 4 + ["111101111"] + ["1" * 9] * 4)
    assert grid.open_close(hole, ["raster"], 1).agg(F.min("v")).first()[0] in (0, 1)


def test_measures_of_shapes(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    ell = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
    rows = [("square", square), ("ell", ell), ("bow", [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])]
    df = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in g]) for n, g in rows], "name string, g array<struct<x:double,y:double>>")
    got = {r.name: r for r in df.select("name", vector.ring_area(F.col("g")).alias("a"), vector.ring_length(F.col("g")).alias("p"), vector.ring_area(kernels.convex_hull("g")).alias("h"), kernels.is_valid("g").alias("ok"), kernels.contains_point(F.col("g"), F.lit(1.5), F.lit(1.5)).alias("inside")).collect()}
    assert (got["square"].a, got["square"].p, got["square"].h) == (4, 8, 4)
    assert (got["ell"].a, got["ell"].p, got["ell"].h) == (3, 8, 3.5)
    assert got["square"].ok and got["ell"].ok and not got["bow"].ok
    assert got["square"].inside and not got["ell"].inside


def test_projections(spark):
    df = spark.createDataFrame([(-139.2, 69.5), (-141.0, 0.0), (-138.1, 83.0), (3.0, 45.0)], "lon double, lat double")
    zone = projection.utm_zone(F.col("lon"))
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), zone)
    ex, ey = projection.to_equal_area(F.col("lon"), F.col("lat"))
    p = df.select("*", zone.alias("zone"), x.alias("x"), y.alias("y"), ex.alias("ex"), ey.alias("ey"))
    lon, lat = projection.from_utm(F.col("x"), F.col("y"), F.col("zone"))
    elon, elat = projection.from_equal_area(F.col("ex"), F.col("ey"))
    rows = p.select("*", lon.alias("ulon"), lat.alias("ulat"), elon.alias("elon"), elat.alias("elat")).collect()
    for r in rows:
        assert np.allclose([r.ulon, r.ulat, r.elon, r.elat], [r.lon, r.lat] * 2, atol=1e-7)
    # published checks: the central meridian has easting 500 km; the equal-area grid reaches x = 17367530.45 at 180 degrees
    middle = next(r for r in rows if r.lon == 3.0)
    assert abs(middle.x - 500_000) < 1e-6 and abs(middle.y - 4_982_950.4) < 1
    edge = df.limit(1).select(*[c.alias(n) for c, n in zip(projection.to_equal_area(F.lit(180.0), F.lit(90.0)), "xy", strict=True)]).first()
    assert abs(edge.x - 17367530.45) < 0.1 and abs(edge.y - 7342230.14) < 0.1


def test_simplify_and_clip():
    dense = np.array([(0, 0), (1, 0.001), (2, 0), (2, 2), (1, 2), (0, 2), (0, 0)], float)
    assert len(kernels.simplify(dense, 0.01)) == 5
    window = np.array([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], float)
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float)
    c = np.array(kernels.clip(square, window))
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:]))) / 2 == 1
    assert kernels.clip(square + 10, window) == []


def test_frames_bent_and_seen_aslant():
    r, c = np.mgrid[:9, :13].astype(float)
    plane = 2 * r + 3 * c
    assert np.allclose(kernels.bent(plane, np.zeros((4, 4, 2))), plane)
    assert np.allclose(kernels.seen_aslant(plane, np.zeros((4, 2))), plane)
    moved = kernels.bent(plane, np.full((4, 4, 2), 0.1))  # everything by a tenth of height and width
    assert np.allclose(moved[:7, :11], (plane + 2 * 0.9 + 3 * 1.3)[:7, :11])
    near = kernels.seen_aslant(plane, np.full((4, 2), 1 / 9))  # the same on all sides: a cut-out, enlarged
    assert near[0, 0] == pytest.approx(2 * 1 + 3 * 13 / 9) and near[-1, -1] == pytest.approx(2 * 7 + 3 * (12 - 13 / 9))


def test_augmentation_repeats_and_keeps_constant_frames(spark):
    frames = spark.createDataFrame([(i, [float(5 if i < 40 else k) for k in range(64)]) for i in range(80)], "id long, v array<double>")
    runs = [{q["id"]: q["v"] for q in kernels.augmented(f, "id", "v", 8, 8, middle=5.0).collect()} for f in (frames, frames.repartition(7))]
    assert runs[0] == runs[1]
    assert all(np.allclose(runs[0][i], 5) for i in range(40))
    assert len({tuple(runs[0][i]) for i in range(40, 80)}) > 20


def test_blocks_are_gone_through_together(spark, monkeypatch):
    from geoloom.operators import kernels
    from geoloom.queries import QUERIES

    q = lambda: QUERIES["morph_blocks_r1"](spark, "/root/testdata/sf0.001")
    plan = q()._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan and "BroadcastExchange" not in plan
    many = sorted(map(tuple, q().collect()))
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(tuple, q().collect())) == many
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", (1 << 22, 40))
@pytest.mark.parametrize("step", (4, 1000))
def test_met_sums_against_pairs(spark, most, step):
    # boxes of all levels, across zero, some empty or inverted; 40 forces halving and pairs
    rng = np.random.default_rng(5)
    start = rng.integers(-30 * step, 30 * step, (300, 2)) / step
    side = np.where(rng.random((300, 2)) < 0.9, rng.integers(1, 8 * step, (300, 2)), rng.integers(-2 * step, 90 * step, (300, 2))) / step
    side[:6] = [[0, 1], [1, 0], [0, 0], [-3, 2], [2, -3], [-2, -2]]
    b = np.unique(np.concatenate([start, start + side], axis=1), axis=0)
    w = rng.integers(1, 4, len(b))
    df = spark.createDataFrame([(*map(float, x), int(n)) for x, n in zip(b, w, strict=True)] + [(None, 0.0, 1.0, 1.0, 1)], "x0 double, y0 double, x1 double, y1 double, copies long")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in kernels.met_sums(df, ("x0", "y0", "x1", "y1"), "copies", 5.0, most).collect()}
    q = b[:, None]
    hit = (q[..., 0] < b[:, 2]) & (b[:, 0] < q[..., 2]) & (q[..., 1] < b[:, 3]) & (b[:, 1] < q[..., 3])
    shared = np.prod(np.minimum(q[..., 2:], b[:, 2:]) - np.maximum(q[..., :2], b[:, :2]), axis=2)
    for x, n, area in zip(b, hit @ w, np.where(hit, shared, 0) @ w, strict=True):
        assert got[tuple(x)][0] == n and got[tuple(x)][1] == pytest.approx(area, abs=1e-9)
