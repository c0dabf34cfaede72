import numpy as np

from geoloom.operators import mosaic


def test_scenes_against_interpolation(spark):
    rng = np.random.default_rng(1)
    base = {(r, c): int(v) for (r, c), v in np.ndenumerate(rng.integers(0, 40, (12, 12)))}
    for c in range(6, 12):
        for r in range(12):
            base[r, c] = 0  # nodata on the right
    scenes = {}
    for s, (r0, c0) in enumerate([(0, 0), (2, 7), (50, 50)]):
        scenes |= {(s, r0 + r, c0 + c): int(v) for (r, c), v in np.ndenumerate(rng.integers(0, 9, (4, 4)))}
    a = spark.createDataFrame([(s, 1, r, c, v) for (s, r, c), v in scenes.items()], "scene int, band int, r int, c int, v int")
    b = spark.createDataFrame([(1, r, c, v) for (r, c), v in base.items()], "band int, r int, c int, ref int")
    got = {(x.scene, x.r, x.c): (x.matched, x.status) for x in mosaic.match_scenes(a, b).collect()}
    assert got.keys() == scenes.keys()
    for s, status in ((0, "matched"), (1, "whole basemap"), (2, "outside the basemap")):
        mine = {k: v for k, v in scenes.items() if k[0] == s}
        ref = [base[k[1:]] for k, v in mine.items() if v and base.get(k[1:])] if s == 0 else [v for v in base.values() if v]
        iv, ic = np.unique([v for v in mine.values() if v], return_counts=True)
        rv, rc = np.unique(ref, return_counts=True)
        out = dict(zip(iv.tolist(), np.interp(np.cumsum(ic) / ic.sum(), np.cumsum(rc) / rc.sum(), rv).tolist(), strict=True))
        for k, v in mine.items():
            want = 0 if not v else v if s == 2 else out[v]
            assert got[k][1] == status and abs(got[k][0] - want) < 1e-9


def test_the_last_scene_with_a_value_stays(spark):
    a = spark.createDataFrame([(0, 1, 1, 0, 0, 5.0), (0, 2, 1, 0, 0, 0.0), (0, 3, 1, 0, 1, 0.0)], "g int, scene int, band int, r int, c int, v double")
    assert {(x.c, x.v) for x in mosaic.mosaicked(a, ["g"], "v", "scene").collect()} == {(0, 5.0), (1, None)}


def joins(df):
    """What a broadcast join of the plan copies to all tasks, as the first of its lines of the plan's text."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastExchange[^\n]*\n[^\n]*(?:\n[^\n]*){0,9}", text)


def test_pixels_are_never_broadcast(spark, monkeypatch):
    # arrays of pixels look small to the planner, however many rows they make
    from geoloom.queries import QUERIES

    for name in ("warp_nearest", "warp_bilinear", "warp_spline"):
        for few in (200_000, 0):
            monkeypatch.setattr(mosaic, "FEW_PLACES", few)
            got = joins(QUERIES[name](spark, "/root/testdata/sf0.001"))
            assert len(got) == bool(few) and all("Range" in x and "Generate" not in x and "FileScan" not in x for x in got), name


def test_raster_copy_broadcasts_no_pixels(spark):
    from geoloom.queries import QUERIES

    assert not any("embedding" in x for x in joins(QUERIES["raster_copy"](spark, "/root/testdata/sf0.001")))


def test_warped_either_way(spark, monkeypatch):
    px = spark.createDataFrame([(g, r, c, float(g + r * 5 + c)) for g in range(3) for r in range(5) for c in range(6) if (r + c + g) % 4] + [(None, 0, 0, 1.0)], "g int, r int, c int, v double")
    for how in ("nearest", "bilinear", "spline"):
        made = []
        for few in (200_000, 0):
            monkeypatch.setattr(mosaic, "FEW_PLACES", few)
            made.append(sorted((x.g, x.r, x.c, round(x.v, 9)) for x in mosaic.warped(px, ["g"], 7, 4, lambda x, y: (x * 1.3, y * 0.7), how).collect()))
        assert made[0] == made[1] and made[0]
