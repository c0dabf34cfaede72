"""Very many equal boxes: the queries compare distinct boxes once, or their pairs could never be gone through."""

import re

import duckdb
import pytest

from geoloom.operators import vector
from geoloom.queries import ORACLE_SQL, QUERIES

N = 60_000


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """All features are [0, 1) x [3, 7), all zones [0, 20) x [0, 20): 3.6 billion pairs."""
    d = str(tmp_path_factory.mktemp("copies"))
    spark.range(N).selectExpr("id * 7000 o_orderkey", "3L o_custkey", "double(if(id % 4 = 0, 200000, 1000)) o_totalprice").write.parquet(f"{d}/orders.parquet")
    spark.range(N).selectExpr("id * 1000 p_partkey").write.parquet(f"{d}/part.parquet")
    return d


CASES = {
    "spatial_groupby": ("n = 60000 AND first = 0 AND last = 59999 * 7000", N),
    "annotations_json": ("n = 60000 AND area = 60000 * 4", N),
    "overlap_area_sum": ("area = 4 AND water = 60000 * 4", N),
    "water_overlap_filter": ("true", 0),
    "zonal_mean": ("n = 60000 AND mean = 0.25", N),
    "zonal_water_filter": ("true", 0),
    "crs_mismatch": ("skipped = 2400000000", 1),
    "boundary_weights": ("neighbours = 59999 AND shared = 59999 * 9.0", N),
    "evaluate_frames": ("accuracy = 1 AND specificity = 1", 1),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_sums_over_many_equal_boxes(spark, copies, name):
    want, n = CASES[name]
    rows = QUERIES[name](spark, copies)
    assert rows.count() == n and rows.filter(f"NOT ({want})").count() == 0


@pytest.mark.parametrize("name", ("spatial_join_intersects", "overlay_intersection", "overlap_window", "within_area", "multi_mask_fold"))
def test_pairs_come_from_stacks(spark, monkeypatch, name, tmp_path):
    monkeypatch.setattr(vector, "STACK", 7)
    spark.range(30).selectExpr("id * 7000 o_orderkey", "3L o_custkey", "0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id * 1000 p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES[name](spark, str(tmp_path))
    n = 30 * 40 * (39 if name == "multi_mask_fold" else 1)
    keys = ["id", "zid", *(["zid2"] if name == "multi_mask_fold" else [])]
    assert rows.count() == n == rows.select(*keys).distinct().count()
    assert "collect_list" in rows._jdf.queryExecution().executedPlan().toString()


def test_intersecting_keys_are_exploded_from_plain_stacks(spark, monkeypatch, tmp_path):
    # an array of structs costs one more object for each of the rows
    monkeypatch.setattr(vector, "STACK", 7)
    spark.range(2000).selectExpr("if(id % 20 = 0, null, (id - 900) * 211) o_orderkey", "if(id % 20 = 1, null, (id - 900) * 37) o_custkey", "0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(900).selectExpr("if(id % 50 = 0, null, (id % 90 - 45) * 7) p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["spatial_join_intersects"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "explode(zids" in plan and "inline(" not in plan
    con = duckdb.connect()
    for name in ("orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["spatial_join_intersects"]).fetchall())
    assert len(want) > 300 and sorted(map(tuple, rows.collect())) == want


def test_two_stacks_are_not_unstacked_in_one_loop(spark, monkeypatch, tmp_path):
    # a generated loop holds all rows that it makes of one row: of two stacks the product of their sizes
    monkeypatch.setattr(vector, "STACK", 7)
    near = lambda m, n: f"id % 30 * {m} % 1000 + id % {n} - {n // 2}"
    spark.range(300).selectExpr(f"if(id % 20 = 0, null, {near(37, 9)} + id * 1000) o_orderkey", f"if(id % 20 = 1, null, {near(91, 11)}) o_custkey", "0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    # 30 boxes of about 22 zones, some of which come twice
    spark.range(700).selectExpr("if(id % 50 = 0, null, id % 30 + 1000 * (id div 30 % 20)) p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["multi_mask_fold"](spark, str(tmp_path))
    got = sorted(map(tuple, rows.collect()))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    loops = re.findall(r"(?:\*\((\d+)\) )?Generate (?:explode|inline)\([^,]*zids", plan)
    assert len(loops) == 2 and loops[0] and not loops[1]  # the upper one is in a loop, the one below in none
    con = duckdb.connect()
    for name in ("orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["multi_mask_fold"]).fetchall())
    assert len(want) > 300 and got == want


def test_stacks_hold_null_keys_and_no_null_boxes(spark):
    box = ("a", "b", "c", "d")
    df = spark.createDataFrame([(1, 0, 0, 1, 1), (None, 0, 0, 1, 1), (3, None, 0, 1, 1)], "k int, a int, b int, c int, d int")
    got = vector.stacked(df, box, "k").collect()
    assert len(got) == 1 and {x.k for x in got[0]["keys"]} == {1, None}


def test_met_pixels_against_pairs(spark):
    import random

    box, rng = ("x0", "y0", "x1", "y1"), random.Random(3)
    at = lambda: rng.randrange(80) / 4
    rows = []
    for i in range(90):
        x, y = at(), at()
        rows.append((i % 70, x, y, x + rng.randrange(9) / 4, y + rng.randrange(9) / 4))
    rows += [(200, 1.0, 1.0, 2.5, 2.5), (201, 1.0, 1.0, 2.5, 2.5), (None, 0.0, 0.0, 20.0, 20.0)]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    other = ("a0", "b0", "a1", "b1")
    pairs = df.join(df.toDF("o", *other), vector.overlap(box, other, False)).filter("id < o").select(*vector.common_box(box, other))
    want = vector.rasterised(pairs, ("ix0", "iy0", "ix1", "iy1"), 1, True, []).distinct()
    got = vector.met_pixels(df, "id", box)
    assert sorted(map(tuple, got.distinct().collect())) == sorted(map(tuple, want.collect())) and got.count() == got.distinct().count()
