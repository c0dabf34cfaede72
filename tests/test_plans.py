"""Physical plans: joins are equi-joins, and filters and columns reach the scan."""

import re

import pytest

from geoloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPATIAL = (
    "spatial_join_intersects", "image_area_overlap", "patch_mask_semi", "overlay_intersection", "overlay_difference", "boundary_weights", "road_anti", "water_overlap_filter", "zonal_mean",
    "within_area", "multi_mask_fold", "cutline_clip", "pixel_aligned_join", "preprocess_frames", "asof_nearest", "substring_join", "histogram_match", "cumulative_area", "warp_bilinear",
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPATIAL)
def test_no_nested_loops(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    from geoloom.sources import tables

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = spark.createDataFrame([("a", 1, 0, 0, 1.0)], tables.RASTER)
    tables.write_raster(rows, f"{tmp_path}/r")
    p = plan(tables.read_raster(spark, f"{tmp_path}/r", bands=[1], window=(0, 0, 5, 5)).select("r", "value"))
    assert re.search(r"PartitionFilters: \[[^\]]*band", p) and "GreaterThanOrEqual(c,0)" in p and "LessThanOrEqual(r,4)" in p
    assert re.search(r"ReadSchema: struct<o_orderkey:[a-z()0-9,]+,o_totalprice:[a-z()0-9,]+>", plan(QUERIES["ndvi"](spark, SF)))


def test_expressions_stay_in_the_jvm(spark):
    for name in ("yearly_presence", "ndvi", "spatial_join_intersects", "patch_combine_mean", "morph_open_close", "asof_nearest", "mann_whitney", "equal_area_projection"):
        assert not re.search("Python|Arrow|Pandas", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ("overlay_intersection", "spatial_join_intersects", "multi_mask_fold"))
def test_pairs_that_make_many_rows_are_dealt_by_cell(spark, name):
    # a broadcast of the features left all rows to the one task that holds the few zones
    joins = re.findall(r"(\w+Join) \[cell_k", plan(QUERIES[name](spark, SF)))
    assert "SortMergeJoin" in joins and joins.count("SortMergeJoin") == 1
