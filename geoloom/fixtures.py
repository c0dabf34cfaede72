"""Pixels, tiles, features and catalogs derived from the driver's tables: as DataFrames, and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .registry import Tables

# ---- yearly pixels with a validity mask ----
PIXELS = """SELECT CAST(user_id % 16 AS BIGINT) AS r, CAST(hour(ts) AS BIGINT) AS c, CAST(2019 + 2 * (day(ts) % 3) AS BIGINT) AS y,
 max(value / 500.0) AS p, CAST(min(CASE event_type WHEN 'error' THEN 0 ELSE 255 END) AS BIGINT) AS m FROM events GROUP BY 1, 2, 3"""


def pixels(t: Tables) -> DataFrame:
    e = t.events.selectExpr("cast(user_id % 16 as bigint) r", "cast(hour(ts) as bigint) c", "cast(2019 + 2 * (day(ts) % 3) as bigint) y", "value / 500.0D p", "case event_type when 'error' then 0L else 255L end m")
    return e.groupBy("r", "c", "y").agg({"p": "max", "m": "min"}).withColumnsRenamed({"max(p)": "p", "min(m)": "m"})


# ---- 8 x 8 tiles ----
TILES = """SELECT vec_id AS tile, CAST((p - 1) // 8 AS BIGINT) AS r, CAST((p - 1) % 8 AS BIGINT) AS c, CAST(embedding[p] AS DOUBLE) AS v
 FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)"""


def tiles(t: Tables) -> DataFrame:
    return t.embeddings.selectExpr("vec_id tile", "posexplode(embedding) as (p, v)").selectExpr("tile", "cast(p div 8 as bigint) r", "cast(p % 8 as bigint) c", "cast(v as double) v")


# ---- red and near-infrared bands ----
BANDS = """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 65536 AS red, CAST(floor(o_totalprice / 7) AS BIGINT) % 65536 AS nir FROM orders"""


def bands(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey id", "cast(floor(o_totalprice) as bigint) % 65536 red", "cast(floor(o_totalprice / 7) as bigint) % 65536 nir")


# ---- detected features and zones, as rectangles ----
RECTS = """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey % 1000 AS BIGINT) AS x0, CAST(o_custkey % 1000 AS BIGINT) AS y0,
 CAST(o_orderkey % 1000 + 1 + o_orderkey % 7 AS BIGINT) AS x1, CAST(o_custkey % 1000 + 1 + o_custkey % 5 AS BIGINT) AS y1 FROM orders"""
ZONES = """SELECT CAST(p_partkey AS BIGINT) AS zid, CAST((p_partkey * 37) % 1000 AS BIGINT) AS zx0, CAST((p_partkey * 91) % 1000 AS BIGINT) AS zy0,
 CAST((p_partkey * 37) % 1000 + 20 AS BIGINT) AS zx1, CAST((p_partkey * 91) % 1000 + 20 AS BIGINT) AS zy1 FROM part"""


def rects(t: Tables) -> DataFrame:
    return t.orders.selectExpr("cast(o_orderkey as bigint) id", "cast(o_orderkey % 1000 as bigint) x0", "cast(o_custkey % 1000 as bigint) y0", "cast(o_orderkey % 1000 + 1 + o_orderkey % 7 as bigint) x1", "cast(o_custkey % 1000 + 1 + o_custkey % 5 as bigint) y1")


def zones(t: Tables) -> DataFrame:
    return t.part.selectExpr("cast(p_partkey as bigint) zid", "cast((p_partkey * 37) % 1000 as bigint) zx0", "cast((p_partkey * 91) % 1000 as bigint) zy0", "cast((p_partkey * 37) % 1000 + 20 as bigint) zx1", "cast((p_partkey * 91) % 1000 + 20 as bigint) zy1")


# ---- centroids with an area ----
CENTROIDS = """SELECT c_custkey AS id, -140 + (c_custkey % 1000) / 1000.0 AS lon, 69 + (c_custkey % 777) / 1000.0 AS lat, abs(CAST(c_acctbal AS DOUBLE)) / 20 AS area FROM customer"""


def centroids(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey id", "-140 + (c_custkey % 1000) / 1000.0D lon", "69 + (c_custkey % 777) / 1000.0D lat", "abs(cast(c_acctbal as double)) / 20 area")


# ---- file catalog ----
FILES = """SELECT 'scenes/' || CAST(y AS VARCHAR) || '/ps_PSScene4Band_' || CAST(y AS VARCHAR) || '_' || replace(n_name, ' ', '-') || '_hist_composite.tif' AS path,
 CAST(y AS BIGINT) AS year, replace(n_name, ' ', '-') AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation, (SELECT unnest([2019, 2021, 2023]) AS y) WHERE (n_nationkey + y) % 5 <> 0"""


def files(t: Tables) -> DataFrame:
    n = t.nation.selectExpr("n_nationkey", "replace(n_name, ' ', '-') name", "explode(array(2019L, 2021L, 2023L)) year").filter("(n_nationkey + year) % 5 <> 0")
    return n.selectExpr("concat('scenes/', year, '/ps_PSScene4Band_', year, '_', name, '_hist_composite.tif') path", "year", "name", "cast(n_nationkey as bigint) k")


# ---- observed and predicted values ----
OBSERVED = """SELECT CAST(l_quantity AS DOUBLE) AS obs, CAST(l_extendedprice AS DOUBLE) / 2000 AS pred, l_returnflag AS grp FROM lineitem"""


def observed(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("cast(l_quantity as double) obs", "cast(l_extendedprice as double) / 2000 pred", "l_returnflag grp")


# ---- areas by distance ----
AREAS = """SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS area, CAST(o_orderkey % 300 AS BIGINT) AS dist FROM orders"""


def areas(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey id", "cast(o_totalprice as double) area", "cast(o_orderkey % 300 as bigint) dist")


# ---- two groups of values ----
GROUPS = """SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS v, c_mktsegment = 'FURNITURE' AS first FROM customer"""


def groups(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey id", "cast(c_acctbal as double) v", "c_mktsegment = 'FURNITURE' first")


# ---- training frames ----
FRAMES = "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS zone, CAST(p_size AS BIGINT) AS area FROM part"


def frames(t: Tables) -> DataFrame:
    return t.part.selectExpr("cast(p_partkey as bigint) id", "p_brand zone", "cast(p_size as bigint) area")


#: A reproducible pseudo-random number of an id in [0, 2^32), the same in both dialects.
DRAW = "(id * 2654435761) % 4294967296"
