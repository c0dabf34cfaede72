"""Queries of file catalogs and of unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CENTROIDS, FILES, FRAMES, TILES, centroids, files, frames, tiles
from ..operators import catalog
from ..registry import query

col, r6 = F.col, lambda c: F.round(c, 6)


@query("directory_walk", f"SELECT path FROM ({FILES}) WHERE path LIKE '%/ps\\_PS%' ESCAPE '\\' AND path LIKE '%composite.tif' AND year > 2019")
def directory_walk(t):
    return catalog.named(files(t).filter("year > 2019"), "ps_PS", "COMPOSITE.TIF", ignore_case=True).select("path")


@query("glob_scan", f"SELECT path FROM ({FILES}) WHERE path GLOB 'scenes/2021/*A*.tif'")
def glob_scan(t):
    return files(t).filter(col("path").rlike(r"^scenes/2021/[^/]*A[^/]*\.tif$")).select("path")


@query("image_list", f"SELECT path FROM ({FILES}) WHERE k % 2 = 0")
def image_list(t):
    wanted = files(t).filter("k % 2 = 0").select(F.expr("concat(substring(path, 8), ' ')").alias("line"))
    missing = files(t).select(F.concat(F.lit("none_"), "name").alias("line"))
    return catalog.listed_images(wanted.union(missing), files(t), "scenes")


@query("list_parse", "SELECT n_name AS key, CAST(max(n_nationkey) AS VARCHAR) AS value FROM nation WHERE n_name NOT LIKE '% %' GROUP BY 1")
def list_parse(t):
    lines = t.nation.select(F.concat_ws("  ", "n_name", "n_nationkey").alias("line"), col("n_nationkey").alias("n"))
    more = t.nation.select(F.concat_ws(" ", "n_name", F.lit("old")).alias("line"), (col("n_nationkey") - 100).alias("n"))
    return catalog.parse_list(lines.union(more))


@query("frame_order", f"SELECT CAST(id AS VARCHAR) || '.tif' AS name, row_number() OVER (ORDER BY id) AS place FROM ({FRAMES})")
def frame_order(t):
    from ..operators.ordered import row_numbers

    names = frames(t).select(F.concat(col("id").cast("string"), F.lit(".tif")).alias("name"))
    numbered = names.withColumn("number", F.regexp_extract("name", r"^([0-9]+)\.", 1).cast("bigint"))
    return row_numbers(numbered, "number", ["name"], "place").select("name", "place")


_TILE = "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 13 % 130 - 9 AS BIGINT) AS r, CAST(n_nationkey * 7 % 60 - 20 AS BIGINT) AS c FROM nation"


@query("tile_pattern", f"""WITH t AS (SELECT k, CAST(r AS VARCHAR) AS r, CAST(c AS VARCHAR) AS c FROM ({_TILE}))
SELECT k, '%' || CASE WHEN r LIKE '-%' THEN '-' ELSE '0' END || CASE WHEN len(r) >= 3 THEN '0' || replace(right(r, 3), '-', '0') WHEN len(r) = 1 THEN '000' || r ELSE '00' || replace(right(r, 2), '-', '0') END
 || '#_' || CASE WHEN c LIKE '-%' THEN '-' ELSE '0' END || '00' || CASE WHEN len(c) = 1 THEN '0' || c ELSE replace(right(c, 2), '-', '0') END || '%super.gpkg' AS pattern FROM t""")  # fmt: skip
def tile_pattern(t):
    ids = t.nation.selectExpr("cast(n_nationkey as bigint) k", "concat(n_nationkey * 13 % 130 - 9, ',', n_nationkey * 7 % 60 - 20) id")
    return ids.select("k", catalog.tile_pattern(col("id")).alias("pattern"))


@query("most_recent", f"SELECT name, max(year) AS year, max(path) AS path FROM ({FILES}) GROUP BY name")
def most_recent(t):
    return files(t).groupBy("name").agg(F.max("year").alias("year"), F.max_by("path", "year").alias("path"))


@query("model_metadata", f"SELECT id, zone AS name, area AS epochs, CAST(128 AS BIGINT) AS patch FROM ({FRAMES})")
def model_metadata(t):
    j = frames(t).select("id", F.to_json(F.struct(col("zone").alias("name"), F.array(F.lit(128), F.lit(128)).alias("patch_size"), F.concat(col("area").cast("string"), F.lit("/100")).alias("epochs_trained"))).alias("j"))
    m = j.select("id", F.from_json("j", "name string, patch_size array<long>, epochs_trained string").alias("m"))
    return m.select("id", "m.name", F.split_part(col("m.epochs_trained"), F.lit("/"), F.lit(1)).cast("bigint").alias("epochs"), col("m.patch_size")[0].alias("patch"))


@query("id_parse", f"""SELECT path, 'ps' AS dem_id, split_part(path, '_', -3) AS image_id, regexp_extract(path, '_([0-9]{{4}})_', 1) AS year_text, right(replace(path, '.tif', ''), 5) AS suffix, split_part(path, '/', -2) AS folder FROM ({FILES})""")
def id_parse(t):
    p = col("path")
    name = catalog.basename(p)
    return files(t).select(p, catalog.dem_id(name).alias("dem_id"), catalog.image_id(name).alias("image_id"), F.regexp_extract(name, r"_([0-9]{4})_", 1).alias("year_text"), F.right(catalog.stem(p), F.lit(5)).alias("suffix"), catalog.parent(p).alias("folder"))


@query("extension_driver", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'GTiff' WHEN 1 THEN 'VRT' WHEN 2 THEN 'JP2OpenJPEG' END AS driver FROM customer")
def extension_driver(t):
    ext = F.element_at(F.array(*map(F.lit, (".TIF", ".vrt", ".jp2", ".xyz"))), (col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select(col("c_custkey").alias("id"), catalog.driver(F.concat(F.lit("a/b.c/x"), ext)).alias("driver"))


@query("time_difference", "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN abs((c_custkey % 24) * 3600 + (c_custkey % 60) * 60 + c_custkey % 59 - 43200) END AS dt FROM customer")
def time_difference(t):
    k = col("c_custkey")
    text = F.when(k % 9 == 0, "999999").otherwise(F.format_string("%02d%02d%02d", k % 24, k % 60, k % 59))
    return t.customer.select(k.alias("id"), F.abs(catalog.seconds(text) - catalog.seconds(F.lit("120000"))).alias("dt"))


@query("id_left_join", f"SELECT a.path, b.k AS dem FROM ({FILES}) a LEFT JOIN (SELECT name, max(k) AS k FROM ({FILES}) WHERE year = 2021 GROUP BY name) b ON a.name = b.name")
def id_left_join(t):
    dem = catalog.last_wins(files(t).filter("year = 2021").select("name", col("k").alias("dem")), "name", "dem")
    return files(t).join(dem, "name", "left").select("path", "dem")


@query("error_report", f"SELECT a.name, 'no file of 2021' AS error, count(*) AS n FROM ({FILES}) a WHERE a.name NOT IN (SELECT name FROM ({FILES}) WHERE year = 2021) GROUP BY 1")
def error_report(t):
    have = files(t).filter("year = 2021").select("name", F.lit(1).alias("there"))
    e = files(t).join(have, "name", "left").withColumn("error", F.when(col("there").isNull(), "no file of 2021"))
    return e.filter("error IS NOT NULL").groupBy("name", "error").agg(F.count(F.lit(1)).alias("n"))


@query("year_exists_join", f"SELECT a.name, a.year FROM ({FILES}) a JOIN (SELECT name, year FROM ({FILES}) WHERE k % 3 <> 0) b ON a.name = b.name AND a.year = b.year")
def year_exists_join(t):
    return files(t).select("name", "year").join(files(t).filter("k % 3 <> 0").select("name", "year"), ["name", "year"])


@query("substring_join", f"SELECT a.path, b.id FROM ({FILES}) a JOIN (SELECT DISTINCT left(name, 4) AS id FROM ({FILES})) b ON contains(a.path, b.id)")
def substring_join(t):
    ids = files(t).select(F.left("name", F.lit(4)).alias("id")).distinct()
    return catalog.contains_join(files(t).select("path"), ids, "path", "id", 4)


@query("pair_lookup", f"SELECT a.path, CASE WHEN k % 4 <> 0 THEN replace(path, '.tif', '_summary.tif') END AS pair FROM ({FILES}) a")
def pair_lookup(t):
    there = files(t).filter("k % 4 <> 0").select(F.regexp_replace("path", r"\.tif$", "_summary.tif").alias("pair"))
    return files(t).withColumn("want", F.regexp_replace("path", r"\.tif$", "_summary.tif")).join(there, col("want") == col("pair"), "left").select("path", "pair")


@query("zone_lookup", f"SELECT f.path, CAST(r.r_name AS VARCHAR) AS zone FROM ({FILES}) f JOIN nation n ON n.n_nationkey = f.k JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey < 3")
def zone_lookup(t):
    n = t.nation.select(col("n_nationkey").alias("k"), "n_regionkey")
    zones = t.region.filter("r_regionkey < 3").select(col("r_regionkey").alias("n_regionkey"), col("r_name").alias("zone"))
    return files(t).join(n, "k").join(zones, "n_regionkey").select("path", "zone")


@query("match_log", f"SELECT count(*) AS total, count(CASE WHEN k % 4 <> 0 THEN 1 END) AS matched, count(CASE WHEN k % 4 = 0 THEN 1 END) AS unmatched FROM ({FILES})")
def match_log(t):
    p = pair_lookup(t)
    return p.agg(F.count(F.lit(1)).alias("total"), F.count("pair").alias("matched"), F.count_if(col("pair").isNull()).alias("unmatched"))


@query("worklist_anti", f"SELECT path FROM ({FILES}) EXCEPT SELECT path FROM ({FILES}) WHERE year = 2023")
def worklist_anti(t):
    return catalog.pending(files(t).select("path"), files(t).filter("year = 2023"), "path")


@query("copy_plan", f"SELECT path AS src, replace(path, 'scenes/', 'subset/') AS a, replace(replace(path, 'scenes/', 'subset/'), '.tif', '_' || right(name, 5) || '.tif') AS dst FROM ({FILES})")
def copy_plan(t):
    a = F.regexp_replace("path", "^scenes/", "subset/")
    return files(t).select(col("path").alias("src"), a.alias("a"), F.concat(F.regexp_replace(a, r"\.tif$", "_"), F.right("name", F.lit(5)), F.lit(".tif")).alias("dst"))


@query("status_tally", f"SELECT count(CASE WHEN k % 3 = 0 THEN 1 END) AS success, count(CASE WHEN k % 3 = 1 THEN 1 END) AS missing, count(CASE WHEN k % 3 = 2 THEN 1 END) AS other FROM ({FILES})")
def status_tally(t):
    text = F.element_at(F.array(F.lit("written"), F.lit("error: no basemap here"), F.lit("error: timeout")), (col("k") % 3 + 1).cast("int"))
    s = files(t).select(text.alias("s"))
    bad, missing = col("s").startswith("error"), col("s").contains("no basemap")
    return s.agg(F.count_if(~bad).alias("success"), F.count_if(bad & missing).alias("missing"), F.count_if(bad & ~missing).alias("other"))


_CRS = f"SELECT area % 11 AS grp, 32600 + area % 3 + id % 2 AS crs, count(*) AS n, min(id) AS f FROM ({FRAMES}) GROUP BY 1, 2"


@query("mode_crs", f"SELECT grp, crs FROM (SELECT grp, crs, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS rn FROM ({_CRS})) WHERE rn = 1")
def mode_crs(t):
    f = frames(t).withColumn("grp", col("area") % 11).withColumn("crs", 32600 + col("area") % 3 + col("id") % 2)
    return catalog.most_common(f, ["grp"], "crs", "id").select("grp", "crs")


_MODE = f"SELECT size AS shape FROM (SELECT area % 5 AS size, count(*) AS n, min(id) AS f FROM ({FRAMES}) GROUP BY 1) ORDER BY n DESC, f LIMIT 1"


@query("majority_shape", f"SELECT id FROM ({FRAMES}) WHERE area % 5 = ({_MODE})")
def majority_shape(t):
    f = frames(t).withColumn("shape", col("area") % 5)
    return f.join(F.broadcast(catalog.most_common(f, [], "shape", "id")), "shape", "left_semi").select("id")  # one row


@query("top_one", f"SELECT size AS shape FROM ({_MODE.replace('size AS shape', 'size')})")
def top_one(t):
    return catalog.most_common(frames(t).withColumn("shape", col("area") % 5), [], "shape", "id")


@query("union_by_name", f"SELECT id, round(area, 4) AS area, lat FROM (SELECT id, area, round(lat, 4) AS lat FROM ({CENTROIDS}) UNION ALL SELECT id, CAST(area AS DOUBLE), NULL FROM ({FRAMES}))")
def union_by_name(t):
    a = centroids(t).select("id", "area", F.round("lat", 4).alias("lat"))
    b = frames(t).select(col("area").cast("double").alias("area"), "id")
    return a.unionByName(b, allowMissingColumns=True).withColumn("area", F.round("area", 4))


@query("chunk_union", f"SELECT tile % 3 AS layer, count(*) AS n, round(sum(v), 4) AS total FROM ({TILES}) GROUP BY 1")
def chunk_union(t):
    from functools import reduce

    layers = [tiles(t).filter(col("tile") % 3 == i).withColumn("layer", F.lit(i).cast("bigint")) for i in range(3)]
    return reduce(lambda a, b: a.unionByName(b), layers).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("drop_duplicates", f"SELECT zone, min(id) AS id FROM ({FRAMES}) GROUP BY zone")
def drop_duplicates(t):
    return frames(t).groupBy("zone").agg(F.min("id").alias("id"))


@query("group_concat", f"SELECT area, count(*) AS n FROM (SELECT area % 10 AS area FROM ({FRAMES}) UNION ALL SELECT CAST(trunc(area) AS BIGINT) % 10 FROM ({CENTROIDS})) GROUP BY area")
def group_concat(t):
    return frames(t).select((col("area") % 10).alias("area")).union(centroids(t).select((col("area").cast("bigint") % 10).alias("area"))).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@query("split_table_json", f"SELECT zone, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS frames FROM ({FRAMES}) GROUP BY zone")
def split_table_json(t):
    j = frames(t).groupBy("zone").agg(F.to_json(F.struct(F.array_sort(F.collect_list("id")).alias("training_frames"))).alias("j"))
    return j.select("zone", F.array_join(F.from_json("j", "training_frames array<string>")["training_frames"], ",").alias("frames"))


@query("run_metadata", f"SELECT zone AS model, count(*) AS runs, max(id) AS last_run, arg_max(area, id) AS last_loss, arg_min(id, (area, id)) AS best_run FROM (SELECT * FROM ({FRAMES}) WHERE id % 2 = 0 UNION ALL SELECT * FROM ({FRAMES}) WHERE id % 2 = 1) GROUP BY zone")
def run_metadata(t):
    # the runs so far, and new ones appended to them
    log, new = frames(t).filter("id % 2 = 0"), frames(t).filter("id % 2 = 1")
    return log.unionByName(new).groupBy(col("zone").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("last_run"), F.max_by("area", "id").alias("last_loss"), F.min_by("id", F.struct("area", "id")).alias("best_run"))


@query("match_report", f"""WITH p AS (SELECT path, CASE WHEN k % 4 <> 0 THEN replace(path, '.tif', '_summary.tif') END AS pair FROM ({FILES})) SELECT 0 AS part, 'total: ' || count(*) AS line FROM p UNION ALL SELECT 1, 'matched: ' || count(pair) FROM p
UNION ALL SELECT 2, 'unmatched: ' || (count(*) - count(pair)) FROM p UNION ALL SELECT 3, 'no match: ' || path FROM p WHERE pair IS NULL UNION ALL SELECT 4, path || ' -> ' || pair FROM p WHERE pair IS NOT NULL""")  # fmt: skip
def match_report(t):
    return catalog.match_lines(pair_lookup(t))


_ROWS = "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 13 % 130 + 100 AS VARCHAR) AS r, CAST(n_nationkey * 7 % 60 + 10 AS VARCHAR) AS c FROM nation"


@query("only_match", f"SELECT r || ',' || c AS id, 'super/B1_00' || r || '_000' || c || '_super.gpkg' AS path FROM ({_ROWS}) WHERE k % 3 <> 0")
def only_match(t):
    # every third tile has two files, and is left out
    rows = t.nation.selectExpr("n_nationkey k", "cast(n_nationkey * 13 % 130 + 100 as string) r", "cast(n_nationkey * 7 % 60 + 10 as string) c")
    name = lambda b: F.concat(F.lit(f"super/{b}_00"), "r", F.lit("_000"), "c", F.lit("_super.gpkg")).alias("path")
    paths = rows.select(name("B1")).union(rows.filter("k % 3 = 0").select(name("B2"))).union(rows.select(F.lit("super/readme.txt").alias("path")))
    return catalog.only_match(rows.select(F.concat_ws(",", "r", "c").alias("id")), paths)


@query("frame_bands", f"SELECT id, area || ',' || (area + 1) || ',' || (area + 2) AS image, area % 2 AS label, area % 3 AS weight FROM ({FRAMES})")
def frame_bands(t):
    bands = frames(t).select("id", F.array(col("area"), col("area") + 1, col("area") + 2, col("area") % 2, col("area") % 3).alias("bands"))
    image, label, weight = catalog.frame_bands(col("bands"))
    return bands.select("id", F.array_join(image.cast("array<string>"), ",").alias("image"), label.alias("label"), weight.alias("weight"))
