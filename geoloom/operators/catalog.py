"""Catalogs of files: ids in names, pairing, worklists, plans of copies, logs. Expressions and joins over a table of
paths; nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def parent(path: Column, up: int = 1) -> Column:
    """The name of the folder ``up`` levels above the file."""
    return F.element_at(F.split(path, "/"), -1 - up)


def driver(path: Column) -> Column:
    """Format of a file by its extension; null for an unknown one."""
    e = extension(path)
    out = F.when(e.isin(".tif", ".tiff"), "GTiff")
    for ext, name in ((".vrt", "VRT"), (".jp2", "JP2OpenJPEG"), (".img", "HFA"), (".shp", "ESRI Shapefile"), (".gpkg", "GPKG")):
        out = out.when(e == ext, name)
    return out


def named(paths: DataFrame, prefix: str, suffix: str, ignore_case: bool = False) -> DataFrame:
    """Paths whose file name begins and ends so."""
    name = basename(F.col("path"))
    end = F.lower(name).endswith(suffix.lower()) if ignore_case else name.endswith(suffix)
    return paths.filter(name.startswith(prefix) & end)


def dem_id(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def image_id(name: Column) -> Column:
    """The third part from the end; null where there are fewer."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3))


def tile_pattern(id_: Column) -> Column:
    """A LIKE pattern of the file of tile 'row,col': signs become - or 0, numbers are padded with zeros."""
    row, col = F.split_part(id_, F.lit(","), F.lit(1)), F.split_part(id_, F.lit(","), F.lit(2))
    sign = lambda x: F.when(x.contains("-"), "-").otherwise("0")
    last2 = lambda x: F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).otherwise(F.translate(F.right(x, F.lit(2)), "-", "0"))
    row_part = F.when(F.length(row) >= 3, F.concat(F.lit("0"), F.translate(F.right(row, F.lit(3)), "-", "0"))).otherwise(F.concat(F.lit("00"), last2(row)))
    return F.concat(F.lit("%"), sign(row), row_part, F.lit("#_"), sign(col), F.lit("00"), last2(col), F.lit("%super.gpkg"))


def only_match(tiles: DataFrame, paths: DataFrame, id_: str = "id") -> DataFrame:
    """(id, path) of the tiles (id) that exactly one file of paths (path, named <row>_<column>...super.gpkg after a
    prefix of any kind) matches by tile_pattern. Files are cut where a tile's part can stand, so the join is one on
    equal text; each file belongs to one tile at most."""
    core = F.regexp_extract(basename(F.col("path")), r"([-0][0-9]{4}_[-0]00[0-9]{2})[^/]*super[.]gpkg$", 1)
    wanted = tiles.select(id_, F.regexp_replace(F.translate(tile_pattern(F.col(id_)), "%#", ""), "super.gpkg$", "").alias("core"))
    found = paths.select("path", core.alias("core")).filter("core <> ''").join(wanted, "core")
    return found.groupBy(id_).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select(id_, "path")


def match_lines(pairs: DataFrame, key: str = "path", found: str = "pair") -> DataFrame:
    """(place, line) of a match log: counts, then each name without a match, then each match in detail."""
    counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count(found).alias("m")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("total: "), F.col("n")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("matched: "), F.col("m")).alias("line")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit("unmatched: "), F.col("n") - F.col("m")).alias("line")),
    )).alias("x")).select("x.part", "x.line")
    none = F.col(found).isNull()
    names = pairs.select(F.when(none, 3).otherwise(4).alias("part"), F.when(none, F.concat(F.lit("no match: "), F.col(key))).otherwise(F.concat(F.col(key), F.lit(" -> "), F.col(found))).alias("line"))
    return counts.unionByName(names)


def required(df: DataFrame, what: str) -> DataFrame:
    """df, which must have a row: an empty one is an error at once. It looks for one row only."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("lw_rn", F.row_number().over(w)).filter("lw_rn = 1").drop("lw_rn")


def parse_list(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """(key, value) of the lines of exactly two words; of repeated keys the last."""
    words = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")
    two = lines.select(order, words.alias("w")).filter(F.size("w") == 2)
    return last_wins(two.select(F.col("w")[0].alias("key"), F.col("w")[1].alias("value"), order), "key", order).drop(order)


def most_common(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("mc_n"), F.min(order).alias("mc_first"))
    best = F.max_by(value, F.struct("mc_n", (-F.col("mc_first")).alias("f"))).alias(value)
    return n.groupBy(*by).agg(best) if by else n.agg(best)


def pending(worklist: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What of the worklist has no output yet."""
    return worklist.join(done.select(key), key, "left_anti")


def listed_images(lines: DataFrame, existing: DataFrame, folder: str, line: str = "line") -> DataFrame:
    """Paths named by a list: absolute ones as they are, others in the folder; missing files are left out. It is an
    error if none is there."""
    p = F.trim(F.col(line))
    paths = lines.select(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)).alias("path"))
    return required(paths.join(existing.select("path"), "path", "left_semi"), "image of the list").orderBy("path")


def frame_bands(bands: Column) -> tuple[Column, Column, Column]:
    """Image bands, label and weight of a training frame: all but the last two, the last but one, the last."""
    return F.slice(bands, 1, F.greatest(F.size(bands) - 2, F.lit(0))), F.element_at(bands, -2), F.element_at(bands, -1)


def seconds(time: Column) -> Column:
    """Seconds of a day from HHMMSS; null where it is no time."""
    t = F.when(time.rlike("^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]$"), time)
    return (F.substring(t, 1, 2).cast("int") * 3600 + F.substring(t, 3, 2).cast("int") * 60 + F.substring(t, 5, 2).cast("int")).cast("bigint")


def contains_join(files: DataFrame, ids: DataFrame, name: str, id_: str, length: int) -> DataFrame:
    """Pairs of a file and an id that its name holds, ids having one length: every stretch of a name of that length is
    looked up, which is an equi-join instead of a nested loop."""
    at = F.when(F.length(name) >= length, F.sequence(F.lit(1), F.length(name) - length + 1))
    cut = files.withColumn("cj", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col(name), i, F.lit(length))))))
    return cut.join(ids, F.col("cj") == F.col(id_)).drop("cj")
