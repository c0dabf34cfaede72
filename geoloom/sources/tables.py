"""Readers and writers: raster tables by tile, feature tables, file catalogs, texts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER = "raster_id string, band int, r bigint, c bigint, value double"
FEATURES = "id bigint, geom array<struct<x:double,y:double>>, xmin double, ymin double, xmax double, ymax double, crs string"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context; where neither is set a local session, as in tests, gets a
    temporary one, and a cluster an error. Checkpoints go there."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (now.get() if now.isDefined() else None)
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
    if not now.isDefined():
        context.setCheckpointDir(path)
    return path


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modified, size) of files below a folder; only the listing is read, no content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def newest(files: DataFrame) -> DataFrame:
    """The file changed last, of equal times the last by name."""
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def decode_files(files: DataFrame, decode: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """(path, error, the schema's columns) of files (path, content): a file that can't be decoded gives one row with
    its error, and the others go on."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kinds: StructType = _parse_datatype_string(schema)
    names = kinds.fieldNames()

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, None, *r) for r in decode(bytes(content))]
                except Exception as e:  # noqa: BLE001  whatever a decoder raises is the file's error
                    rows = [(path, f"{type(e).__name__}: {e}", *[None] * len(names))]
                # file by file: a batch may hold many
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "error", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def parted(df: DataFrame, by: list[str], key: str, part: str, most: int) -> DataFrame:
    """Adds part, a number from 0 on that cuts the rows of each group into parts of about ``most``, dealt by a hash of
    the key. Groups up to ``most`` rows stay whole."""
    many = df.groupBy(*[F.col(c).alias(f"many_{c}") for c in by]).agg(F.count(F.lit(1)).alias("many_n")).filter(F.col("many_n") > most)
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"many_{c}"))
    n = F.coalesce(F.ceil(F.col("many_n") / most), F.lit(1))
    return df.join(many, on, "left").select(*df.columns, F.pmod(F.xxhash64(key), n).alias(part))


def write_raster(df: DataFrame, path: str, mode: str = "error") -> None:
    """A raster table, a folder for each raster and band; rows in order, so that row groups cover few tiles."""
    out = df.select("raster_id", "band", "r", "c", "value").repartition("raster_id", "band").sortWithinPartitions("raster_id", "band", "r", "c")
    out.write.mode(mode).partitionBy("raster_id", "band").option("compression", "zstd").parquet(path)


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A raster table; bands prune folders, the window (column, row, width, height) is pushed to the files."""
    df = spark.read.schema(RASTER).parquet(path)
    if bands is not None:
        df = df.filter(F.col("band").isin(bands))
    if window is not None:
        x, y, w, h = window
        df = df.filter(F.col("c").between(x, x + w - 1) & F.col("r").between(y, y + h - 1))
    return df


def write_features(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rings with the columns of their bounding box, sorted by it, so that readers can skip row groups."""
    x, y = F.transform("geom", lambda p: p["x"]), F.transform("geom", lambda p: p["y"])
    boxed = df.withColumns({"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)})
    boxed.repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin").write.mode(mode).option("compression", "zstd").parquet(path)


def read_features(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features whose bounding box meets a box: a filter on plain columns, pushed to the files."""
    df = spark.read.parquet(path)
    if box is not None:
        x0, y0, x1, y1 = box
        df = df.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    return df


def write_once(df: DataFrame, path: str) -> DataFrame:
    """The table at the path: written if there is none yet, else read as it is."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def described(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Columns with descriptions as metadata, as bands have."""
    out = df
    for name, text in texts.items():
        out = out.withMetadata(name, {"description": text})
    return out


def union_view(parts: list[DataFrame], name: str) -> DataFrame | None:
    """A view over several layers by column name; None, and no view, of no layers."""
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.createOrReplaceTempView(name)
    return out
