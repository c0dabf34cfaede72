"""Incremental runs: new files of scenes or events taken up as they arrive. An addition of this library: the batch
operators' rule that finished outputs are skipped becomes a checkpoint of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_rows(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append(stream: DataFrame, out: str, checkpoint: str):
    """Writes what is there now to Parquet and stops; files taken up once aren't taken up again."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Numbers of rows in windows of time; a window is closed, and its state dropped, once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
