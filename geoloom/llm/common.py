"""What the text operators share: carrying rows through Arrow batches, folds, hold-out rules, materialising."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and makes ASCII bytes that are neither letters nor digits a space, so that split() gives the
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
LOWER_WORDS = bytes(
    c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256)
)
#: Rows of a batch are worked on in pieces of about so many bytes, which bounds the memory of a task.
PIECE_BYTES = 2 << 20
#: Rows of an Arrow batch at most: Spark's default of 10,000 is made for rows of numbers, not for texts.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows if they are larger."""
    if not 0 < int(spark.conf.get(key := "spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_text(
    df: DataFrame,
    text: str,
    setup: Callable[[], Callable[[list], list]],
    fields: list[T.StructField],
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds ``fields``, made from the text column, to the columns of ``carry`` (default: all).

    ``setup()`` runs once in each task and returns f(texts), which takes a list of the texts' UTF-8 bytes
    (None for null) and returns one pyarrow array (or list) for each field. Narrow: no row changes place.
    A carried column with the name of a field is returned as ``<name>_in``.
    """
    small_batches(df.sparkSession)
    carry = df.columns if carry is None else carry
    n, sent = len(carry), text in carry and isinstance(df.schema[text].dataType, T.StringType)
    source = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(carry)], *([] if sent else [df[text].cast("string").alias("t")]))
    at = carry.index(text) if sent else n  # a text that is carried isn't sent twice
    schema = T.StructType([*source.schema.fields[:n], *[T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out_schema = setup(), None
        for batch in batches:
            for part in pieces(batch, at):
                made = work(part.column(at).cast(pa.binary()).to_pylist())
                if out_schema is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    kinds = [to_arrow_type(f.dataType) for f in fields]
                    out_schema = True
                arrays = [a if isinstance(a, pa.Array) and a.type == k else pa.array(a, k) for a, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], *arrays], [*[f"c{i}" for i in range(n)], *[f"r{i}" for i in range(len(arrays))]]
                )

    out = source.mapInArrow(run, schema)
    made = {f.name for f in fields}
    return out.select(
        *[F.col(f"c{i}").alias(f"{c}_in" if c in made else c) for i, c in enumerate(carry)],
        *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)],
    )


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (column ``at``) have about PIECE_BYTES; a longer text is alone in its slice."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def remainder(ids: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; -1 for a null id, which is then never in a hold-out."""
    return F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(by)).cast("int"), F.lit(-1))


def remainder_of(doc_id: int | None, by: int) -> int:
    """remainder() for a Python value."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what the context has. Where
    neither is set a local session, as in tests, gets a temporary one; a cluster gets an error."""
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


def materialised(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that neither a lost executor nor a later
    iteration computes them again. Spark removes the files when the DataFrame is no longer used if
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay in the folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written compressed to the shared folder and read again; for larger tables than materialised().
    The files stay until they are removed, as the returned DataFrame reads them."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a written table, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the hold-out (remainder 2 of 4), the
    first by a hash of the id. A document with several or null labels counts once, by its largest label; of several
    documents with one id only the smallest text counts.

    Only the ids are ordered and only ``bound`` of them (12 bytes each) are broadcast.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("l_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("l_id"), 4) != 2))
        .groupBy("l_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(bound)
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
