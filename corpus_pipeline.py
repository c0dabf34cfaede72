"""Five stages over a corpus of documents: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
hands what it reads from there to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, decontaminate, pii, simhash, toxicity
from geoloom.llm.common import removed, shared_dir, written


def neutral(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with columns of names that clash with no operator's, and that of the text."""
    names = docs.columns
    return docs.toDF(*[f"k{i}" for i in range(len(names))]), f"k{names.index('text')}"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The lexicon is learned from the labelled rows among docs. Null and empty texts get
    the lowest score and stay; repeated rows are judged alike; without labels of both kinds, or without documents, none
    goes."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, text = neutral(docs)
    return toxicity.toxicity(rows, model, text).filter("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (op 10's links) stays, that with the smallest id. Null, empty and
    wordless texts are one group; of repeated rows one stays; rows without an id stay if their group has no id at all."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay; with an empty benchmark all do."""
    rows, text = neutral(docs)
    marked = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text)
    return marked.filter(~F.col("contaminated")).select(*rows.columns).toDF(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text where it changes.
    No document goes; null and empty texts stay as they are."""
    found = pii.find(docs.select(F.struct(*docs.columns).alias("row"), "text"), pii.fit(docs.select("doc_id", "text")))
    clean = found.select("row", pii.redacted(F.col("text"), F.col("spans")).alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("new") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return clean.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's tokens, with digests of the ids and of the text that they decode to. Null
    and empty texts have none; repeated rows and ids get a row each."""
    rows = bpe.encode(docs, carry=["doc_id"], decoded=True)
    return rows.select("doc_id", "ids", *bpe.digest(rows))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe_tokens", tokens),
]

#: SQL has neither the lexicon's learning, nor XXH64, nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again; only the last table stays."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), path := f"{folder}/{name}")
            if before:
                removed(spark, before)
            before = path
    except BaseException:  # nothing is left behind by a run that fails
        removed(spark, folder)
        raise
    return docs
