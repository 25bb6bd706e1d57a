"""Corpus pipeline over documents: what it keeps is clean, single, uncontaminated, redacted and coded.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written
and read again before the next. Rows with a null id or text fail the quality rules' word count or
pass through like any other; of rows with one id and one text, one stays, and rows of one id and
unlike texts are unlike documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontam, jaccard, quality, secrets
from eventloom.llm.catalog import tokenizer_path
from eventloom.session import materialise, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 1_000_000  # ids to drop by a broadcast (16 MB), else by a shuffle


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the (doc_id, v) of gone, v the hash of the text."""
    gone = materialise(gone.select(F.col("doc_id").alias("_d"), F.col("v").alias("_v")), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, (F.xxhash64("text") == F.col("_v")) & docs["doc_id"].eqNullSafe(F.col("_d")), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; their features and texts are laid down in one pass."""
    feats = materialise(quality.features(docs.select(*COLUMNS), carry=("text", "source", "n_chars")), "quality")
    return quality.judged(feats, quality.references(feats)).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that of the smallest id, ids before null, then by text; all rows without words.

    Rows of one id and one text are one row, the least by its other columns; rows of one id and unlike texts all stay.
    """
    docs = docs.select(*COLUMNS)
    groups = materialise(jaccard.grouped(docs).where("group is not null").select("doc_id", "v", "group"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("v").alias("v"))
    first = materialise(groups.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).where("rows > 1"), "first")
    few = first.count() <= BROADCAST_ROWS
    of = materialise(groups.join(F.broadcast(first) if few else first, "group").withColumn("gone", rank != F.col("first")), "of")
    docs = _without(docs, of.where("gone").select("doc_id", "v").distinct())
    again = materialise(of.where("not gone").groupBy("doc_id", "v").count().where("count > 1").select("doc_id", "v"), "again")
    if again.limit(1).count():
        few = again.count() <= BROADCAST_ROWS
        many = again.select(F.col("doc_id").alias("_d"), F.col("v").alias("_v"))
        same = (F.xxhash64("text") == F.col("_v")) & docs["doc_id"].eqNullSafe(F.col("_d"))
        row = docs.join(F.broadcast(many) if few else many, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
        docs = _without(docs, again).unionByName(row.select("doc_id", "text", "r.*").select(*COLUMNS))
    return docs.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0").select("doc_id", F.col("_v").alias("v")).distinct()).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars counted anew where one was."""
    return secrets.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.tokenised(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("BPE encoding and decoding", token_stage),
]
# The reference histograms, word tokenizers and merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
