"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage reads what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import decontaminate, line_dedup, line_quality, mixing, near_copies
from siltbed.llm.common import drop, stored, table

#: At most so many keys of documents, of some 50 bytes, are sent to every worker; more are joined by a shuffle.
MOST_KEYS = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents; the others lose their failing lines.

    Null, empty and short texts are rejected. Rows are judged one by one, so repeated rows and null ids make no
    difference; columns besides those of documents are dropped; an empty table gives an empty table.
    """
    judged = docs.withColumn("_q", line_quality.judge(F.col("text"))).where("_q.kept")
    return _with_text(judged, F.col("_q.clean_text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated and near-repeated lines but for the earliest, and documents that keep no line.

    Null and empty texts have no line and go. Rows with the same id, text, lang and source are one document and keep
    the same lines; a null id comes first in the order. An empty table gives an empty table.
    """
    found = line_dedup.dedup_lines(docs, also=("lang", "source")).where("n_lines > n_removed")
    return _with_text(found, F.col("clean_text"))


def _with_key(docs: DataFrame) -> DataFrame:
    """docs with the key of a document: its id, null after all others, and a hash of its text; fields match null to null."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    It is the one with the smallest doc_id, then the smallest hash of the text; one with a null doc_id stays only if no
    other is in its group. Different texts under one id are different documents. Of rows with the same id and text one
    stays, of any lang and source they have.
    """
    d = _with_key(docs)
    found = near_copies.first_copies(d).where("key = first").select("key").distinct()
    return d.join(found, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents, also those with a null doc_id; other texts under the same id stay.

    A null or empty text has no words and stays. Repeated rows stay or go together. An empty table gives an empty
    table, and an empty benchmark drops nothing.
    """
    d = _with_key(docs)
    found = decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark"), id_col="key").where("contaminated")
    found = stored(found.select(F.col("doc_id").alias("key")).distinct())
    few = found.limit(MOST_KEYS + 1).count() <= MOST_KEYS  # then the texts need no shuffle
    return d.join(F.broadcast(found) if few else found, "key", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per draw with the columns of documents, pass, shard and place, the order within the shard.

    A document drawn twice gives two rows, one that is not drawn none. A null source is a source of its own; null and
    empty texts have size 0 and are drawn with their block. Rows that share id and source are drawn together. An empty
    table gives an empty table.
    """
    mixed = mixing.mix(docs, also=("text", "lang", "n_chars"))
    return mixing.shuffled(mixed).select(*COLUMNS, "pass", "shard", "place")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result but the last is written to the shared folder, and dropped once the next one is."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="siltbed-"))
        shared = context.getCheckpointDir()
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            if before is not None:
                drop(before)
            before = docs = spark.read.parquet(f"{folder}/{i}")
    return docs
