"""Corpus pipeline: documents in, token counts and digests out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` writes each stage's result as Parquet into a
folder of its own under the shared folder of ``spark.checkpoint.dir`` and
reads it again as the next stage's documents, so a stage works on all that its
predecessor kept and a lost executor costs no earlier stage.

All stages but the last return the columns of ``documents``.  Rows with null
id pass the stages that decide by id; null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitcast.llm import bpe, decontaminate, simhash_dedup, suffix_dedup, toxicity_cnn
from visitcast.llm.common import show_workers_the_package, table
from visitcast.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity threshold of their language go.

    The classifier learns from the labelled documents of the stage's input.
    """
    show_workers_the_package(spark)
    net = toxicity_cnn.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_cnn.keep_clean(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    show_workers_the_package(spark)
    return simhash_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller id has go; n_chars follows."""
    show_workers_the_package(spark)
    return suffix_dedup.deduplicate(docs).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes."""
    show_workers_the_package(spark)
    return bpe.round_trip(docs, bpe.public_vocabulary(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

# Classifier, SimHash and tokenizer have no SQL form; tests/llm compares the
# rows of every stage with a plain version, those of the classifier with the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
