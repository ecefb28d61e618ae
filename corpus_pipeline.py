"""From raw documents to packed sequences: five stages, each one operator, each written and reread."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridscope.functions.tables import remove_folder
from gridscope.llm.common import load, shared_folder
from gridscope.llm.mixing import mixed_documents
from gridscope.llm.outliers import without_outliers
from gridscope.llm.packing import packed
from gridscope.llm.similar import without_similar
from gridscope.llm.toxicity import without_toxic

#: Rows of a batch that Spark sends to a Python worker. Texts are long, and a batch is there
#: several times at once: in the JVM, in the worker as it came, and as Python's own texts.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A stage stores its tables, so shuffle files are of no use once a table is written. Without this
#: they stay until the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words whose ids a worker remembers, some 110 MB; it keeps them when later work needs its memory.
REMEMBERED = 400_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with at most BATCH_ROWS rows in a batch and shuffle files removed with the query
    that wrote them, from then on, as its table is written later."""

    @functools.wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        spark.conf.set(CLEANUP_SETTING, "true")
        return stage(spark, docs, sf_dir)

    return limited


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't make them toxic."""
    return without_toxic(docs, load(spark, sf_dir, "labels"))


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return without_outliers(docs)


@in_small_batches
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles overlap by 0.8 or more."""
    return without_similar(docs)


@in_small_batches
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: whole documents, repeated ones, and stretches of a few."""
    return mixed_documents(docs)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packed(docs, REMEMBERED)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL can't express the trained and hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is Parquet in a new folder of the shared folder.

    A stage's result is removed once the next one is written; the last is the caller's to remove.
    The session's size of batches and handling of shuffle files are as before at the end.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    before_run = {name: spark.conf.get(name, None) for name in (BATCH_SETTING, CLEANUP_SETTING)}
    try:
        for number, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{number}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove_folder(spark, before)
            before = path
    finally:
        for name, value in before_run.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return docs
