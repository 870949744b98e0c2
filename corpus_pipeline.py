"""The corpus pipeline: stages over documents, each working on all that its predecessor kept.

Stage by stage: language identification drops texts without a letter or without a language; the near-duplicate
join keeps one document of each group; decontamination cuts benchmark passages out of texts and drops documents that
consist of them; personal data is replaced by its kind; best-fit packing turns the texts into training sequences. Every
stage but the last returns the columns of ``documents``, and writes through Parquet, so a lost executor or a restart
costs one stage at most. An empty table passes through all stages; null texts are dropped by the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowframe.durable import shared_folder
from rowframe.llm import decontam, jaccard, langid, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter, or is mostly noise: neither of the languages learned.

    Texts are read whole, however long. Rows that repeat all stay or go; an empty table stays empty; columns of any
    name pass as they are.
    """
    held = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    kept = langid.identify_documents(held, noise=True).where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of copies and near copies.

    Texts are read whole, however long; null and empty ones all stay. Of rows that repeat one stays; an empty table stays empty; columns of any
    name pass as they are.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; drops documents that are mostly such passages.

    Texts are read whole, however long; null and empty ones stay. Rows that repeat are cut alike; an empty table stays empty; columns of any
    name pass as they are.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; keeps every document.

    Texts are read whole, however long; null and empty ones stay as they are. Rows that repeat are changed alike; an empty table stays empty; columns of any
    name pass as they are.
    """
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences: one row for each piece of a document.

    Texts are read whole, however long; null and empty ones are one end token. Rows that repeat are
    packed each by itself; an empty table stays empty; columns of any
    name are left behind.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's rows are kept under the cluster's shared folder until the next stage has written its own; those of the
    last stage stay, since they are the result.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _remove(spark, before)
        before = out
    return docs
