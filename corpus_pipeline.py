"""Corpus pipeline: five stages, each one operator of ``skyweft.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. Rows without an id or text, repeated rows and empty
tables are handled as each operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweft.llm import bpe, decontaminate, langid, pii, simhash
from skyweft.plans.lineage import checkpoint_root
from skyweft.shipping import ship_package


#: Rows of a batch between the JVM and Python, at most: with Spark's 10000, buffers for the
#: texts of each running task take much of an executor's memory beside the heap.
BATCH_ROWS = 1000


def _bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batch rows to BATCH_ROWS. Plans are made after a stage has
    returned, so the setting stays; a smaller one is kept, 0 and less mean no limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no letters, or a calibrated
    score below one half."""
    ship_package(spark)
    _bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship_package(spark)
    _bounded_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    ship_package(spark)
    _bounded_batches(spark)
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced in the texts."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every text."""
    ship_package(spark)
    _bounded_batches(spark)
    return bpe.encode_decode(
        docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    )


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", token_ids),
]

#: Trained models and BPE have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        target = f"{checkpoint_root(spark)}/pipeline-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return docs
