"""A corpus pipeline over ``documents``: quality rules, exact dedup, SimHash
near-dedup, secret scan, best-fit packing.

Each stage takes the documents that the stage before it kept and returns the
ones it keeps, with the columns of ``documents``; the last returns packed
pieces.  Between stages the documents are written as Parquet and read again,
so a lost executor costs at most the stage that is running.

Defined results: an empty table gives no rows at every stage; columns of any
name pass through all stages but the last; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiflow.llm import exact_dedup, packing, quality_rules, secret_scan, simhash
from regiflow.llm.common import materialize
from regiflow.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts do (no
    words).  Repeated rows share a verdict; null ids do not matter."""
    return quality_rules.keep_sound(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays; null
    ids sort below all others.  Of rows that share id and text one stays.  A
    null text equals the empty one."""
    return exact_dedup.deduplicated(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints at most 2 bits apart the one with
    the smallest id stays (null ids last; of rows that share it the first in
    the table's files).  Texts without a word have fingerprint 0."""
    return simhash.deduplicated(spark, docs, shingle_words=3, max_distance=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a marker; no document goes.  A null
    text stays null, and so does its ``n_chars``."""
    return (secret_scan.redact(spark, docs)
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token sequences of at most 2048.  Null and empty texts
    are the separator alone; repeated rows are packed each; null ids stay."""
    return packing.pack_documents(spark, docs, TOKENIZER, capacity=2048)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: EM, fingerprints, linked secrets and token ids cannot be written in SQL;
#: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
