"""Landed responses (S6) and the change-event topic (S3).

Fetching is not part of this package: whatever fetches the request plans
lands each answer as a row ``(request_id, url, status_code, headers, body,
fetched_at)``.  These readers give those rows typed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiflow import schemas

# The extract address carries company and registry (see constants.EXTRACT_*_URL).
_EXTRACT_URL = r"/api/krs/(OdpisAktualny|OdpisPelny)/([^?/]+)\?rejestr=([^&]+)"

LANDED = T.StructType(schemas.LANDED_RESPONSES.fields + [
    T.StructField("fetched_at", T.TimestampType()),
])


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed responses from files (parquet or JSON lines), fixed schema."""
    reader = spark.read.schema(LANDED)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def extract_responses(landed: DataFrame) -> DataFrame:
    """Landed extract answers with company, registry and kind taken from the
    address; the body stays text (parsed to a variant where it is read)."""
    url = F.col("url")
    kind = F.regexp_extract(url, _EXTRACT_URL, 1)
    return landed.filter(url.rlike(_EXTRACT_URL)).select(
        "request_id",
        F.regexp_extract(url, _EXTRACT_URL, 2).alias("krs_number"),
        F.regexp_extract(url, _EXTRACT_URL, 3).alias("registry"),
        F.when(kind == "OdpisAktualny", F.lit("aktualny")).otherwise(F.lit("pelny")).alias("extract_kind"),
        "status_code",
        F.col("fetched_at").alias("ts"),
        F.xxhash64("request_id").alias("response_id"),
        "body",
    )


def kafka_changes(spark: SparkSession, servers: str, topic: str,
                  starting_offsets: str = "earliest") -> DataFrame:
    """S3: the change-event topic as ``key string, value string`` (needs the
    Kafka connector on the classpath; it is not installed in this image)."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic)
           .option("startingOffsets", starting_offsets)
           .load())
    return raw.select(F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"))
