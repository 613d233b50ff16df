"""Table schemas of the data model."""

from pyspark.sql import types as T

# Times of versions are UTC wall-clock times (timestamp_ntz), whatever the
# session time zone.
RAW_EXTRACT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("record_created_at", T.TimestampNTZType(), True),
    T.StructField("is_current", T.BooleanType(), True),
    T.StructField("krs_number", T.StringType(), False),
    T.StructField("raw_data", T.StringType(), False),
])

DOCUMENT_LISTING_ROW = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("document_name", T.StringType()),
    T.StructField("document_from", T.StringType()),
    T.StructField("document_to", T.StringType()),
    T.StructField("document_status", T.StringType()),
    T.StructField("internal_element_id", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("hash_id", T.StringType(), False),
    T.StructField("krs_number", T.StringType()),
    T.StructField("document_internal_id", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("document_name", T.StringType()),
    T.StructField("document_date_from", T.StringType()),
    T.StructField("document_date_to", T.StringType()),
    T.StructField("document_status", T.StringType()),
    T.StructField("document_content_save_name", T.StringType()),
    T.StructField("document_content_file_extension", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("record_created_at", T.TimestampNTZType()),
    T.StructField("record_updated_at", T.TimestampNTZType()),
])

# Bytes live in their own table keyed by hash_id so listings never read them.
DOCUMENT_CONTENT = T.StructType([
    T.StructField("hash_id", T.StringType(), False),
    T.StructField("document_content", T.BinaryType()),
])

LOG_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("logger_session_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger_name", T.StringType()),
    T.StructField("message", T.StringType()),
])

JOB_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("result", T.StringType()),
    T.StructField("exc_info", T.StringType()),
])

LANDED_RESPONSES = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("headers", T.StringType()),
    T.StructField("body", T.StringType()),
])

BULLETINS = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("body", T.StringType()),
])

CHANGE_EVENTS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Value of a change event (JSON converter, no schema wrapper).
CHANGE_ROW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("record_created_at", T.StringType()),
    T.StructField("is_current", T.BooleanType()),
    T.StructField("krs_number", T.StringType()),
    T.StructField("raw_data", T.StringType()),
])
CHANGE_ENVELOPE = T.StructType([
    T.StructField("before", CHANGE_ROW),
    T.StructField("after", CHANGE_ROW),
    T.StructField("op", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
])

QUEUE_COUNTERS = T.StructType(
    [T.StructField("queue", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in (
        "jobs_enqueued", "jobs_started", "jobs_deferred",
        "jobs_scheduled", "jobs_failed", "jobs_finished")]
)
