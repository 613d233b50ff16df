"""Job status (W2), queue counters (A1) and log reports.

Job events are ``(job_id, queue, state, ts, seq, result, exc_info)``; one job
has few events, a queue has many.  Everything is an aggregate with map-side
partial aggregation (``max_by`` over a (time, seq) struct plans as a
sort-based one), so a busy queue or a chatty job cannot load one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiflow import constants as K


def job_status(events: DataFrame) -> DataFrame:
    """One row per job - latest state, when it was queued, started and
    ended, its result and error text.  An unknown job id has no row."""
    order = F.struct("ts", "seq")
    ended = F.col("state").isin(K.JOB_END_STATES)
    return events.groupBy("job_id").agg(
        F.max_by("queue", order).alias("queue"),
        F.max_by("state", order).alias("job_status"),
        F.min(F.when(F.col("state") == "queued", F.col("ts"))).alias("job_enqueued_at"),
        F.min(F.when(F.col("state") == "started", F.col("ts"))).alias("job_started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("job_ended_at"),
        F.max_by(F.col("result"), F.when(F.col("state") == "finished", order)).alias("job_result"),
        F.max_by(F.col("exc_info"), F.when(F.col("state") == "failed", order)).alias("job_exc_info"),
    )


def queue_counters(events: DataFrame, queues=tuple(K.QUEUES)) -> DataFrame:
    """A1: jobs per queue in each of the six states, zeros shown.

    The state of a job is its latest state (W2).  The six counts are
    conditional counts of one aggregate (no pivot job).  The known queues
    are added as all-zero rows before a final sum, so an idle queue shows and
    a queue missing from the list is still counted."""
    latest = job_status(events)
    cols = [c for _, c in K.JOB_STATE_COLUMNS]
    counts = latest.groupBy("queue").agg(*[
        F.count_if(F.col("job_status") == state).alias(col)
        for state, col in K.JOB_STATE_COLUMNS
    ])
    zeros = events.sparkSession.createDataFrame(
        [(q, *([0] * len(cols))) for q in queues],
        "queue string, " + ", ".join(f"{c} bigint" for c in cols))
    return (counts.unionByName(zeros).groupBy("queue")
                  .agg(*[F.sum(c).cast("bigint").alias(c) for c in cols]))


def log_report(logs: DataFrame, by=("logger_session_id", "level")) -> DataFrame:
    """Log rows per session and level, with the first and last time."""
    return logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


def log_rows(records: DataFrame, created: str = "created") -> DataFrame:
    """Log records with an epoch ``created`` become rows with a naive
    timestamp (session time zone), level, logger name and message."""
    return records.select(
        "logger_session_id",
        F.timestamp_seconds(F.col(created)).cast("timestamp_ntz").alias("timestamp"),
        "level", "logger_name", "message",
    )
