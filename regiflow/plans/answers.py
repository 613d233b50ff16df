"""The service's read answers as Spark reads, one function per question.

A user of the register service asks: which documents of a company are stored,
what state is a job in, how busy are the queues, what is the current record of
a company, give me these documents.  Each function answers one of those over
the tables this package writes; filters on the company or job reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiflow.operators import documents, jobs, versions
from regiflow.plans import flows, requests
from regiflow.streaming.changes import VERSION_ORDER, flatten_company


def available_documents(records: DataFrame, krs: str) -> DataFrame:
    """Stored documents of one company: name (the type, as served), dates and
    content key.  An unknown company gives no rows."""
    return documents.available_listing(records.filter(F.col("krs_number") == F.lit(krs))).select(
        "document_name", "document_date_from", "document_date_to", "document_hash_id")


def job_status_of(job_events: DataFrame, job_id: str) -> DataFrame:
    """State, times, result and error of one job; no row for an unknown id."""
    return jobs.job_status(job_events.filter(F.col("job_id") == F.lit(job_id)))


def queue_information(job_events: DataFrame) -> DataFrame:
    """Jobs per queue in each of the six states."""
    return jobs.queue_counters(job_events)


def company_information(history: DataFrame, krs: str) -> DataFrame:
    """The company record flattened from the current version of one company
    (no row when the company is unknown)."""
    one = history.filter(F.col("krs_number") == F.lit(krs))
    return flatten_company(versions.current_rows(one, "krs_number", VERSION_ORDER))


def changes_of_days(bulletins: DataFrame) -> DataFrame:
    """Companies changed in the landed bulletins, ten-digit keys."""
    return requests.changed_companies(bulletins)


def download_documents(spark: SparkSession, store_root: str, hash_ids: DataFrame):
    """Archives of the requested documents and the requested ids that are
    missing (a non-empty second frame refuses the request)."""
    return flows.download(spark, store_root, hash_ids)
