"""Documents: new/known/missing by content key, insert-if-absent, the pending
work list, per-company listings and counts.

Joins are written as plain equi-joins on ``hash_id`` (a 64-character key)
over narrow rows; contents are joined by the callers that need them.  No side is broadcast by hand: a request list
or a stored-hash table has no size bound in the code, so AQE decides from the
measured size at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiflow import constants as K
from regiflow.operators.running import running_sums


def new_rows(listing: DataFrame, stored: DataFrame, key: str = "hash_id") -> DataFrame:
    """Listing rows whose key is not stored yet (anti-join placed before
    any costly step so nothing known is fetched again)."""
    return listing.join(stored.select(key), key, "left_anti")


def requested(stored: DataFrame, request: DataFrame, key: str = "hash_id") -> DataFrame:
    """Stored rows whose key is in the request (a semi-join, not an
    ``isin`` list; duplicates in the request do not duplicate rows)."""
    return stored.join(request.select(key), key, "left_semi")


def missing(request: DataFrame, stored: DataFrame, key: str = "hash_id") -> DataFrame:
    """Requested keys that are not stored.  Duplicates in the request
    stay duplicated; a non-empty result refuses the whole request."""
    return request.join(stored.select(key), key, "left_anti")


def keep_first(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the smallest ``order`` tuple, with
    the ``carry`` columns.  A ``min`` over a struct aggregates partially on
    the map side, so a key shared by a third of all rows (many copies of one
    document) leaves each map task as one row."""
    packed = F.min(F.struct(*[F.col(c) for c in (*order, *carry)])).alias("_first")
    return (df.groupBy(key).agg(packed)
              .select(key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *carry)]))


def insert_if_absent(incoming: DataFrame, existing: DataFrame, key: str = "hash_id",
                     order: Sequence[str] = ("record_created_at",),
                     carry: Sequence[str] = ()) -> DataFrame:
    """Rows to append so that ``key`` stays unique: the first of each key
    in ``incoming`` and none already in ``existing``.  Appending the result and
    running again appends nothing."""
    first = keep_first(incoming, key, order, carry)
    return first.join(existing.select(key), key, "left_anti")


def pending_work(listing: DataFrame, stored: DataFrame, key: str = "hash_id",
                 page: str = "page", position: str = "position",
                 page_size: int = K.LISTING_PAGE_SIZE) -> DataFrame:
    """What is left to fetch, in the listing's own order.

    A listing row's place is fixed by its page and its position on the page,
    so the work order is ``(page - 1) * page_size + position`` - a column, not
    a window over the company (which would put a hot company in one task).
    Consumers walk each company's rows by ``work_order``."""
    return new_rows(listing, stored, key).withColumn(
        "work_order", (F.col(page) - 1) * F.lit(page_size) + F.col(position))


def dense_order(pending: DataFrame, company: str = "krs_number", key: str = "hash_id") -> DataFrame:
    """``pending_work`` with ``place``, the number of a row among its
    company's pending rows, from 1 without gaps, and ``ahead``, how many there
    are before it.  By running sums, so no company is put into one task."""
    summed = running_sums(pending, [company], ["work_order", key], {"ahead": F.lit(1)})
    return summed.withColumn("place", F.col("ahead") + 1)


def next_pending(pending: DataFrame, company: str = "krs_number") -> DataFrame:
    """The cursor's next row of each company: least ``work_order`` (a partial
    aggregate, so a company with a third of the rows is one row per map task
    before the shuffle)."""
    cols = [c for c in pending.columns if c not in (company, "work_order")]
    first = F.min(F.struct("work_order", *cols)).alias("_next")
    return (pending.groupBy(company).agg(first)
                   .select(company, *[F.col(f"_next.{c}").alias(c) for c in ("work_order", *cols)]))


def per_company_count(df: DataFrame, company: str = "krs_number",
                      name: str = "documents") -> DataFrame:
    """A2: stored documents per company."""
    return df.groupBy(company).agg(F.count(F.lit(1)).alias(name))


def available_listing(stored: DataFrame) -> DataFrame:
    """The listing served for a company.  ``document_name`` carries the
    document *type*, as the service answers; the type is also kept."""
    return stored.select(
        "krs_number",
        F.col("document_type").alias("document_name"),
        "document_type",
        "document_date_from",
        "document_date_to",
        F.col("hash_id").alias("document_hash_id"),
    )


def nested_listing(stored: DataFrame, entries_per_chunk: int) -> DataFrame:
    """A4: the listing of each company nested in rows of about
    ``entries_per_chunk`` entries: ``(krs_number, chunk, n_chunks, entries,
    document_list)``, ``entries`` counting the company's whole listing.

    The number of chunks comes from a partial count; an entry's chunk is its
    key's first eight hex digits modulo that number.  So every entry is in one
    list, however many a company has, and no task collects a company whole."""
    flat = available_listing(stored)
    counts = flat.groupBy("krs_number").agg(F.count(F.lit(1)).alias("entries"))
    chunks = counts.withColumn("n_chunks", F.ceil(F.col("entries") / F.lit(entries_per_chunk)).cast("long"))
    spread = flat.join(chunks, "krs_number").withColumn(
        "chunk", F.conv(F.substring("document_hash_id", 1, 8), 16, 10).cast("long") % F.col("n_chunks"))
    entry = F.struct("document_name", "document_date_from", "document_date_to", "document_hash_id")
    return (spread.groupBy("krs_number", "chunk")
                  .agg(F.first("n_chunks").alias("n_chunks"), F.first("entries").alias("entries"),
                       F.sort_array(F.collect_list(entry)).alias("document_list")))


def document_record(rows: DataFrame, created_at=None) -> DataFrame:
    """A fetched listing row as a stored document record (the
    source's row id is dropped; timestamps default to now, which a retried
    task writes anew - pass ``created_at`` for rows that a rerun repeats)."""
    ts = F.current_timestamp() if created_at is None else F.lit(created_at)
    ts = ts.cast("timestamp_ntz")
    return rows.select(
        F.col("document_hash_id").alias("hash_id"),
        "krs_number",
        F.col("internal_element_id").alias("document_internal_id"),
        "document_type",
        "document_name",
        F.col("document_from").alias("document_date_from"),
        F.col("document_to").alias("document_date_to"),
        "document_status",
        "document_content_save_name",
        "document_content_file_extension",
        *(["n_bytes"] if "n_bytes" in rows.columns else []),
        ts.alias("record_created_at"),
        ts.alias("record_updated_at"),
    )


def key_collisions(rows: DataFrame, key: str = "document_hash_id",
                   parts: Sequence[str] = ("krs_number", "document_type", "document_name",
                                           "document_from", "document_to")) -> DataFrame:
    """Content keys shared by different part tuples (the key has no
    separator, so ``'ab'+'c'`` equals ``'a'+'bc'``)."""
    return (rows.groupBy(key)
                .agg(F.count_distinct(F.struct(*parts)).alias("part_tuples"))
                .filter(F.col("part_tuples") > 1))
