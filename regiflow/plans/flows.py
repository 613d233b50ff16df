"""The three lifecycles of the register service as Spark plans.

Each function only composes operators of this package; Catalyst plans the
whole composition at once.

* ``extract_refresh`` - refresh company extracts: request plan, first
  registry that answered, new versions for the history (E1).
* ``listing_refresh`` / ``files_to_records`` - refresh document listings:
  diagnose landed pages, read their rows, keep what is not stored, turn
  landed files into records (E2).
* ``download`` - requested documents from the store as archives, and the
  requested ids that are missing (E2, read side).
* ``daily_sweep`` - bulletins of the last days to the dispatch plan (E3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiflow import constants as K
from regiflow.functions import text, validate
from regiflow.operators import archives, documents, pages, versions
from regiflow.plans import requests
from regiflow.session import fresh_checkpoint_path
from regiflow.sources import tables
from regiflow.sources.landed import extract_responses


def extract_requests(companies: DataFrame, kind: str = "pelny", key: str = "krs_number") -> DataFrame:
    """E1 request plan: every valid company x both registries (P first);
    invalid keys go to quarantine with their reason."""
    checked = validate.with_reason(companies.select(key),
                                   validate.company_key_reason(F.col(key)))
    regs = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(r).alias("registry"))
                     for i, r in enumerate(K.REGISTRIES)])
    ok = checked.filter("valid").select(key, F.inline(regs))
    return ok.withColumn("url", requests.extract_url(F.col(key), F.col("registry"), kind))


def extract_refresh(companies: DataFrame, landed: DataFrame, key: str = "krs_number",
                    stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new versions, outcome per company).  With ``stored`` (the history
    so far) versions that it holds are left out, so a rerun appends nothing.
    A company key that fails F1 gets outcome ``invalid_<reason>`` (upstream
    raises) and no request.

    The version of a found company is the body of the latest 200 answer of
    the registry that stopped the walk; its id is derived from the request id
    (deterministic, so a rerun yields the same rows) and its time is the
    fetch time as UTC wall-clock time, the type of the history."""
    resp = extract_responses(landed)
    checked = validate.with_reason(companies.select(key).distinct(),
                                   validate.company_key_reason(F.col(key)))
    walked = versions.first_found(checked.filter("valid"), resp, key=key)
    invalid = checked.filter(~F.col("valid")).select(
        key, F.lit(None).cast("string").alias("registry"), F.lit(None).cast("int").alias("status_code"),
        F.concat(F.lit("invalid_"), F.col("reason")).alias("outcome"))
    outcome = walked.unionByName(invalid)
    found = outcome.filter(F.col("outcome") == "ok").select(key, "registry")
    answers = versions.current_rows(resp, [key, "registry"], ["ts", "response_id"])
    new_versions = answers.join(found, [key, "registry"], "left_semi").select(
        F.col("response_id").alias("id"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")).alias("record_created_at"),
        key,
        F.col("body").alias("raw_data"),
    )
    if stored is not None:
        new_versions = versions.unseen_versions(new_versions, stored, key)
    return new_versions, outcome


def parsed_listing(landed_pages: DataFrame) -> DataFrame:
    """Landed pages (``request_id, krs_number, page, body``) parsed once, with
    ``diagnosis`` and ``num_pages``.  The result (cells, no bodies) is written
    as Parquet in a new folder under the shared checkpoint root and read back,
    so rows, quarantine and missing pages do not run the parser again; the
    caller removes the folder when it is done with the run."""
    spark = landed_pages.sparkSession
    parsed = pages.parse_pages(landed_pages, "body", ["request_id", "krs_number", "page"])
    checks = pages.register_page_checks(F.col("title"))
    out = (parsed.withColumn("diagnosis", pages.diagnose(checks))
           .withColumn("num_pages", text.pages_count(F.col("pager_text"))))
    path = fresh_checkpoint_path(spark, "parsed_listing")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def listing_refresh(landed_pages: DataFrame, stored: DataFrame,
                    ) -> tuple[DataFrame, DataFrame]:
    """(diagnosis per landed page, pending listing rows).

    ``landed_pages`` carries ``request_id, krs_number, page, body``; only
    pages diagnosed 'ok' contribute rows; rows already stored (by content
    key) are dropped before anything is fetched.

    Both answers come from one parse of the pages (``parsed_listing``); its
    rows that are no listing rows are in ``pages.listing_quarantine``."""
    diagnosed = parsed_listing(landed_pages)
    diagnosis = diagnosed.select("request_id", "krs_number", "page", "diagnosis", "num_pages",
                                 pages.skipped_rows().alias("skipped_rows"))
    rows = pages.listing_rows(diagnosed.filter(F.col("diagnosis") == "ok"), keep=["request_id"])
    pending = documents.pending_work(rows.withColumnRenamed("document_hash_id", "hash_id"),
                                     stored.select("hash_id"))
    return diagnosis, pending


def files_to_records(pending: DataFrame, landed_files: DataFrame,
                     created_at=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed files (``hash_id, krs_number, content_disposition,
    content``) of pending rows -> (document records, contents, quarantine).

    The file name comes from the repaired header; a missing name or an error
    file goes to quarantine with its reason instead of stopping the job.  Of a
    file that landed more than once the one with the smallest digest counts.
    The joins are narrow: contents are read for their size and digest, and
    once more, by key and digest, where they are stored."""
    digest = F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256)
    landed = landed_files.select("hash_id", "content_disposition", digest.alias("_digest"),
                                 F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"))
    one = documents.keep_first(landed, "hash_id", ["_digest", "content_disposition"], ["n_bytes"])
    f = one.select(
        "hash_id", "_digest", "n_bytes",
        text.repair_reason(F.col("content_disposition")).alias("_repair"),
        text.file_name(text.repair_header(F.col("content_disposition"))).alias("save_name"))
    f = f.withColumn("reason", F.coalesce(F.col("_repair"), validate.file_name_reason(F.col("save_name"))))
    joined = pending.join(f, "hash_id", "inner")
    good, bad = validate.split_valid(joined)
    rows = good.select(
        F.col("hash_id").alias("document_hash_id"), "krs_number", "internal_element_id",
        "document_type", "document_name", "document_from", "document_to", "document_status", "n_bytes",
        F.col("save_name").alias("document_content_save_name"),
        text.file_extension(F.col("save_name")).alias("document_content_file_extension"))
    records = documents.document_record(rows, created_at)
    contents = (landed_files.withColumn("_digest", digest)
                .join(good.select("hash_id", "_digest"), ["hash_id", "_digest"], "left_semi")
                .select("hash_id", F.col("content").alias("document_content")).dropDuplicates(["hash_id"]))
    return records, contents, bad.select("hash_id", "krs_number", "reason")


def download(spark, store_root: str, request: DataFrame,
             part_bytes: int = archives.DEFAULT_PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """E2 read side: (archives of the requested documents, requested ids not
    stored).  As upstream, any missing id refuses the whole request: the first
    frame is then empty.  Only the request's prefix folders of the store are
    read, and the contents once."""
    prefixes = tables.prefixes_of(request)
    records = tables.read_store(spark, store_root, "records")
    contents = tables.read_store(spark, store_root, "contents")
    missing_ids = documents.missing(request.select("hash_id"),
                                    tables.stored_keys_near(records, request, prefixes=prefixes))
    found = tables.by_keys(records, request, prefixes=prefixes).select(
        "hash_id", "krs_number", "document_content_save_name", "n_bytes")
    if not missing_ids.isEmpty():
        found = found.limit(0)
    data = contents.filter(F.col(tables.PREFIX).isin(prefixes))
    return archives.build_from_store(found, data, part_bytes=part_bytes), missing_ids


def daily_sweep(bulletins: DataFrame, as_of=None, n_days: int | None = None) -> DataFrame:
    """Landed bulletins (of the ``n_days`` days ending at ``as_of``, when
    given) -> distinct changed companies -> two update requests each."""
    return requests.dispatch_plan(requests.changed_companies(bulletins, as_of=as_of, n_days=n_days))
