"""Registered queries: each operator run over the driver tables.

The driver tables hold no register data, so stand-ins are used, all derived
by Spark from the whole tables:

* company = ``events.user_id`` (zero-padded to ten digits), version id =
  ``event_id``, version time = ``ts``, extract document = ``props``;
* stored documents = ``orders`` (status, priority and dates as the key
  parts) or ``documents``; landed pages = ``pages``;
* register extracts = JSON built by Spark from ``customer``, ``nation`` and
  ``region``; content-key collisions = ``part`` (brand and size);
* change events = ``events`` read as a file stream;
* job events and log rows = ``events`` (queue by user parity, state and
  level by event type).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching SQL in ``regiflow.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiflow.functions import keys, text, validate, variant
from regiflow.operators import archives, documents, jobs, pages, versions
from regiflow.plans import flows, requests
from regiflow.session import fresh_checkpoint_path
from regiflow.sources import tables
from regiflow.sources.change_log import change_log
from regiflow.sources.tables import read_table, stream_table
from regiflow.streaming import changes

# --- fixed values: stand-in parameters used by the registered queries -----
SWEEP_DAYS = 3                       # days each sweep looks back
FILE_PART_BYTES = 64 << 10           # archive part size for the stand-in run
EVENT_STATES = {                     # event type -> job state
    "signup": "queued",
    "view": "scheduled",
    "click": "started",
    "purchase": "finished",
    "error": "failed",
}
STORE_BUCKETS = 16                   # buckets of the document store
LISTING_CHUNK = 8                    # entries per chunk of a nested listing
ONE_COMPANY = 7
PAGE_MARKERS = [                     # driver pages: label, scope, marker
    ("maintenance", "title", "Nicht aulich für sch erüver enau sch der."),
    ("no_documents", "html", "ouier###"),
    ("cannot_display", "html", "Nicht"),
    ("throttled", "html", "Schheit"),
]


def _company(c: Column) -> Column:
    return keys.zfill(c.cast("string"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --- versions ----------------------------------------------------------------

def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extract versions (S1 stand-in) from ``events``."""
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _company(F.col("user_id")).alias("krs_number"),
        F.col("ts").alias("record_created_at"),
        F.col("props").alias("raw_data"),
    )


def q_current_flag(spark, sf_dir):
    """W1 + S1: every version kept, exactly one current per company."""
    return versions.mark_current(raw_versions(spark, sf_dir), "krs_number",
                                 ["record_created_at", "id"])


def q_current_company(spark, sf_dir):
    """The current version of every company."""
    return versions.current_rows(raw_versions(spark, sf_dir), "krs_number",
                                 ["record_created_at", "id"])


def landed_responses(spark, sf_dir):
    """Landed extract responses (S6 stand-in): one per event; users divisible
    by 7 only ever hit registry S (their P request has not landed)."""
    ev = _t(spark, sf_dir, "events")
    registry = (F.when(F.col("user_id") % 7 == 0, F.lit("S"))
                .when(F.col("event_id") % 2 == 0, F.lit("P")).otherwise(F.lit("S")))
    status = (F.when(F.col("event_type") == "view", F.lit(404))
              .when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)))
    return ev.select(
        _company(F.col("user_id")).alias("krs_number"),
        registry.alias("registry"),
        status.cast("int").alias("status_code"),
        F.col("ts"), F.col("event_id").alias("response_id"),
    )


def q_first_found_registry(spark, sf_dir):
    """First registry (P, then S) that answered other than 404."""
    resp = landed_responses(spark, sf_dir)
    return versions.first_found(resp, resp)


def q_history_current_flag(spark, sf_dir):
    """W1 on a history that holds every third version twice: still exactly one
    current row per company."""
    raw = raw_versions(spark, sf_dir)
    twice = raw.unionAll(raw.filter(F.col("id") % 3 == 0))
    return versions.mark_current(twice, "krs_number", ["record_created_at", "id"], repeated=True)


def q_created_table_rows(spark, sf_dir):
    """The raw table is created when missing, before and after its rows
    were appended; the second time changes nothing."""
    root, rows = fresh_checkpoint_path(spark, "created_table"), raw_versions(spark, sf_dir)
    name = "raw_extracts_" + root.rsplit("-", 1)[1]
    for n in range(2):
        tables.ensure_table(spark, name, rows.schema, f"{root}/raw")
        if n == 0:
            rows.write.insertInto(name)
    return spark.table(name)


# --- validation -----------------------------------------------------------

def q_validate_company_key(spark, sf_dir):
    """F1 over padded customer keys, raw customer names and part names."""
    cust = _t(spark, sf_dir, "customer")
    part = _t(spark, sf_dir, "part")
    cand = (cust.select(F.lit("customer_key").alias("source"), F.col("c_custkey").alias("id"),
                        _company(F.col("c_custkey")).alias("key_text"))
            .unionByName(cust.select(F.lit("customer_name").alias("source"),
                                     F.col("c_custkey").alias("id"), F.col("c_name").alias("key_text")))
            .unionByName(part.select(F.lit("part_name").alias("source"),
                                     F.col("p_partkey").alias("id"), F.col("p_name").alias("key_text"))))
    return validate.validate_company_keys(cand, "key_text")


def q_validate_registry(spark, sf_dir):
    """F6 then F2, in the client's order, over lineitem flags."""
    li = _t(spark, sf_dir, "lineitem")
    registry = F.when(F.col("l_linestatus") == "O", F.translate("l_returnflag", "AR", "PS")) \
        .otherwise(F.concat(F.translate("l_returnflag", "AR", "PS"), F.col("l_linestatus")))
    kind = (F.when(F.col("l_linenumber") == 7, F.lit("pełny"))
            .when(F.col("l_linenumber") % 2 == 0, F.lit("aktualny")).otherwise(F.lit("pelny")))
    df = li.select("l_orderkey", "l_linenumber", registry.alias("registry"),
                   kind.alias("extract_kind"))
    reason = F.coalesce(validate.extract_kind_reason(F.col("extract_kind")),
                        validate.registry_reason(F.col("registry")))
    return df.withColumn("reason", reason)


def q_validate_day_hour(spark, sf_dir):
    """F3-F5 + P3: bulletin parameters made from event times, some broken."""
    ev = _t(spark, sf_dir, "events")
    day = F.concat_ws("-", F.year("ts").cast("string"), F.month("ts").cast("string"),
                      (F.dayofmonth("ts") + (F.col("user_id") % 3) * 10).cast("string"))
    hour_from = F.hour("ts").cast("string")
    hour_to = F.lpad((F.hour("ts") + F.col("event_id") % 4).cast("string"), 2, "0")
    df = ev.select("event_id", day.alias("day_text"), hour_from.alias("hour_from"),
                   hour_to.alias("hour_to"))
    return requests.bulletin_request_checked(df, "day_text", "hour_from", "hour_to")


# --- plans ------------------------------------------------------------------

def q_extract_requests(spark, sf_dir):
    """E1 request plan (F1 + P3): customers' padded keys and raw names as
    candidate companies; valid ones x both registries with the full-extract
    address, invalid ones left out."""
    cust = _t(spark, sf_dir, "customer")
    cand = (cust.select(_company(F.col("c_custkey")).alias("krs_number"))
            .unionByName(cust.select(F.col("c_name").alias("krs_number"))))
    return flows.extract_requests(cand)


def bulletins(spark, sf_dir):
    """Landed bulletins (stand-in): each event lists its user and its ``k``;
    error events carry a malformed body."""
    ev = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_type") == "error",
                  F.concat(F.lit("["), F.col("user_id").cast("string"))) \
        .otherwise(F.concat(F.lit('["'), F.col("user_id").cast("string"), F.lit('", "'), k, F.lit('"]')))
    return ev.select(F.to_date("ts").alias("day"), body.alias("body"))


def q_changed_companies(spark, sf_dir):
    """P5+P1+U1+A3: distinct companies of all bulletins."""
    return requests.changed_companies(bulletins(spark, sf_dir))


def q_bulletin_quarantine(spark, sf_dir):
    """P5: bulletins whose body is no list of numbers, with the reason."""
    return requests.bulletin_quarantine(bulletins(spark, sf_dir))


def q_dispatch_plan(spark, sf_dir):
    """Every changed company x the two update routes."""
    return requests.dispatch_plan(q_changed_companies(spark, sf_dir))


def q_bulletin_requests(spark, sf_dir):
    """P2+P3: each order date is a sweep looking back three days."""
    sweeps = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("as_of"))
    out = requests.bulletin_requests(sweeps, "as_of", SWEEP_DAYS)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "url")


def q_page_requests(spark, sf_dir):
    """A listing of ``ceil(n_chars / 1000)`` pages per document."""
    docs = _t(spark, sf_dir, "documents").select(
        "doc_id", F.ceil(F.col("n_chars") / 1000).alias("num_pages"))
    out = requests.page_plan(docs, "num_pages")
    return out.select("doc_id", F.col("page").cast("bigint").alias("page"),
                      F.col("first_row").cast("bigint").alias("first_row"))


# --- documents --------------------------------------------------------------

def stored_documents(spark, sf_dir, orders=None):
    """Stored documents (stand-in) from ``orders``."""
    o = _t(spark, sf_dir, "orders") if orders is None else orders
    krs = _company(F.col("o_custkey"))
    d_from = F.date_format("o_orderdate", "yyyy-MM-dd")
    d_to = F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31"))
    return o.select(
        "o_orderkey",
        krs.alias("krs_number"),
        F.col("o_orderstatus").alias("document_type"),
        F.col("o_orderpriority").alias("document_name"),
        d_from.alias("document_date_from"),
        d_to.alias("document_date_to"),
    ).withColumn("hash_id", keys.document_key(
        F.col("krs_number"), F.col("document_type"), F.col("document_name"),
        F.col("document_date_from"), F.col("document_date_to")))


def q_document_hash_id(spark, sf_dir):
    """Content key of every stored document."""
    d = stored_documents(spark, sf_dir)
    reason = keys.document_key_reason(*[F.col(c) for c in (
        "krs_number", "document_type", "document_name", "document_date_from", "document_date_to")])
    return d.select("o_orderkey", "krs_number", F.col("hash_id").alias("document_hash_id"),
                    reason.alias("reason"))


def q_document_content_keys(spark, sf_dir):
    """P9-P11 over whole non-ASCII texts: the content key of every document
    (company = source, type = language, name = the whole text).  French,
    German and Spanish texts take the NFKD path; DuckDB has no NFKD, so this
    key is checked against Python's ``unicodedata``/``hashlib`` in pytest."""
    d = _t(spark, sf_dir, "documents")
    key = keys.document_key(F.col("source"), F.col("lang"), F.col("text"), F.lit(""), F.lit(""))
    return d.select("doc_id", keys.is_ascii(F.col("text")).alias("ascii"), key.alias("document_hash_id"))


def q_document_key_collisions(spark, sf_dir):
    """Content keys shared by different part tuples.  Parts as key
    parts (brand and size as type and name: "Brand#1"+"33" and
    "Brand#13"+"3" concatenate alike, as the key has no separator)."""
    p = _t(spark, sf_dir, "part")
    rows = p.select(
        _company(F.col("p_size") % 3).alias("krs_number"),
        F.col("p_brand").alias("document_type"),
        F.col("p_size").cast("string").alias("document_name"),
        F.lower("p_type").alias("document_from"),
        F.lit("").alias("document_to"))
    keyed = rows.withColumn("document_hash_id", keys.document_key(
        *[F.col(c) for c in ("krs_number", "document_type", "document_name", "document_from", "document_to")]))
    return documents.key_collisions(keyed)


def q_docs_of_company(spark, sf_dir):
    """The served listing of every company."""
    return documents.available_listing(stored_documents(spark, sf_dir))


def q_document_listing_chunks(spark, sf_dir):
    """A4: the nested listing of every company, in chunks of about eight
    entries; the list is shown as its content keys."""
    nested = documents.nested_listing(stored_documents(spark, sf_dir), entries_per_chunk=LISTING_CHUNK)
    keys_of = F.array_join(F.array_sort(F.transform("document_list", lambda d: d["document_hash_id"])), ",")
    return nested.select("krs_number", "chunk", "n_chunks", "entries",
                         F.size("document_list").cast("bigint").alias("in_chunk"), keys_of.alias("document_hash_ids"))


def q_document_of_one_company(spark, sf_dir):
    """The stored documents of one company; the filter reaches the
    scan below the key."""
    o = _t(spark, sf_dir, "orders").filter(F.col("o_custkey") == ONE_COMPANY)
    return tables.documents_of_company(stored_documents(spark, sf_dir, o), f"{ONE_COMPANY:010d}",
                                       columns=("o_orderkey", "krs_number", "document_type", "hash_id"))


def q_documents_per_company(spark, sf_dir):
    """A2: stored documents per company."""
    return documents.per_company_count(stored_documents(spark, sf_dir))


def q_new_documents(spark, sf_dir):
    """Documents without a label are new."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.new_rows(docs, _t(spark, sf_dir, "labels"), "doc_id")


def document_request(spark, sf_dir):
    """A request list (stand-in): every labelled id; toxic ones also asked
    for under an id that does not exist (twice when also low quality)."""
    lab = _t(spark, sf_dir, "labels")
    ghost = (F.col("doc_id") + 1_000_000).alias("doc_id")
    return (lab.select("doc_id")
            .unionByName(lab.filter(F.col("toxic") == 1).select(ghost))
            .unionByName(lab.filter((F.col("toxic") == 1) & (F.col("quality") == 0)).select(ghost)))


def q_requested_documents(spark, sf_dir):
    """Stored documents that were requested."""
    docs = _t(spark, sf_dir, "documents").select(
        "doc_id", "source", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return documents.requested(docs, document_request(spark, sf_dir), "doc_id")


def q_missing_documents(spark, sf_dir):
    """Requested ids that are not stored (duplicates kept)."""
    docs = _t(spark, sf_dir, "documents")
    return documents.missing(document_request(spark, sf_dir), docs, "doc_id")


def q_insert_new_documents(spark, sf_dir):
    """First copy of each text (lowest id) unless its text is stored
    (stored = documents that have a label)."""
    docs = _t(spark, sf_dir, "documents")
    incoming = docs.select(keys.sha256_hex(F.col("text")).alias("hash_id"),
                           "doc_id", "source", "lang")
    existing = (docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")
                    .select(keys.sha256_hex(F.col("text")).alias("hash_id")))
    return documents.insert_if_absent(incoming, existing, "hash_id",
                                      order=["doc_id"], carry=["source", "lang"])


def q_bucketed_new_documents(spark, sf_dir):
    """S7/J1/S9 on the bucketed store: it is created when missing and holds
    the labelled documents; the others are inserted if absent, twice."""
    docs = _t(spark, sf_dir, "documents").select(keys.sha256_hex(F.col("text")).alias("hash_id"), "doc_id", "source", "lang")
    labelled = docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi").select(docs.columns)
    root = fresh_checkpoint_path(spark, "bucketed_documents")
    name, buckets = "documents_" + root.rsplit("-", 1)[1], STORE_BUCKETS
    for incoming in (labelled, docs, docs):
        tables.ensure_bucketed_table(spark, name, docs.schema, f"{root}/store", buckets)
        first = documents.keep_first(incoming, "hash_id", ["doc_id"], ["source", "lang"])
        tables.insert_absent(first, name, buckets)
    return spark.table(name)


def q_pending_documents(spark, sf_dir):
    """W3+J1: supplier listings (order = page, line = position); lines with
    return flag R are stored already."""
    li = _t(spark, sf_dir, "lineitem")
    hid = keys.sha256_hex(F.concat_ws("|", F.col("l_orderkey").cast("string"),
                                      F.col("l_linenumber").cast("string")))
    listing = li.select(
        _company(F.col("l_suppkey")).alias("krs_number"),
        (F.col("l_orderkey") + 1).alias("page"),
        F.col("l_linenumber").alias("position"),
        hid.alias("hash_id"),
    )
    stored = li.filter(F.col("l_returnflag") == "R").select(hid.alias("hash_id"))
    return documents.pending_work(listing, stored, "hash_id")


def q_pending_places(spark, sf_dir):
    """Every pending row's place in its listing, without gaps."""
    return documents.dense_order(q_pending_documents(spark, sf_dir)).select("krs_number", "hash_id", "work_order", "place")


def q_next_pending_documents(spark, sf_dir):
    """W3 cursor: each supplier listing's next row to fetch."""
    return documents.next_pending(q_pending_documents(spark, sf_dir))


# --- files and archives -------------------------------------------------------

def file_headers(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    sz = F.col("p_size") % 10
    header = (F.when(sz == 0, F.lit("inline"))
              .when(sz == 1, F.concat(F.lit('attachment; filename="error_'),
                                      F.col("p_partkey").cast("string"), F.lit('.txt"')))
              .otherwise(F.concat(F.lit('attachment; filename="'), F.col("p_name"), F.lit("."),
                                  F.lower("p_type"), F.lit('"'))))
    return p.select("p_partkey", header.alias("content_disposition"))


def q_document_file_names(spark, sf_dir):
    """File name and extension from each header."""
    h = file_headers(spark, sf_dir)
    repaired = text.repair_header(F.col("content_disposition"))
    name = text.file_name(repaired)
    return h.select("p_partkey", name.alias("file_name"),
                    text.file_extension(name).alias("extension"),
                    validate.file_name_reason(name).alias("reason"))


def requested_files(spark, sf_dir):
    """Requested files (stand-in): every document as ``<doc_id>.txt`` of the
    company named by its source."""
    d = _t(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("krs_number"),
        F.col("doc_id").cast("string").alias("hash_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_content_save_name"),
        F.encode("text", "UTF-8").alias("document_content"),
    )


def file_records(spark, sf_dir):
    """Their records (stand-in).  Stored records carry ``n_bytes``; the driver
    table has no such column, so only here it is taken from the text."""
    return requested_files(spark, sf_dir).select(
        "krs_number", "hash_id", "document_content_save_name",
        F.octet_length("document_content").cast("bigint").alias("n_bytes"))


def q_archive_manifest(spark, sf_dir):
    """Archive entry name and size of every requested file."""
    return archives.manifest(file_records(spark, sf_dir))


def q_archive_parts(spark, sf_dir):
    """The archive part of every requested file, cut by running bytes."""
    return archives.bounded_parts(file_records(spark, sf_dir), part_bytes=FILE_PART_BYTES)


def q_archive_totals(spark, sf_dir):
    """Zip archives built per company part; totals per company."""
    built = archives.build_from_store(file_records(spark, sf_dir), requested_files(spark, sf_dir), part_bytes=FILE_PART_BYTES)
    return built.groupBy("krs_number").agg(
        F.sum("n_entries").cast("bigint").alias("n_entries"),
        F.sum("n_bytes").cast("bigint").alias("n_bytes"))


# --- pages ------------------------------------------------------------------

def q_diagnose_pages(spark, sf_dir):
    """F8: first marker found, in precedence order, each in its scope."""
    p = _t(spark, sf_dir, "pages").select("page_id", "html")
    title = pages.page_title(F.col("html"))
    scope = {"title": title, "html": F.col("html")}
    checks = [(label, (scope[s] == F.lit(m)) if s == "title" else scope[s].contains(m))
              for label, s, m in PAGE_MARKERS]
    return p.select("page_id", title.alias("title"), pages.diagnose(checks).alias("diagnosis"))


def q_page_links(spark, sf_dir):
    """S6/P6 on driver pages: link targets of the navigation, in order."""
    p = _t(spark, sf_dir, "pages")
    out = p.select("page_id", F.posexplode(text.nav_links(F.col("html"))).alias("_pos", "href"))
    return out.select("page_id", (F.col("_pos") + 1).cast("bigint").alias("position"), "href")


def register_pages(spark, sf_dir):
    """Landed register pages (stand-in), built by Spark from ``orders``: the
    listing of each customer, ten rows a page, with short rows and rows whose
    name cell is a link without an id; some pages are messages, view-root
    errors, maintenance pages or broken off."""
    o = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    o = (o.withColumn("rn", F.row_number().over(w.orderBy("o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(w))
          .withColumn("page", F.expr("(rn - 1) div 10 + 1")).withColumn("num_pages", F.expr("(n - 1) div 10 + 1")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    key = F.col("o_orderkey").cast("string")
    link = lambda i: F.concat(F.lit('<a href="#"'), i, F.lit(">Pokaż szczegóły</a>"))
    cells = F.concat(
        cell(key), cell(F.col("o_orderstatus")),
        cell(F.when(F.col("o_orderkey") % 29 == 0, link(F.lit(""))).otherwise(F.col("o_orderpriority"))),
        cell(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(F.col("o_orderkey") % 23 == 0, F.lit("")).otherwise(F.concat(
            cell(F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31"))), cell(F.lit("Złożony")),
            cell(link(F.concat(F.lit(' id="row:'), key, F.lit('"')))))))
    row = F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))
    pages_ = o.groupBy("o_custkey", "page").agg(
        F.max("num_pages").alias("num_pages"), F.sort_array(F.collect_list(F.struct("rn", row.alias("row")))).alias("rows"))
    table = F.concat(F.lit('<span class="ui-paginator-current">Strona: '), F.col("page").cast("string"), F.lit("/"),
                     F.col("num_pages").cast("string"), F.lit("</span><table><tr><th>Id</th></tr>"),
                     F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>"))
    update = lambda i, t: F.concat(F.lit(f'<partial-response><changes><update id="{i}"><![CDATA['), t,
                                   F.lit("]]></update></changes></partial-response>"))
    k = F.col("o_custkey") * 31 + F.col("page")
    body = (F.when(k % 13 == 2, F.lit("<html><head><title>Przerwa techniczna</title></head><body><br></body></html>"))
            .when(k % 17 == 3, F.lit("<partial-response><changes><update id='x'>"))
            .when(k % 11 == 0, update("unloggedForm:j_idt9", F.lit("<p>Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami</p>")))
            .when(k % 11 == 1, update("javax.faces.ViewRoot", F.lit("<p>Witryna sieci Web nie może wyświetlić strony</p>")))
            .when(k % 19 == 4, update("unloggedForm:j_idt1", F.lit("<p>Brak dokumentów dla KRS: 1</p>")))
            .otherwise(update("searchForm", table)))
    # Landed pages are read from many files; these would come out of one small shuffle partition.
    pages_ = pages_.repartition(spark.sparkContext.defaultParallelism, "o_custkey", "page")
    return pages_.select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("page").cast("string")).alias("request_id"),
                         _company(F.col("o_custkey")).alias("krs_number"), F.col("page").cast("int").alias("page"), body.alias("body"))


def q_listing_diagnosis(spark, sf_dir):
    """F8/F9/P7 through the page parser: what each landed page is."""
    return flows.parsed_listing(register_pages(spark, sf_dir)).select("krs_number", "page", "diagnosis", "num_pages")


def q_listing_rows(spark, sf_dir):
    """P6/P11 through the page parser: the listing rows of the ok pages."""
    parsed = flows.parsed_listing(register_pages(spark, sf_dir)).filter("diagnosis = 'ok'")
    return pages.listing_rows(parsed)


def q_listing_quarantine(spark, sf_dir):
    """Table rows of the ok pages that are no listing rows, with the reason."""
    parsed = flows.parsed_listing(register_pages(spark, sf_dir)).filter("diagnosis = 'ok'")
    return pages.listing_quarantine(parsed).select(
        "krs_number", "page", "table_row", "n_cells", F.col("cells")[0].alias("first_cell"), "reason")


def q_page_updates(spark, sf_dir):
    """The texts of update blocks looked up by their ids."""
    parsed = pages.parse_pages(register_pages(spark, sf_dir), "body", ["krs_number", "page"], keep_updates=True)
    update = lambda i: F.try_element_at("updates", F.lit(i))
    return parsed.select(
        "krs_number", "page", F.coalesce(F.size("updates"), F.lit(0)).alias("n_updates"), update("unloggedForm:j_idt9").alias("wait"),
        update("javax.faces.ViewRoot").alias("view_root"), update("unloggedForm:j_idt1").alias("message"),
        F.regexp_count(update("searchForm"), F.lit("<tr>")).cast("long").alias("table_rows"))


def q_page_update_blocks(spark, sf_dir):
    """P8 as rows: the update blocks of every page, by a table function."""
    blocks = pages.update_blocks(register_pages(spark, sf_dir), keep=["krs_number", "page"])
    own = F.when(F.col("update_id") != "searchForm", F.col("update_text"))
    return blocks.select("krs_number", "page", "update_id", "place", own.alias("message"))


def q_missing_pages(spark, sf_dir):
    """Listing pages that have not landed as ok (the listing is not whole)."""
    return requests.missing_pages(flows.parsed_listing(register_pages(spark, sf_dir)))


def q_document_records(spark, sf_dir):
    """Landed files of pending rows -> records (P12-P14, P16, P21): file
    names from headers that arrive as UTF-8 read as Latin-1, or that cannot be
    repaired; every seventh size lands twice."""
    p = _t(spark, sf_dir, "part")
    key = F.sha2(F.col("p_partkey").cast("string"), 256)
    pending = p.select(key.alias("hash_id"), _company(F.col("p_size")).alias("krs_number"), F.lit("el").alias("internal_element_id"),
                       F.col("p_brand").alias("document_type"), F.col("p_name").alias("document_name"), F.lit("2023-01-01").alias("document_from"),
                       F.lit("2023-12-31").alias("document_to"), F.lit("ok").alias("document_status"))
    sz = F.col("p_size") % 10
    name = lambda s: F.concat(F.lit('attachment; filename="'), s, F.lit('"'))
    garbled = F.decode(F.encode(F.concat(F.lit("żółć_"), F.col("p_partkey").cast("string"), F.lit(".pdf")), "UTF-8"), "ISO-8859-1")
    header = (F.when(sz == 0, F.lit("inline")).when(sz == 1, name(F.lit("error.txt"))).when(sz == 2, name(F.lit("ł.xml")))
              .when(sz == 3, name(garbled)).otherwise(name(F.concat(F.col("p_name"), F.lit(".xml")))))
    files = p.select(key.alias("hash_id"), header.alias("content_disposition"), F.encode("p_name", "UTF-8").alias("content"), "p_size")
    files = files.unionByName(files.filter("p_size % 7 = 0")).drop("p_size")
    records, _, _ = flows.files_to_records(pending, files, created_at=datetime(2025, 1, 1))
    return records


# --- JSON ---------------------------------------------------------------------

def register_extracts(spark, sf_dir, c=None, kind=None):
    """Full register extracts (JSON text) built by Spark from customer,
    nation and region: one per customer.  Customers of every fifth nation are
    foreign entities (their domestic blocks are empty objects, so the
    fallback is taken); every third customer has an e-mail address."""
    c = _t(spark, sf_dir, "customer") if c is None else c
    kind = F.lit("Pełny") if kind is None else kind
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    d = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    foreign = F.col("c_nationkey") % 5 == 0
    code = F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    entity = F.struct(
        F.col("c_name").alias("nazwa"),
        F.when(foreign, F.lit("")).otherwise(F.col("c_mktsegment")).alias("formaPrawna"),
        F.when(foreign, F.col("c_mktsegment")).alias("nazwaFormaPrawnaPrzedsiebiorcyZagranicznego"),
        F.struct(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("nip"),
                 F.lpad(((F.col("c_custkey") * 7919) % 1000000000).cast("string"), 9, "0").alias("regon"))
        .alias("identyfikatory"))
    seat = F.struct(
        F.struct(F.col("n_name").alias("kraj"), F.col("r_name").alias("wojewodztwo"),
                 F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("powiat"),
                 F.concat(F.lit("G"), (F.col("c_custkey") % 10).cast("string")).alias("gmina")).alias("siedziba"),
        F.struct(F.col("n_name").alias("kraj"),
                 F.concat(F.lit("CITY "), F.col("c_nationkey").cast("string")).alias("miejscowosc"),
                 F.concat(F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 3)).alias("kodPocztowy"),
                 F.concat(F.lit("UL. "), F.upper("c_mktsegment")).alias("ulica"),
                 ((F.col("c_custkey") % 200) + 1).cast("string").alias("nrDomu")).alias("adres"),
        F.when(F.col("c_custkey") % 3 == 0,
               F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.pl")))
        .alias("adresPocztyElektronicznej"))
    empty_entity = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name)
                              for f in d.select(entity.alias("e")).schema["e"].dataType.fields])
    section1 = F.struct(
        F.when(foreign, empty_entity).otherwise(entity).alias("danePodmiotu"),
        F.when(foreign, entity).alias("danePodmiotuZagranicznego"),
        F.when(~foreign, seat).alias("siedzibaIAdres"),
        F.when(foreign, seat).alias("siedzibaIAdresPodmiotuZagranicznego"))
    doc = F.struct(F.struct(kind.alias("rodzaj"),
                            F.struct(section1.alias("dzial1")).alias("dane")).alias("odpis"))
    return d.select("c_custkey", _company(F.col("c_custkey")).alias("krs_number"), F.to_json(doc).alias("raw_data"))


def q_company_records(spark, sf_dir):
    """P18-P20 / ST4 flatten: the company record of every extract, with the
    domestic-or-foreign fallback and county/municipality the right way round."""
    return variant.company_record(register_extracts(spark, sf_dir), "raw_data", keep=["krs_number"])


def history_extracts(spark, sf_dir):
    """Full extracts (stand-in) whose fields are lists in part: the names of
    every second customer are its orders' priorities in order, tax numbers are
    a list of objects, e-mail addresses are missing, empty, or end with null."""
    priorities = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    orders = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.transform(priorities, lambda o: o["o_orderpriority"]).alias("names"))
    c = _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    key, text = F.col("c_custkey"), lambda v: F.to_json(F.array(v))     # noqa: E731
    quoted = lambda v: F.regexp_replace(text(v), r"^\[|\]$", "")         # noqa: E731
    names = F.when(key % 2 == 0, F.coalesce(F.to_json("names"), F.lit("[]"))).otherwise(quoted(F.col("c_name")))
    email = (F.when(key % 4 == 0, F.lit("[]")).when(key % 4 == 1, F.concat(F.lit('["k'), key.cast("string"), F.lit('@example.pl", null]')))
             .when(key % 4 == 2, F.lit("null")).otherwise(F.lit('"one@example.pl"')))
    raw = F.concat(
        F.lit('{"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {"danePodmiotu": {"nazwa": '), names, F.lit(', "formaPrawna": '),
        quoted(F.col("c_mktsegment")), F.lit(', "identyfikatory": {"nip": [{"wpis": '), (key % 7).cast("string"), F.lit(', "nip": "'),
        key.cast("string"), F.lit('"}]}}, "siedzibaIAdres": {"adres": {"nrDomu": '), (key % 200).cast("string"),
        F.lit('}, "adresPocztyElektronicznej": '), email, F.lit("}}}}}"))
    return c.select(_company(key).alias("krs_number"), raw.alias("raw_data"))


def q_company_field_history(spark, sf_dir):
    """P19 over lists: every entry of every field of every extract."""
    return variant.field_history(history_extracts(spark, sf_dir), keep=["krs_number"])


def q_json_props(spark, sf_dir):
    """P18-P20 on event documents: kind tag, a field, a falsy fallback."""
    ev = _t(spark, sf_dir, "events").select("event_id", "props")
    v = variant.parse(F.col("props"))
    k = variant.get(v, "$.k", "variant")
    name = variant.get(v, "$.name", "variant")
    return ev.select(
        "event_id",
        variant.get(v, variant.KIND_PATH).alias("extract_kind"),
        variant.scalar(k).alias("k"),
        variant.scalar(variant.first_present(name, k)).alias("name_or_k"),
    )


# --- jobs and logs ------------------------------------------------------------

def job_events(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    state = None
    for etype, st in EVENT_STATES.items():
        hit = F.col("event_type") == etype
        state = F.when(hit, F.lit(st)) if state is None else state.when(hit, F.lit(st))
    return ev.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit("KRSAPI")).otherwise(F.lit("KRSDF")).alias("queue"),
        state.alias("state"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase",
               F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("result"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("exc_info"),
    )


def q_job_status(spark, sf_dir):
    """One status row per job."""
    return jobs.job_status(job_events(spark, sf_dir))


def q_queue_state_counts(spark, sf_dir):
    """A1: jobs per queue and state, zeros shown."""
    return jobs.queue_counters(job_events(spark, sf_dir))


def q_log_level_report(spark, sf_dir):
    """S11+P22: log rows (epoch seconds -> naive time) per session and level."""
    ev = _t(spark, sf_dir, "events")
    records = ev.select(
        F.col("user_id").cast("string").alias("logger_session_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"),
        F.upper("event_type").alias("level"),
        F.lit("events").alias("logger_name"),
        F.col("props").alias("message"),
    )
    return jobs.log_report(jobs.log_rows(records))


# --- streams ----------------------------------------------------------------

def change_events(events: DataFrame) -> DataFrame:
    """Change events (S3 stand-in) of the raw versions: views are flag
    updates ('u'), errors are tombstones, the rest are creates ('c')."""
    after = F.struct(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("record_created_at"),
        F.lit(True).alias("is_current"),
        _company(F.col("user_id")).alias("krs_number"),
        F.col("props").alias("raw_data"),
    )
    op = F.when(F.col("event_type") == "view", F.lit("u")).otherwise(F.lit("c"))
    envelope = F.to_json(F.struct(F.lit(None).cast("string").alias("before"), after.alias("after"),
                                  op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")))
    value = F.when(F.col("event_type") != "error", envelope)
    return events.select(_company(F.col("user_id")).alias("key"), value.alias("value"))


def q_stream_current_versions(spark, sf_dir):
    """ST1+ST2+ST5+S5: the events table read as a file stream of change
    events, processed with availableNow into history and pointer folders under
    the shared checkpoint root; answer = the current version of every company
    (pointers joined back to the written history, documents included)."""
    stream = stream_table(spark, sf_dir, "events")
    root = fresh_checkpoint_path(spark, "stream_current_versions")
    changes.stream_versions_to_history(change_events(stream), f"{root}/history", f"{root}/pointers",
                                       name="stream_current_versions", checkpoint=f"{root}/ckpt")
    current = changes.current_versions(spark, f"{root}/history", f"{root}/pointers")
    return current.select("krs_number", "id", "record_created_at", "raw_data")


def _arriving(df: DataFrame, root: str, key: str, times: int = 3):
    """``df`` as a file stream (stand-in) that gets a share of the rows before
    each of ``times`` starts: yields the stream after each share."""
    for n in range(times):
        df.filter(F.col(key) % times == n).write.parquet(f"{root}/landed/share={n}")
        yield df.sparkSession.readStream.schema(df.schema).parquet(f"{root}/landed/*")


def q_stream_compacted_versions(spark, sf_dir):
    """S8/ST2: the change events arrive in three shares; the history is
    compacted after the second, so the answer comes from compacted files and
    one later batch."""
    root = fresh_checkpoint_path(spark, "stream_compacted_versions")
    history, compacted = f"{root}/history", f"{root}/compacted"
    for n, events in enumerate(_arriving(_t(spark, sf_dir, "events"), root, "event_id")):
        changes.stream_versions_to_history(change_events(events), history, f"{root}/pointers",
                                           name="stream_compacted_versions", checkpoint=f"{root}/ckpt")
        if n == 1:
            changes.compact_history(spark, history, compacted)
    current = changes.current_versions(spark, history, f"{root}/pointers", compacted_root=compacted)
    return current.select("krs_number", "id", "record_created_at", "raw_data")


def q_stream_log_versions(spark, sf_dir):
    """S3: the change events as a log of JSON lines that grows between three
    starts of the stream; answer = the current version of every company."""
    root = fresh_checkpoint_path(spark, "stream_log_versions")
    for n in range(3):
        own = change_events(_t(spark, sf_dir, "events").filter(F.col("event_id") % 3 == n))
        own.select(F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"})).write.text(f"{root}/log/{n}")
        changes.stream_versions_to_history(change_log(spark, f"{root}/log"), f"{root}/history", f"{root}/pointers",
                                           name="stream_log_versions", checkpoint=f"{root}/ckpt")
    current = changes.current_versions(spark, f"{root}/history", f"{root}/pointers")
    return current.select("krs_number", "id", "record_created_at", "raw_data")


def q_stream_accounts(spark, sf_dir):
    """ST1: the accounts of the batches: events in, versions out, and events
    rejected by reason, counted while they were written."""
    root = fresh_checkpoint_path(spark, "stream_accounts")
    for events in _arriving(_t(spark, sf_dir, "events"), root, "event_id", 2):
        changes.stream_versions_to_history(odd_times(change_events(events)), f"{root}/history", f"{root}/pointers",
                                           name="stream_accounts", checkpoint=f"{root}/ckpt")
    return spark.read.parquet(f"{root}/history_accounts").groupBy("outcome").agg(F.sum("n_rows").alias("n_rows"))


def q_stream_registry_walk(spark, sf_dir):
    """J5 as a stream: the landed answers arrive in three shares, out of
    order; the stream is started again for each."""
    root = fresh_checkpoint_path(spark, "stream_registry_walk")
    for answers in _arriving(landed_responses(spark, sf_dir), root, "response_id"):
        changes.stream_registry_walk(answers, f"{root}/walk", "stream_registry_walk", f"{root}/ckpt")
    return changes.walked_companies(spark, f"{root}/walk")


def q_stream_change_rejects(spark, sf_dir):
    """ST1: the change events that carry no version, written per batch with
    their reason; some times are epochs (good) or unreadable (rejected)."""
    stream = stream_table(spark, sf_dir, "events")
    root = fresh_checkpoint_path(spark, "stream_change_rejects")
    changes.stream_versions_to_history(odd_times(change_events(stream)), f"{root}/history", f"{root}/pointers",
                                       name="stream_change_rejects", checkpoint=f"{root}/ckpt")
    kept = spark.read.parquet(f"{root}/history").select(F.lit("version").alias("outcome"), F.col("krs_number").alias("key"))
    rejects = spark.read.parquet(f"{root}/history_rejects").select(F.col("reason").alias("outcome"), "key")
    return kept.unionByName(rejects).groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n_events"))


def odd_times(events: DataFrame) -> DataFrame:
    """Every third event's time as epoch milliseconds, every fifth's
    unreadable (by the id in the value)."""
    time = F.get_json_object("value", "$.after.record_created_at")
    i = F.get_json_object("value", "$.after.id").cast("long")
    millis = F.unix_millis(F.try_to_timestamp(time)).cast("string")
    other = F.when(i % 5 == 0, F.lit("yesterday")).when(i % 3 == 0, millis).otherwise(time)
    return events.withColumn("value", F.replace("value", F.concat(F.lit('"'), time, F.lit('"')), F.concat(F.lit('"'), other, F.lit('"'))))


def q_stream_new_documents(spark, sf_dir):
    """ST3: every document through two streams with checkpoints of their own
    into one store; the first of each text stays, once."""
    root = fresh_checkpoint_path(spark, "stream_new_documents")
    for n in (1, 2):
        docs = stream_table(spark, sf_dir, "documents").select(
            keys.sha256_hex(F.col("text")).alias("hash_id"), "doc_id", "lang", "source")
        changes.run_available_now(docs, changes.insert_new_batch(f"{root}/store", order=["doc_id"]),
                                  f"stream_new_documents_{n}", f"{root}/ckpt{n}")
    return changes.stored_once(spark, f"{root}/store", order=["doc_id"])


def q_stream_company_records(spark, sf_dir):
    """ST4: extracts as a change stream, flattened and written per batch into
    folders; run again, the stream adds nothing."""
    root = fresh_checkpoint_path(spark, "stream_company_records")
    kind = F.when(F.col("c_custkey") % 2 == 0, F.lit("Pełny")).otherwise(F.lit("Aktualny"))

    def sink(batch, batch_id):
        flat = changes.flatten_company(changes.parse_changes(batch)).drop("id", "record_created_at")
        changes.write_batch_folder(flat, f"{root}/records", batch_id)

    for _ in range(2):
        extracts = register_extracts(spark, sf_dir, stream_table(spark, sf_dir, "customer"), kind)
        after = F.struct(F.col("c_custkey").alias("id"), F.lit("2025-01-01T00:00:00Z").alias("record_created_at"), "krs_number", "raw_data")
        value = F.to_json(F.struct(after.alias("after"), F.lit("r").alias("op")))
        events = extracts.select(F.col("krs_number").alias("key"), value.alias("value"))
        changes.run_available_now(events, sink, "stream_company_records", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/records").drop("writer", "batch_id")


def q_extract_refresh(spark, sf_dir):
    """Landed answers with real addresses; the refresh runs twice,
    the history is read back, and every company found has one current row."""
    r = landed_responses(spark, sf_dir)
    body = _t(spark, sf_dir, "events").select(F.col("event_id").alias("response_id"), F.col("props").alias("body"))
    landed = r.join(body, "response_id").select(
        F.col("response_id").cast("string").alias("request_id"),
        requests.extract_url(F.col("krs_number"), F.col("registry")).alias("url"), "status_code", F.lit("").alias("headers"), "body",
        F.col("ts").cast("timestamp").alias("fetched_at"))
    root = fresh_checkpoint_path(spark, "extract_refresh")
    for n in range(2):
        stored = spark.read.parquet(f"{root}/history") if n else None
        new, _ = flows.extract_refresh(r, landed, stored=stored)
        tables.append_versions(new, f"{root}/history")
    history = spark.read.parquet(f"{root}/history")
    flagged = versions.mark_current(history, "krs_number", ["record_created_at", "id"])
    return flagged.select("krs_number", "record_created_at", "raw_data", "is_current")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "current_flag": q_current_flag,
    "current_company": q_current_company,
    "first_found_registry": q_first_found_registry,
    "validate_company_key": q_validate_company_key,
    "validate_registry": q_validate_registry,
    "validate_day_hour": q_validate_day_hour,
    "extract_requests": q_extract_requests,
    "changed_companies": q_changed_companies,
    "dispatch_plan": q_dispatch_plan,
    "bulletin_requests": q_bulletin_requests,
    "page_requests": q_page_requests,
    "document_hash_id": q_document_hash_id,
    "document_content_keys": q_document_content_keys,
    "document_key_collisions": q_document_key_collisions,
    "docs_of_company": q_docs_of_company,
    "documents_per_company": q_documents_per_company,
    "new_documents": q_new_documents,
    "requested_documents": q_requested_documents,
    "missing_documents": q_missing_documents,
    "insert_new_documents": q_insert_new_documents,
    "pending_documents": q_pending_documents,
    "next_pending_documents": q_next_pending_documents,
    "document_file_names": q_document_file_names,
    "archive_manifest": q_archive_manifest,
    "archive_totals": q_archive_totals,
    "diagnose_pages": q_diagnose_pages,
    "page_links": q_page_links,
    "company_records": q_company_records,
    "json_props": q_json_props,
    "job_status": q_job_status,
    "queue_state_counts": q_queue_state_counts,
    "log_level_report": q_log_level_report,
    "stream_current_versions": q_stream_current_versions,
    "document_listing_chunks": q_document_listing_chunks,
    "document_of_one_company": q_document_of_one_company,
    "bulletin_quarantine": q_bulletin_quarantine,
    "listing_diagnosis": q_listing_diagnosis,
    "listing_rows": q_listing_rows,
    "listing_quarantine": q_listing_quarantine,
    "missing_pages": q_missing_pages,
    "document_records": q_document_records,
    "stream_change_rejects": q_stream_change_rejects,
    "stream_new_documents": q_stream_new_documents,
    "stream_company_records": q_stream_company_records,
    "extract_refresh": q_extract_refresh,
    "history_current_flag": q_history_current_flag,
    "created_table_rows": q_created_table_rows,
    "bucketed_new_documents": q_bucketed_new_documents,
    "archive_parts": q_archive_parts,
    "page_updates": q_page_updates,
    "page_update_blocks": q_page_update_blocks,
    "pending_places": q_pending_places,
    "company_field_history": q_company_field_history,
    "stream_compacted_versions": q_stream_compacted_versions,
    "stream_registry_walk": q_stream_registry_walk,
    "stream_log_versions": q_stream_log_versions,
    "stream_accounts": q_stream_accounts,
}
