"""DuckDB SQL for every registered query (same column names, same values).

The views ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are registered by
the caller.  These are independent formulations (windows, ``QUALIFY``,
``arg_min``, ``CROSS JOIN VALUES``) of what the Spark operators compute.
"""

from __future__ import annotations

import unicodedata


def _zfill(expr: str) -> str:
    return f"(CASE WHEN length({expr}) < 10 THEN lpad({expr}, 10, '0') ELSE {expr} END)"


_KRS_USER = _zfill("CAST(user_id AS VARCHAR)")
_BULLETIN = "https://api-krs.ms.gov.pl/api/Krs/Biuletyn/"
_DAY_RE = r"^([0-9]{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])$"

_VERSIONS = f"""
    SELECT event_id AS id, {_KRS_USER} AS krs_number, ts AS record_created_at, props AS raw_data
    FROM events
"""

_RESPONSES = f"""
    SELECT {_KRS_USER} AS krs_number,
           CASE WHEN user_id % 7 = 0 THEN 'S' WHEN event_id % 2 = 0 THEN 'P' ELSE 'S' END AS registry,
           CAST(CASE event_type WHEN 'view' THEN 404 WHEN 'error' THEN 500 ELSE 200 END AS INTEGER)
               AS status_code,
           ts, event_id AS response_id
    FROM events
"""

_STORED = f"""
    SELECT o_orderkey, {_zfill('CAST(o_custkey AS VARCHAR)')} AS krs_number,
           o_orderstatus AS document_type, o_orderpriority AS document_name,
           strftime(o_orderdate, '%Y-%m-%d') AS document_date_from,
           CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS document_date_to
    FROM orders
"""
_STORED_H = f"""
    SELECT *, sha256(lower(trim(krs_number || document_type || document_name
                                || document_date_from || document_date_to))) AS hash_id
    FROM ({_STORED})
"""

_REQUEST = """
    SELECT doc_id FROM labels
    UNION ALL SELECT doc_id + 1000000 FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id + 1000000 FROM labels WHERE toxic = 1 AND quality = 0
"""

_BULLETINS = """
    SELECT CAST(ts AS DATE) AS day,
           CASE WHEN event_type = 'error' THEN '[' || CAST(user_id AS VARCHAR)
                ELSE '["' || CAST(user_id AS VARCHAR) || '", "' || json_extract_string(props, '$.k') || '"]'
           END AS body
    FROM events
"""
_CHANGED = f"""
    SELECT DISTINCT {_zfill('n')} AS krs_number
    FROM (SELECT unnest(CASE WHEN json_valid(body) THEN from_json(body, '["VARCHAR"]') END) AS n
          FROM ({_BULLETINS}))
    WHERE n IS NOT NULL
"""

_JOB_EVENTS = """
    SELECT CAST(user_id AS VARCHAR) AS job_id,
           CASE WHEN user_id % 2 = 0 THEN 'KRSAPI' ELSE 'KRSDF' END AS queue,
           CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'scheduled'
                WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'finished'
                WHEN 'error' THEN 'failed' END AS state,
           ts, event_id AS seq,
           CASE WHEN event_type = 'purchase' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END
               AS result,
           CASE WHEN event_type = 'error' THEN props END AS exc_info
    FROM events
"""
_JOB_STATUS = f"""
    SELECT job_id,
           arg_max(queue, {{'ts': ts, 'seq': seq}}) AS queue,
           arg_max(state, {{'ts': ts, 'seq': seq}}) AS job_status,
           min(ts) FILTER (WHERE state = 'queued') AS job_enqueued_at,
           min(ts) FILTER (WHERE state = 'started') AS job_started_at,
           max(ts) FILTER (WHERE state IN ('finished', 'failed')) AS job_ended_at,
           arg_max(result, {{'ts': ts, 'seq': seq}}) FILTER (WHERE state = 'finished') AS job_result,
           arg_max(exc_info, {{'ts': ts, 'seq': seq}}) FILTER (WHERE state = 'failed') AS job_exc_info
    FROM ({_JOB_EVENTS})
    GROUP BY job_id
"""

_FILES = """
    SELECT source AS krs_number, CAST(doc_id AS VARCHAR) AS hash_id,
           CAST(doc_id AS VARCHAR) || '.txt' AS save_name, strlen(text) AS n_bytes
    FROM documents
"""

_DAY_PARTS = f"""
    SELECT *, regexp_extract(day_text, '{_DAY_RE}', 1) AS y,
              regexp_extract(day_text, '{_DAY_RE}', 2) AS m,
              trim(regexp_extract(day_text, '{_DAY_RE}', 3)) AS d
    FROM (SELECT event_id,
                 concat_ws('-', year(ts), month(ts), day(ts) + (user_id % 3) * 10) AS day_text,
                 CAST(hour(ts) AS VARCHAR) AS hour_from,
                 lpad(CAST(hour(ts) + event_id % 4 AS VARCHAR), 2, '0') AS hour_to
          FROM events)
"""
_DAY_PARSED = f"""
    SELECT *, CASE WHEN regexp_full_match(day_text, '{_DAY_RE}') AND y <> '0000'
                   THEN CAST(try_strptime(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0'),
                                          '%Y-%m-%d') AS DATE) END AS parsed
    FROM ({_DAY_PARTS})
"""


def _hour_reason(h: str, prefix: str) -> str:
    return (f"WHEN {h} IS NULL THEN '{prefix}not_string' "
            f"WHEN length({h}) <> 2 THEN '{prefix}wrong_length' "
            f"WHEN NOT regexp_full_match({h}, '[0-9]+') THEN '{prefix}not_digits' ")


_DAY_REASON = (
    "CASE WHEN day_text IS NULL THEN 'not_string' WHEN parsed IS NULL THEN 'bad_day' "
    + _hour_reason("hour_from", "hour_from_") + _hour_reason("hour_to", "hour_to_")
    + "WHEN CAST(hour_from AS INTEGER) >= CAST(hour_to AS INTEGER) THEN 'hour_order' END"
)

def _nfkd(expr: str) -> str:
    """NFKD of Latin text as nested ``replace``: every letter of Latin-1 and
    Latin Extended-A that decomposes (tests check that the data has no
    others)."""
    for point in range(0xA0, 0x180):
        parts = unicodedata.normalize("NFKD", chr(point))
        if parts != chr(point):
            expr = f"replace({expr}, chr({point}), " + " || ".join(f"chr({ord(c)})" for c in parts) + ")"
    return expr


# The stand-in listing: ten orders of a customer a page, and what each page is.
_PAGED = f"""
    SELECT *, (rn - 1) // 10 + 1 AS page, (n - 1) // 10 + 1 AS num_pages,
           {_zfill('CAST(o_custkey AS VARCHAR)')} AS krs_number
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
                 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
"""
_PAGE_KINDS = f"""
    SELECT DISTINCT krs_number, CAST(page AS INTEGER) AS page, CAST(num_pages AS INTEGER) AS num_pages,
           CASE WHEN k % 13 = 2 THEN 'maintenance' WHEN k % 17 = 3 THEN 'malformed' WHEN k % 11 = 0 THEN 'throttled'
                WHEN k % 11 = 1 THEN 'cannot_display' WHEN k % 19 = 4 THEN 'no_documents' ELSE 'ok' END AS diagnosis
    FROM (SELECT *, o_custkey * 31 + page AS k FROM ({_PAGED}))
"""
_OK_ROWS = f"""
    SELECT r.*, o_orderkey % 23 = 0 AS short, o_orderkey % 29 = 0 AS no_name
    FROM ({_PAGED}) r JOIN ({_PAGE_KINDS}) p ON p.krs_number = r.krs_number AND p.page = r.page
    WHERE p.diagnosis = 'ok'
"""

_CHANGES = f"""
    SELECT {_KRS_USER} AS key,
           CASE WHEN event_type = 'error' THEN 'tombstone' WHEN event_type = 'view' THEN 'op_u'
                WHEN event_id % 5 = 0 THEN 'bad_time' ELSE 'version' END AS outcome
    FROM events
"""

SQL: dict[str, str] = {
    "document_content_keys": f"""
        SELECT doc_id, strlen(text) = length(text) AS ascii,
               sha256(lower(trim({_nfkd("source || lang || text")}, ' ' || chr(9) || chr(10) || chr(13)))) AS document_hash_id
        FROM documents
    """,
    "document_listing_chunks": f"""
        WITH d AS (SELECT krs_number, hash_id, count(*) OVER (PARTITION BY krs_number) AS entries FROM ({_STORED_H})),
        c AS (SELECT *, CAST(ceil(entries / 8) AS BIGINT) AS n_chunks FROM d)
        SELECT krs_number, CAST(('0x' || substr(hash_id, 1, 8))::BIGINT % n_chunks AS BIGINT) AS chunk, n_chunks, entries,
               count(*) AS in_chunk, string_agg(hash_id, ',' ORDER BY hash_id) AS document_hash_ids
        FROM c GROUP BY ALL
    """,
    "document_of_one_company": f"""
        SELECT o_orderkey, krs_number, document_type, hash_id FROM ({_STORED_H}) WHERE krs_number = '0000000007'
    """,
    "bulletin_quarantine": f"""
        SELECT day, body, CASE WHEN body IS NULL THEN 'no_body' ELSE 'malformed' END AS reason
        FROM ({_BULLETINS}) WHERE body IS NULL OR NOT json_valid(body)
    """,
    "listing_diagnosis": f"""
        SELECT krs_number, page, diagnosis, CASE WHEN diagnosis = 'ok' THEN num_pages END AS num_pages FROM ({_PAGE_KINDS})
    """,
    "listing_rows": f"""
        SELECT krs_number, CAST(page AS INTEGER) AS page, CAST(position AS INTEGER) AS position, CAST(rn - (page - 1) * 10 AS INTEGER) AS table_row,
               document_id, document_type, document_name,
               document_from, document_to, 'Złożony' AS document_status, 'row:' || document_id AS internal_element_id,
               sha256(lower(trim(krs_number || document_type || document_name || document_from || document_to))) AS document_hash_id
        FROM (SELECT krs_number, page, no_name, rn, row_number() OVER (PARTITION BY krs_number, page ORDER BY rn) AS position,
                     CAST(o_orderkey AS VARCHAR) AS document_id, o_orderstatus AS document_type, o_orderpriority AS document_name,
                     strftime(o_orderdate, '%Y-%m-%d') AS document_from, CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS document_to
              FROM ({_OK_ROWS}) WHERE NOT short)
        WHERE NOT no_name
    """,
    "listing_quarantine": f"""
        SELECT krs_number, CAST(page AS INTEGER) AS page, CAST(rn - (page - 1) * 10 AS INTEGER) AS table_row,
               CAST(CASE WHEN short THEN 4 ELSE 7 END AS INTEGER) AS n_cells, CAST(o_orderkey AS VARCHAR) AS first_cell,
               CASE WHEN short THEN 'few_cells' ELSE 'null_part' END AS reason
        FROM ({_OK_ROWS}) WHERE short OR no_name
    """,
    "missing_pages": f"""
        SELECT krs_number, page FROM ({_PAGE_KINDS}) p
        WHERE diagnosis <> 'ok'
          AND (diagnosis <> 'no_documents' OR krs_number IN (SELECT krs_number FROM ({_PAGE_KINDS}) WHERE diagnosis = 'ok'))
    """,
    "document_records": f"""
        SELECT sha256(CAST(p_partkey AS VARCHAR)) AS hash_id, {_zfill('CAST(p_size AS VARCHAR)')} AS krs_number,
               'el' AS document_internal_id, p_brand AS document_type, p_name AS document_name, '2023-01-01' AS document_date_from,
               '2023-12-31' AS document_date_to, 'ok' AS document_status, save_name AS document_content_save_name,
               string_split(save_name, '.')[-1] AS document_content_file_extension, strlen(p_name) AS n_bytes,
               TIMESTAMP '2025-01-01' AS record_created_at, TIMESTAMP '2025-01-01' AS record_updated_at
        FROM (SELECT *, CASE WHEN p_size % 10 = 3 THEN 'żółć_' || CAST(p_partkey AS VARCHAR) || '.pdf'
                             ELSE p_name || '.xml' END AS save_name
              FROM part WHERE p_size % 10 >= 3)
    """,
    "stream_change_rejects": f"SELECT key, outcome, count(*) AS n_events FROM ({_CHANGES}) GROUP BY ALL",
    "stream_new_documents": """
        SELECT sha256(text) AS hash_id, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
        FROM documents GROUP BY text
    """,
    "extract_refresh": f"""
        WITH latest AS (
            SELECT krs_number, registry, status_code, ts, response_id FROM ({_RESPONSES})
            QUALIFY row_number() OVER (PARTITION BY krs_number, registry ORDER BY ts DESC, response_id DESC) = 1),
        chosen AS (
            SELECT c.krs_number, CASE WHEN coalesce(p.status_code, 0) <> 404 THEN p.status_code ELSE s.status_code END AS status_code,
                   CASE WHEN coalesce(p.status_code, 0) <> 404 THEN p.response_id ELSE s.response_id END AS response_id
            FROM (SELECT DISTINCT krs_number FROM latest) c
            LEFT JOIN latest p ON p.krs_number = c.krs_number AND p.registry = 'P'
            LEFT JOIN latest s ON s.krs_number = c.krs_number AND s.registry = 'S')
        SELECT krs_number, ts AS record_created_at, props AS raw_data, true AS is_current
        FROM chosen JOIN events ON event_id = response_id WHERE status_code = 200
    """,
    "current_flag": f"""
        SELECT *, row_number() OVER (PARTITION BY krs_number
                                     ORDER BY record_created_at DESC, id DESC) = 1 AS is_current
        FROM ({_VERSIONS})
    """,
    "current_company": f"""
        SELECT * FROM ({_VERSIONS})
        QUALIFY row_number() OVER (PARTITION BY krs_number ORDER BY record_created_at DESC, id DESC) = 1
    """,
    "first_found_registry": f"""
        WITH r AS ({_RESPONSES}),
        latest AS (
            SELECT krs_number, registry, status_code FROM r
            QUALIFY row_number() OVER (PARTITION BY krs_number, registry
                                       ORDER BY ts DESC, response_id DESC) = 1),
        cand AS (
            SELECT c.krs_number, o.registry, o.pri
            FROM (SELECT DISTINCT krs_number FROM r) c
            CROSS JOIN (VALUES ('P', 0), ('S', 1)) o(registry, pri)),
        walked AS (
            SELECT cand.krs_number, cand.registry, cand.pri, latest.status_code
            FROM cand LEFT JOIN latest USING (krs_number, registry)),
        firsts AS (
            SELECT krs_number,
                   arg_min({{'registry': registry, 'status_code': status_code}}, pri)
                       FILTER (WHERE coalesce(status_code, 0) <> 404) AS f
            FROM walked GROUP BY krs_number)
        SELECT krs_number, f.registry AS registry, f.status_code AS status_code,
               CASE WHEN f IS NULL THEN 'not_found'
                    WHEN f.status_code IS NULL THEN 'pending'
                    WHEN f.status_code = 404 THEN 'not_found'
                    WHEN f.status_code <> 200 THEN 'error'
                    ELSE 'ok' END AS outcome
        FROM firsts
    """,
    "validate_company_key": f"""
        WITH cand AS (
            SELECT 'customer_key' AS source, c_custkey AS id,
                   {_zfill('CAST(c_custkey AS VARCHAR)')} AS key_text FROM customer
            UNION ALL SELECT 'customer_name', c_custkey, c_name FROM customer
            UNION ALL SELECT 'part_name', p_partkey, p_name FROM part)
        SELECT *, reason IS NULL AS valid FROM (
            SELECT *, CASE WHEN key_text IS NULL THEN 'not_string'
                           WHEN length(key_text) <> 10 THEN 'wrong_length'
                           WHEN NOT regexp_full_match(key_text, '[0-9]+') THEN 'not_digits' END AS reason
            FROM cand)
    """,
    "validate_registry": """
        SELECT *, CASE WHEN extract_kind NOT IN ('aktualny', 'pelny') THEN 'bad_extract_kind'
                       WHEN registry IS NULL THEN 'not_string'
                       WHEN length(registry) <> 1 THEN 'wrong_length'
                       WHEN registry NOT IN ('P', 'S') THEN 'not_allowed' END AS reason
        FROM (SELECT l_orderkey, l_linenumber,
                     CASE WHEN l_linestatus = 'O' THEN translate(l_returnflag, 'AR', 'PS')
                          ELSE translate(l_returnflag, 'AR', 'PS') || l_linestatus END AS registry,
                     CASE WHEN l_linenumber = 7 THEN 'pełny' WHEN l_linenumber % 2 = 0 THEN 'aktualny'
                          ELSE 'pelny' END AS extract_kind
              FROM lineitem)
    """,
    "validate_day_hour": f"""
        SELECT event_id, day_text, hour_from, hour_to, reason,
               CASE WHEN reason IS NULL THEN '{_BULLETIN}' || strftime(parsed, '%Y-%m-%d')
                    || '?godzinaOd=' || hour_from || '&godzinaDo=' || hour_to END AS url
        FROM (SELECT *, {_DAY_REASON} AS reason FROM ({_DAY_PARSED}))
    """,
    "extract_requests": f"""
        SELECT c.krs_number, r.priority, r.registry,
               'https://api-krs.ms.gov.pl/api/krs/OdpisPelny/' || c.krs_number || '?rejestr=' || r.registry
               || '&format=json' AS url
        FROM (SELECT {_zfill('CAST(c_custkey AS VARCHAR)')} AS krs_number FROM customer
              UNION ALL SELECT c_name FROM customer) c
        CROSS JOIN (VALUES (0, 'P'), (1, 'S')) r(priority, registry)
        WHERE length(c.krs_number) = 10 AND regexp_full_match(c.krs_number, '[0-9]+')
    """,
    "changed_companies": _CHANGED,
    "dispatch_plan": f"""
        SELECT c.krs_number, r.kind, replace(r.path, '{{krs}}', c.krs_number) AS path
        FROM ({_CHANGED}) c
        CROSS JOIN (VALUES ('business_information', '/krs-api/update-business-information/{{krs}}'),
                           ('document_list', '/krs-df/update-document-list/{{krs}}')) r(kind, path)
    """,
    "bulletin_requests": f"""
        SELECT strftime(day, '%Y-%m-%d') AS day,
               '{_BULLETIN}' || strftime(day, '%Y-%m-%d') || '?godzinaOd=0&godzinaDo=23' AS url
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) - CAST(i AS INTEGER) AS day
              FROM orders CROSS JOIN range(0, 3) t(i))
    """,
    "page_requests": """
        SELECT doc_id, page, (page - 1) * 10 AS first_row
        FROM (SELECT doc_id, unnest(generate_series(1, CAST(ceil(n_chars / 1000) AS BIGINT))) AS page
              FROM documents)
    """,
    "document_hash_id": f"""
        SELECT o_orderkey, krs_number, hash_id AS document_hash_id, CAST(NULL AS VARCHAR) AS reason
        FROM ({_STORED_H})
    """,
    "document_key_collisions": """
        SELECT document_hash_id, count(DISTINCT parts) AS part_tuples
        FROM (SELECT sha256(lower(trim(k || t || n || f))) AS document_hash_id,
                     k || chr(31) || t || chr(31) || n || chr(31) || f AS parts
              FROM (SELECT lpad(CAST(p_size % 3 AS VARCHAR), 10, '0') AS k, p_brand AS t,
                           CAST(p_size AS VARCHAR) AS n, lower(p_type) AS f FROM part))
        GROUP BY document_hash_id HAVING count(DISTINCT parts) > 1
    """,
    "docs_of_company": f"""
        SELECT krs_number, document_type AS document_name, document_type, document_date_from,
               document_date_to, hash_id AS document_hash_id
        FROM ({_STORED_H})
    """,
    "documents_per_company": f"""
        SELECT krs_number, count(*) AS documents FROM ({_STORED}) GROUP BY krs_number
    """,
    "new_documents": """
        SELECT doc_id, lang, source, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """,
    "requested_documents": f"""
        SELECT doc_id, source, strlen(text) AS n_bytes FROM documents
        WHERE doc_id IN ({_REQUEST})
    """,
    "missing_documents": f"""
        SELECT r.doc_id FROM ({_REQUEST}) r
        WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = r.doc_id)
    """,
    "insert_new_documents": """
        WITH inc AS (SELECT sha256(text) AS hash_id, doc_id, source, lang FROM documents),
        firsts AS (SELECT * FROM inc
                   QUALIFY row_number() OVER (PARTITION BY hash_id ORDER BY doc_id, source, lang) = 1),
        existing AS (SELECT sha256(text) AS hash_id FROM documents
                     WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.hash_id = f.hash_id)
    """,
    "pending_documents": """
        WITH listing AS (
            SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS krs_number, l_orderkey + 1 AS page,
                   l_linenumber AS position,
                   sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) AS hash_id,
                   l_returnflag
            FROM lineitem),
        todo AS (
            SELECT krs_number, page, position, hash_id, (page - 1) * 10 + position AS work_order
            FROM listing l
            WHERE NOT EXISTS (SELECT 1 FROM listing s WHERE s.l_returnflag = 'R' AND s.hash_id = l.hash_id))
        SELECT * FROM todo
    """,
    "next_pending_documents": """
        SELECT krs_number, work_order, hash_id, page, position FROM (
        WITH listing AS (
            SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS krs_number, l_orderkey + 1 AS page,
                   l_linenumber AS position,
                   sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) AS hash_id,
                   l_returnflag
            FROM lineitem),
        todo AS (
            SELECT krs_number, page, position, hash_id, (page - 1) * 10 + position AS work_order
            FROM listing l
            WHERE NOT EXISTS (SELECT 1 FROM listing s WHERE s.l_returnflag = 'R' AND s.hash_id = l.hash_id))
        SELECT * FROM todo
        )
        QUALIFY row_number() OVER (PARTITION BY krs_number ORDER BY work_order) = 1
    """,
    "document_file_names": """
        SELECT p_partkey, file_name, CASE WHEN file_name IS NOT NULL
                                          THEN string_split(file_name, '.')[-1] END AS extension,
               CASE WHEN file_name IS NULL THEN 'no_file_name'
                    WHEN contains(file_name, 'error') THEN 'file_error' END AS reason
        FROM (SELECT p_partkey, nullif(regexp_extract(h, 'filename="(.+?)"', 1), '') AS file_name
              FROM (SELECT p_partkey,
                           CASE WHEN p_size % 10 = 0 THEN 'inline'
                                WHEN p_size % 10 = 1
                                    THEN 'attachment; filename="error_' || CAST(p_partkey AS VARCHAR) || '.txt"'
                                ELSE 'attachment; filename="' || p_name || '.' || lower(p_type) || '"'
                           END AS h
                    FROM part))
    """,
    "archive_manifest": f"""
        SELECT krs_number, hash_id, krs_number || '_' || save_name AS entry_name, n_bytes
        FROM ({_FILES})
    """,
    "archive_totals": f"""
        SELECT krs_number, count(*) AS n_entries, sum(n_bytes)::BIGINT AS n_bytes
        FROM ({_FILES}) GROUP BY krs_number
    """,
    "diagnose_pages": """
        SELECT page_id, title,
               CASE WHEN coalesce(title = 'Nicht aulich für sch erüver enau sch der.', false) THEN 'maintenance'
                    WHEN contains(html, 'ouier###') THEN 'no_documents'
                    WHEN contains(html, 'Nicht') THEN 'cannot_display'
                    WHEN contains(html, 'Schheit') THEN 'throttled'
                    ELSE 'ok' END AS diagnosis
        FROM (SELECT page_id, html,
                     nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title
              FROM pages)
    """,
    "page_links": """
        SELECT page_id, position, href
        FROM (SELECT page_id, unnest(generate_series(1, len(l))) AS position, unnest(l) AS href
              FROM (SELECT page_id,
                           regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                                              '<a href="([^"]*)"', 1) AS l
                    FROM pages))
    """,
    "company_records": f"""
        SELECT {_zfill('CAST(c_custkey AS VARCHAR)')} AS krs_number, 'Pełny' AS extract_kind,
               c_name AS full_name, c_mktsegment AS legal_form,
               lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS nip_number,
               lpad(CAST((c_custkey * 7919) % 1000000000 AS VARCHAR), 9, '0') AS regon_number,
               n_name AS country, r_name AS voivodeship,
               'P' || CAST(c_nationkey AS VARCHAR) AS county,
               'G' || CAST(c_custkey % 10 AS VARCHAR) AS municipality,
               'CITY ' || CAST(c_nationkey AS VARCHAR) AS city,
               substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 1, 2) || '-'
                   || substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 3, 3) AS postal_number,
               'UL. ' || upper(c_mktsegment) AS street,
               CAST(c_custkey % 200 + 1 AS VARCHAR) AS house_number,
               CASE WHEN c_custkey % 3 = 0 THEN lower(replace(c_name, '#', '.')) || '@example.pl' END AS email,
               CAST(NULL AS VARCHAR) AS webpage
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
    "json_props": """
        SELECT event_id, json_extract_string(props, '$.odpis.rodzaj') AS extract_kind,
               json_extract_string(props, '$.k') AS k,
               coalesce(nullif(json_extract_string(props, '$.name'), ''),
                        json_extract_string(props, '$.k')) AS name_or_k
        FROM events
    """,
    "job_status": _JOB_STATUS,
    "queue_state_counts": f"""
        SELECT q.queue,
               count(*) FILTER (WHERE job_status = 'queued') AS jobs_enqueued,
               count(*) FILTER (WHERE job_status = 'started') AS jobs_started,
               count(*) FILTER (WHERE job_status = 'deferred') AS jobs_deferred,
               count(*) FILTER (WHERE job_status = 'scheduled') AS jobs_scheduled,
               count(*) FILTER (WHERE job_status = 'failed') AS jobs_failed,
               count(*) FILTER (WHERE job_status = 'finished') AS jobs_finished
        FROM (VALUES ('KRSAPI'), ('KRSDF')) q(queue)
        LEFT JOIN ({_JOB_STATUS}) j ON j.queue = q.queue
        GROUP BY q.queue
    """,
    "stream_current_versions": f"""
        SELECT {_KRS_USER} AS krs_number, event_id AS id, ts AS record_created_at, props AS raw_data
        FROM events WHERE event_type NOT IN ('view', 'error')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
    "log_level_report": """
        SELECT CAST(user_id AS VARCHAR) AS logger_session_id, upper(event_type) AS level,
               count(*) AS n_rows, min(date_trunc('second', ts)) AS first_at,
               max(date_trunc('second', ts)) AS last_at
        FROM events GROUP BY ALL
    """,
}

# The extracts as a stream differ from the batch in their kind only.
SQL["stream_company_records"] = SQL["company_records"].replace(
    "'Pełny' AS extract_kind", "CASE WHEN c_custkey % 2 = 0 THEN 'Pełny' ELSE 'Aktualny' END AS extract_kind")
SQL["history_current_flag"] = SQL["current_flag"]
SQL["stream_compacted_versions"] = SQL["stream_current_versions"]
SQL["stream_registry_walk"] = SQL["first_found_registry"]
SQL["created_table_rows"] = _VERSIONS
SQL["bucketed_new_documents"] = """
    SELECT sha256(text) AS hash_id, doc_id, source, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NOT IN (SELECT doc_id FROM labels), doc_id, source, lang) = 1
"""
SQL["archive_parts"] = f"""
    WITH sized AS (SELECT krs_number, hash_id, n_bytes, n_bytes <= 32768 AS small FROM ({_FILES})),
    summed AS (
        SELECT *, coalesce(sum(n_bytes) FILTER (small) OVER before, 0) AS bytes_before, count(*) FILTER (NOT small) OVER before AS large_before
        FROM sized WINDOW before AS (PARTITION BY krs_number ORDER BY hash_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    shaped AS (
        SELECT *, coalesce(max(bytes_before // 32768) FILTER (small) OVER every, -1) + 1 AS small_parts,
               count(*) FILTER (NOT small) OVER every AS large_parts
        FROM summed WINDOW every AS (PARTITION BY krs_number))
    SELECT krs_number, hash_id, n_bytes, CAST(CASE WHEN small THEN bytes_before // 32768 ELSE small_parts + large_before END AS INTEGER) AS part,
           CAST(small_parts + large_parts AS INTEGER) AS n_parts
    FROM shaped
"""
SQL["page_updates"] = f"""
    SELECT k.krs_number, k.page, CAST(CASE WHEN diagnosis IN ('maintenance', 'malformed') THEN 0 ELSE 1 END AS INTEGER) AS n_updates,
           CASE WHEN diagnosis = 'throttled' THEN '<p>Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami</p>' END AS wait,
           CASE WHEN diagnosis = 'cannot_display' THEN '<p>Witryna sieci Web nie może wyświetlić strony</p>' END AS view_root,
           CASE WHEN diagnosis = 'no_documents' THEN '<p>Brak dokumentów dla KRS: 1</p>' END AS message,
           CASE WHEN diagnosis = 'ok' THEN n_rows + 1 END AS table_rows
    FROM ({_PAGE_KINDS}) k
    JOIN (SELECT krs_number, page, count(*) AS n_rows FROM ({_PAGED}) GROUP BY ALL) r ON r.krs_number = k.krs_number AND r.page = k.page
"""
# The lists as JSON, entry by entry; a scalar is a list of one.
SQL["company_field_history"] = f"""
    WITH names AS (SELECT o_custkey AS c_custkey, to_json(list(o_orderpriority ORDER BY o_orderkey)) AS names FROM orders GROUP BY ALL),
    fields AS (
        SELECT c_custkey, unnest([
            {{'field': 'full_name', 'entries': CASE WHEN c_custkey % 2 = 0 THEN coalesce(names, '[]') ELSE to_json([c_name]) END}},
            {{'field': 'legal_form', 'entries': to_json([c_mktsegment])}},
            {{'field': 'nip_number', 'entries': to_json([{{'nip': CAST(c_custkey AS VARCHAR), 'wpis': c_custkey % 7}}])}},
            {{'field': 'house_number', 'entries': to_json([c_custkey % 200])}},
            {{'field': 'email', 'entries': CASE c_custkey % 4
                WHEN 1 THEN to_json(['k' || CAST(c_custkey AS VARCHAR) || '@example.pl', NULL])
                WHEN 3 THEN to_json(['one@example.pl']) ELSE '[]' END}}], recursive := true)
        FROM customer LEFT JOIN names USING (c_custkey)),
    entries AS (
        SELECT c_custkey, field, json_array_length(entries) AS n, json_extract(entries, '$[' || i || ']') AS entry, i
        FROM fields, unnest(range(CAST(json_array_length(entries) AS BIGINT))) t(i))
    SELECT {_zfill('CAST(c_custkey AS VARCHAR)')} AS krs_number, 'Pełny' AS extract_kind, field, CAST(i AS INTEGER) AS entry,
           CASE WHEN json_type(entry) <> 'NULL' THEN json_extract_string(entry, '$') END AS value, i = n - 1 AS is_last
    FROM entries
"""
SQL["stream_log_versions"] = SQL["stream_current_versions"]
SQL["stream_accounts"] = f"""
    WITH counted AS (SELECT outcome, count(*) AS n FROM ({_CHANGES}) GROUP BY outcome)
    SELECT 'in' AS outcome, CAST(sum(n) AS BIGINT) AS n_rows FROM counted
    UNION ALL SELECT coalesce(o.as_said, r.outcome), coalesce(n, 0)
    FROM (VALUES ('version'), ('tombstone'), ('malformed'), ('op_u'), ('no_after'), ('no_key'), ('bad_time')) r(outcome)
    LEFT JOIN (VALUES ('version', 'out'), ('op_u', 'op_*')) o(outcome, as_said) USING (outcome) LEFT JOIN counted USING (outcome)
"""
SQL["page_update_blocks"] = f"""
    SELECT krs_number, page, CAST(0 AS INTEGER) AS place,
           CASE diagnosis WHEN 'throttled' THEN 'unloggedForm:j_idt9' WHEN 'cannot_display' THEN 'javax.faces.ViewRoot'
                          WHEN 'no_documents' THEN 'unloggedForm:j_idt1' ELSE 'searchForm' END AS update_id,
           CASE diagnosis WHEN 'throttled' THEN '<p>Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami</p>'
                          WHEN 'cannot_display' THEN '<p>Witryna sieci Web nie może wyświetlić strony</p>'
                          WHEN 'no_documents' THEN '<p>Brak dokumentów dla KRS: 1</p>' END AS message
    FROM ({_PAGE_KINDS}) WHERE diagnosis NOT IN ('maintenance', 'malformed')
"""
SQL["pending_places"] = f"""
    SELECT krs_number, hash_id, work_order, row_number() OVER (PARTITION BY krs_number ORDER BY work_order, hash_id) AS place
    FROM ({SQL['pending_documents']})
"""
