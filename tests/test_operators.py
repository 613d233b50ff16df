"""Versions (W1, F12, J5/A5), documents (J1-J3, S7, W3, A2, P16, P17, D12),
jobs (W2, A1, S11/P22) and archives (S10)."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from regiflow.operators import archives, documents, jobs, versions

T0 = dt.datetime(2025, 1, 1, 10, 0, 0)


def _versions(spark, rows):
    return spark.createDataFrame(rows, "id long, krs_number string, record_created_at timestamp, raw_data string")


def test_current_flag_cases(spark):
    rows = [
        (1, "A", T0, "a1"),                                  # one version
        (2, "B", T0, "b1"), (3, "B", T0 + dt.timedelta(1), "b2"), (4, "B", T0 + dt.timedelta(2), "b3"),
        (5, "C", T0, "c1"), (6, "C", T0, "c2"),              # same time: id decides
    ]
    out = versions.mark_current(_versions(spark, rows), "krs_number", ["record_created_at", "id"])
    flags = {r.id: r.is_current for r in out.collect()}
    assert flags == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    cur = versions.current_rows(_versions(spark, rows), "krs_number", ["record_created_at", "id"])
    assert sorted(r.id for r in cur.collect()) == [1, 4, 6]


def test_exactly_one_current_per_company_on_driver_data(spark):
    from regiflow.queries import q_current_flag
    from conftest import SF_CHECK

    df = q_current_flag(spark, SF_CHECK)
    per = df.groupBy("krs_number").agg(F.sum(F.col("is_current").cast("int")).alias("n"))
    assert per.filter("n <> 1").count() == 0


def test_current_row_of_one_company_pushes_filter(spark):
    from regiflow.queries import raw_versions
    from conftest import SF_CHECK

    df = versions.current_row_of(raw_versions(spark, SF_CHECK), "krs_number", "0000000007",
                                 ["record_created_at", "id"])
    assert df.count() == 1
    none = versions.current_row_of(raw_versions(spark, SF_CHECK), "krs_number", "9999999999",
                                   ["record_created_at", "id"])
    assert none.count() == 0


def test_first_found_walk(spark):
    resp = spark.createDataFrame([
        ("A", "P", 200, T0, 1),
        ("B", "P", 404, T0, 2), ("B", "S", 200, T0, 3),
        ("C", "P", 404, T0, 4), ("C", "S", 404, T0, 5),
        ("D", "P", 500, T0, 6), ("D", "S", 200, T0, 7),
        ("E", "S", 200, T0, 8),                               # P not landed yet
        ("F", "P", 500, T0, 9), ("F", "P", 200, T0 + dt.timedelta(1), 10),   # retry: latest counts
    ], "krs_number string, registry string, status_code int, ts timestamp, response_id long")
    companies = spark.createDataFrame([(k,) for k in "ABCDEFG"], "krs_number string")
    out = {r.krs_number: (r.registry, r.outcome) for r in versions.first_found(companies, resp).collect()}
    assert out == {"A": ("P", "ok"), "B": ("S", "ok"), "C": (None, "not_found"), "D": ("P", "error"),
                   "E": ("P", "pending"), "F": ("P", "ok"), "G": ("P", "pending")}


def test_document_joins(spark):
    listing = spark.createDataFrame([("h1", 1), ("h2", 1), ("h3", 2)], "hash_id string, page int")
    stored = spark.createDataFrame([("h2",), ("h9",)], "hash_id string")
    assert sorted(r.hash_id for r in documents.new_rows(listing, stored).collect()) == ["h1", "h3"]
    req = spark.createDataFrame([("h2",), ("h2",), ("h5",), ("h5",)], "hash_id string")
    assert [r.hash_id for r in documents.requested(stored, req).collect()] == ["h2"]
    assert [r.hash_id for r in documents.missing(req, stored).collect()] == ["h5", "h5"]


def test_insert_if_absent_is_idempotent(spark, tmp_root):
    incoming = spark.createDataFrame([("h1", 3, "x"), ("h1", 1, "y"), ("h2", 2, "z"), ("h3", 5, "w")],
                                     "hash_id string, doc_id long, src string")
    existing = spark.createDataFrame([("h3", 0, "old")], "hash_id string, doc_id long, src string")
    existing.write.parquet(tmp_root)
    for _ in range(2):                                    # second run appends nothing
        stored = spark.read.parquet(tmp_root)
        # cut the lineage (shared checkpoint dir) before appending to the table it reads
        new = documents.insert_if_absent(incoming, stored, "hash_id", ["doc_id"], ["src"]).checkpoint()
        new.write.mode("append").parquet(tmp_root)
    final = spark.read.parquet(tmp_root)
    assert final.count() == 3
    assert {(r.hash_id, r.doc_id) for r in final.collect()} == {("h1", 1), ("h2", 2), ("h3", 0)}


def test_pending_work_order(spark):
    listing = spark.createDataFrame([
        ("K", 1, 1, "a"), ("K", 1, 2, "b"), ("K", 2, 1, "c"), ("L", 1, 3, "d")],
        "krs_number string, page int, position int, hash_id string")
    stored = spark.createDataFrame([("a",)], "hash_id string")
    pending = documents.pending_work(listing, stored)
    assert {r.hash_id: r.work_order for r in pending.collect()} == {"b": 2, "c": 11, "d": 3}
    nxt = {r.krs_number: (r.hash_id, r.work_order) for r in documents.next_pending(pending).collect()}
    assert nxt == {"K": ("b", 2), "L": ("d", 3)}


def test_listing_record_and_collisions(spark):
    rows = spark.createDataFrame([
        ("h", "K", "ab", "c", "1", "2", "s", "id1", "f.pdf", "pdf"),
        ("h", "K", "a", "bc", "1", "2", "s", "id2", "g.pdf", "pdf"),
    ], "document_hash_id string, krs_number string, document_type string, document_name string, "
       "document_from string, document_to string, document_status string, internal_element_id string, "
       "document_content_save_name string, document_content_file_extension string")
    rec = documents.document_record(rows, created_at=T0)
    assert rec.columns[:3] == ["hash_id", "krs_number", "document_internal_id"]
    assert documents.key_collisions(rows).first().part_tuples == 2
    lst = documents.available_listing(rec).first()
    assert lst.document_name == lst.document_type == "ab"
    nested = documents.nested_listing(rec, entries_per_chunk=10).first()
    assert nested.krs_number == "K" and len(nested.document_list) == 2 and nested.n_chunks == 1
    chunks = documents.nested_listing(rec, entries_per_chunk=1).collect()
    assert sum(len(c.document_list) for c in chunks) == 2 and {(c.n_chunks, c.entries) for c in chunks} == {(2, 2)}


def test_every_entry_is_in_one_chunk_of_its_listing(spark):
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    rec = spark.createDataFrame([(k, "HOT" if i % 3 else "K", "n", "t", "a", "b") for i, k in enumerate(keys)],
                                "hash_id string, krs_number string, document_name string, document_type string, "
                                "document_date_from string, document_date_to string")
    chunks = documents.nested_listing(rec, entries_per_chunk=10).collect()
    assert sorted(d.document_hash_id for c in chunks for d in c.document_list) == sorted(keys)
    assert max(len(c.document_list) for c in chunks) < 40
    assert {c.krs_number: (c.n_chunks, c.entries) for c in chunks} == {"HOT": (20, 200), "K": (10, 100)}


def test_job_status_and_counters(spark):
    ev = spark.createDataFrame([
        ("j1", "KRSAPI", "queued", T0, 1, None, None),
        ("j1", "KRSAPI", "started", T0 + dt.timedelta(seconds=1), 2, None, None),
        ("j1", "KRSAPI", "finished", T0 + dt.timedelta(seconds=5), 3, "ok", None),
        ("j2", "KRSAPI", "queued", T0, 4, None, None),
        ("j3", "KRSDF", "queued", T0, 5, None, None),
        ("j3", "KRSDF", "failed", T0 + dt.timedelta(seconds=2), 6, None, "Traceback"),
    ], "job_id string, queue string, state string, ts timestamp, seq long, result string, exc_info string")
    st = {r.job_id: r for r in jobs.job_status(ev).collect()}
    assert st["j1"].job_status == "finished" and st["j1"].job_result == "ok"
    assert st["j1"].job_ended_at == T0 + dt.timedelta(seconds=5)
    assert st["j2"].job_started_at is None and st["j3"].job_exc_info == "Traceback"
    counts = {r.queue: r.asDict() for r in jobs.queue_counters(ev, queues=("KRSAPI", "KRSDF", "IDLE")).collect()}
    assert counts["KRSAPI"]["jobs_finished"] == 1 and counts["KRSAPI"]["jobs_enqueued"] == 1
    assert counts["KRSDF"]["jobs_failed"] == 1
    assert all(v == 0 for k, v in counts["IDLE"].items() if k != "queue")


def test_log_rows_and_report(spark):
    recs = spark.createDataFrame([("s1", 1735725600.0, "INFO", "w", "m1"), ("s1", 1735725660.0, "INFO", "w", "m2"),
                                  ("s1", 1735725600.0, "ERROR", "w", "m3")],
                                 "logger_session_id string, created double, level string, logger_name string, message string")
    rep = {r.level: r for r in jobs.log_report(jobs.log_rows(recs)).collect()}
    assert rep["INFO"].n_rows == 2 and rep["INFO"].first_at == dt.datetime(2025, 1, 1, 10, 0)


def test_archives_split_and_unzip(spark):
    docs = spark.createDataFrame(
        [("K", f"h{i}", f"doc{i}.txt", bytes([i % 256]) * 3000) for i in range(40)]
        + [("L", "x", "one.pdf", b"%PDF")],
        "krs_number string, hash_id string, document_content_save_name string, document_content binary")
    built = archives.build_archives(docs, part_bytes=20_000).collect()
    k_parts = [r for r in built if r.krs_number == "K"]
    assert len(k_parts) > 1 and all(r.n_parts == 6 for r in k_parts)
    names = set()
    for r in k_parts:
        with zipfile.ZipFile(io.BytesIO(r.archive)) as zf:
            for n in zf.namelist():
                names.add(n)
                assert len(zf.read(n)) == 3000
    assert names == {f"K_doc{i}.txt" for i in range(40)}
    man = archives.manifest(docs).filter("krs_number = 'L'").first()
    assert (man.entry_name, man.n_bytes) == ("L_one.pdf", 4)


def test_archives_are_deterministic(spark):
    docs = spark.createDataFrame([("K", f"h{i}", f"d{i}.txt", bytes([i]) * 100) for i in range(10)],
                                 "krs_number string, hash_id string, document_content_save_name string, "
                                 "document_content binary")
    a = {(r.krs_number, r.part): r.archive for r in archives.build_archives(docs, part_bytes=300).collect()}
    b = {(r.krs_number, r.part): r.archive for r in archives.build_archives(docs, part_bytes=300).collect()}
    assert a == b and len(a) > 1


def test_refresh_current_equals_full_recompute(spark, tmp_root):
    from regiflow.sources import tables

    rows = [(i, k, T0 + dt.timedelta(hours=h), f"v{i}") for i, (k, h) in
            enumerate([("A", 1), ("B", 2), ("A", 3), ("C", 1), ("B", 1), ("A", 2), ("C", 5), ("D", 0)])]
    old, new = rows[:5], rows[5:]
    order = ["record_created_at", "id"]
    first = versions.current_rows(_versions(spark, old), "krs_number", order)
    tables.publish_snapshot(first, tmp_root, 1)
    snap = tables.read_snapshot(spark, tmp_root)
    refreshed = versions.refresh_current(snap, _versions(spark, new), "krs_number", order)
    full = versions.current_rows(_versions(spark, rows), "krs_number", order)
    assert sorted(r.id for r in refreshed.collect()) == sorted(r.id for r in full.collect()) == [1, 2, 6, 7]
    tables.publish_snapshot(refreshed, tmp_root, 2)
    assert sorted(r.id for r in tables.read_snapshot(spark, tmp_root).collect()) == [1, 2, 6, 7]
