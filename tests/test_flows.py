"""Lifecycles composed from the operators, on fixtures (E1, E2, E3), plus
the table sources and sinks (S6, S8, S9)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from regiflow import schemas
from regiflow.plans import flows
from regiflow.sources import landed as L
from regiflow.sources import tables
from test_pages import R1, R2, listing, message_page

T0 = dt.datetime(2025, 3, 1, 8, 0)
URL = "https://api-krs.ms.gov.pl/api/krs/OdpisPelny/{krs}?rejestr={reg}&format=json"


def test_extract_requests_quarantine_bad_keys(spark):
    comp = spark.createDataFrame([("0000057814",), ("abc",)], "krs_number string")
    plan = flows.extract_requests(comp).orderBy("priority").collect()
    assert [(r.krs_number, r.registry) for r in plan] == [("0000057814", "P"), ("0000057814", "S")]
    assert plan[0].url == URL.format(krs="0000057814", reg="P")


def test_extract_refresh(spark):
    body = json.dumps({"odpis": {"rodzaj": "Pełny"}})
    landed = spark.createDataFrame([
        ("r1", URL.format(krs="0000057814", reg="P"), 404, "", "", T0),
        ("r2", URL.format(krs="0000057814", reg="S"), 200, "", body, T0),
        ("r3", URL.format(krs="0000000001", reg="P"), 500, "", "oops", T0),
        ("r4", URL.format(krs="0000000002", reg="P"), 200, "", "{}", T0),
        ("r5", URL.format(krs="0000000002", reg="P"), 200, "", body, T0 + dt.timedelta(hours=1)),
    ], L.LANDED)
    comp = spark.createDataFrame([("0000057814",), ("0000000001",), ("0000000002",), ("12ab",)],
                                 "krs_number string")
    new, outcome = flows.extract_refresh(comp, landed)
    assert {r.krs_number: r.outcome for r in outcome.collect()} == \
        {"0000057814": "ok", "0000000001": "error", "0000000002": "ok", "12ab": "invalid_wrong_length"}
    got = {r.krs_number: (r.raw_data, r.record_created_at) for r in new.collect()}
    assert got == {"0000057814": (body, T0), "0000000002": (body, T0 + dt.timedelta(hours=1))}


def test_extract_refresh_twice_leaves_one_current_row(spark, tmp_root):
    from regiflow.plans import answers

    body = json.dumps({"odpis": {"rodzaj": "Pełny"}})
    landed = spark.createDataFrame([("r1", URL.format(krs="0000057814", reg="P"), 200, "", body, T0)], L.LANDED)
    comp = spark.createDataFrame([("0000057814",)], "krs_number string")
    for n in range(2):
        stored = spark.read.parquet(f"{tmp_root}/h") if n else None
        new, _ = flows.extract_refresh(comp, landed, stored=stored)
        assert new.count() == 1 - n and dict(new.dtypes)["record_created_at"] == "timestamp_ntz"
        tables.append_versions(new, f"{tmp_root}/h")
    history = spark.read.parquet(f"{tmp_root}/h")
    assert history.count() == 1
    doubled = history.unionAll(history).withColumn("record_created_at", F.lit(None).cast("timestamp_ntz"))
    assert answers.company_information(doubled, "0000057814").count() == 1      # null times, delivered twice


def test_listing_refresh_and_records(spark):
    pages = spark.createDataFrame([
        ("q1", "0000057814", 1, listing(rows=R1 + R2, pager="Strona: 1/2")),
        ("q2", "0000057814", 2, message_page(("unloggedForm:j_idt3", "Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami"))),
    ], "request_id string, krs_number string, page int, body string")
    empty = spark.createDataFrame([], "hash_id string")
    diag, pending = flows.listing_refresh(pages, empty)
    assert {r.request_id: (r.diagnosis, r.num_pages) for r in diag.collect()} == \
        {"q1": ("ok", 2), "q2": ("throttled", None)}
    rows = pending.orderBy("work_order").collect()
    assert [r.position for r in rows] == [1, 2] and [r.work_order for r in rows] == [1, 2]
    stored = pending.limit(1).select("hash_id")          # first row stored already
    _, pending2 = flows.listing_refresh(pages, stored)
    assert pending2.count() == 1
    files = spark.createDataFrame([
        (rows[0].hash_id, "attachment; filename=\"bilans.xml\"", bytearray(b"<x/>")),
        (rows[1].hash_id, "attachment; filename=\"error.txt\"", bytearray(b"")),
    ], "hash_id string, content_disposition string, content binary")
    recs, contents, bad = flows.files_to_records(pending, files, created_at=T0)
    rec = recs.first()
    assert rec.document_content_save_name == "bilans.xml" and rec.document_content_file_extension == "xml"
    assert rec.record_created_at == T0 and contents.count() == 1 and rec.n_bytes == 4
    twice, stored_twice, _ = flows.files_to_records(pending, files.unionAll(files), created_at=T0)
    assert twice.count() == 1 and stored_twice.count() == 1
    assert [r.reason for r in bad.collect()] == ["file_error"]


def test_daily_sweep(spark):
    b = spark.createDataFrame([(dt.date(2025, 1, 5), '["57814","0000057814"]'),
                               (dt.date(2025, 1, 6), "['1', '2']"),
                               (dt.date(2025, 1, 6), "[]"), (dt.date(2025, 1, 7), "not a list")],
                              schemas.BULLETINS)
    plan = flows.daily_sweep(b)
    assert plan.count() == 6
    assert {r.krs_number for r in plan.collect()} == {"0000057814", "0000000001", "0000000002"}


def test_tables_append_and_create(spark, tmp_root, capsys):
    v = spark.createDataFrame([(1, T0, True, "0000057814", "{}"), (2, T0 + dt.timedelta(1), True, "0000057814", "{}")],
                              schemas.RAW_EXTRACT)
    tables.append_versions(v, f"{tmp_root}/hist")
    back = spark.read.parquet(f"{tmp_root}/hist")
    assert back.count() == 2 and "ingest_day" in back.columns
    pruned = back.filter(F.col("ingest_day") == "2025-03-02")
    pruned.explain()
    assert "PartitionFilters: [isnotnull(ingest_day" in capsys.readouterr().out
    assert pruned.count() == 1
    tables.ensure_table(spark, "t_docs", schemas.DOCUMENTS, f"{tmp_root}/docs")
    tables.ensure_table(spark, "t_docs", schemas.DOCUMENTS, f"{tmp_root}/docs")     # second call: no-op
    assert spark.table("t_docs").columns == schemas.DOCUMENTS.fieldNames()
    spark.sql("DROP TABLE t_docs")


def test_documents_of_company_pushes_filter(spark, capsys):
    from conftest import SF_CHECK

    o = tables.read_table(spark, SF_CHECK, "orders").withColumnRenamed("o_custkey", "krs_number")
    df = tables.documents_of_company(o, 7, columns=("o_orderkey",))
    df.explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert df.count() == o.filter("krs_number = 7").count()


def test_document_store_prunes_by_prefix(spark, tmp_root, capsys):
    import hashlib

    from regiflow.operators import documents

    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)]
    recs = spark.createDataFrame([(k, "0000057814", f"d{i}") for i, k in enumerate(keys)],
                                 "hash_id string, krs_number string, document_name string")
    cont = spark.createDataFrame([(k, bytearray(k.encode())) for k in keys], "hash_id string, document_content binary")
    tables.write_documents(recs, cont, tmp_root)
    contents = tables.read_store(spark, tmp_root, "contents")
    assert contents.select(tables.PREFIX).distinct().count() > 200
    request = spark.createDataFrame([(keys[3],), (keys[7],), ("f" * 64,)], "hash_id string")
    got = tables.by_keys(contents, request)
    got.explain()
    plan = capsys.readouterr().out
    wanted = sorted({keys[3][:2], keys[7][:2], "ff"})
    part_filter = plan.split("PartitionFilters:")[1].split("\n")[0]
    assert f"IN ({','.join(wanted)})" in part_filter          # only the request's folders
    assert sorted(r.hash_id for r in got.collect()) == sorted([keys[3], keys[7]])
    missing = documents.missing(request, contents)
    assert [r.hash_id for r in missing.collect()] == ["f" * 64]
    incoming = spark.createDataFrame([(keys[5], 1), ("0" * 64, 2)], "hash_id string, doc_id long")
    near = tables.stored_keys_near(tables.read_store(spark, tmp_root, "records"), incoming)
    fresh = documents.insert_if_absent(incoming, near, "hash_id", ["doc_id"])
    assert [r.hash_id for r in fresh.collect()] == ["0" * 64]


def test_download_from_store(spark, tmp_root):
    import io
    import zipfile

    pages = spark.createDataFrame([("q1", "0000057814", 1, listing(rows=R1 + R2))],
                                  "request_id string, krs_number string, page int, body string")
    _, pending = flows.listing_refresh(pages, spark.createDataFrame([], "hash_id string"))
    rows = pending.orderBy("work_order").collect()
    files = spark.createDataFrame([(rows[0].hash_id, 'attachment; filename="bilans.xml"', bytearray(b"<b/>")),
                                   (rows[1].hash_id, 'attachment; filename="opinia.pdf"', bytearray(b"%PDF"))],
                                  "hash_id string, content_disposition string, content binary")
    recs, contents, bad = flows.files_to_records(pending, files, created_at=T0)
    assert bad.count() == 0
    tables.write_documents(recs, contents, tmp_root)
    request = spark.createDataFrame([(rows[0].hash_id,), (rows[1].hash_id,)], "hash_id string")
    built, missing = flows.download(spark, tmp_root, request)
    assert missing.count() == 0
    names = {}
    for r in built.collect():
        with zipfile.ZipFile(io.BytesIO(r.archive)) as zf:
            names.update({n: zf.read(n) for n in zf.namelist()})
    assert names == {"0000057814_bilans.xml": b"<b/>", "0000057814_opinia.pdf": b"%PDF"}
    refused = spark.createDataFrame([(rows[0].hash_id,), ("e" * 64,)], "hash_id string")
    built, missing = flows.download(spark, tmp_root, refused)
    assert built.count() == 0
    assert [r.hash_id for r in missing.collect()] == ["e" * 64]


def test_service_answers(spark):
    from regiflow.plans import answers

    recs = spark.createDataFrame([("h1", "0000057814", "Bilans", "Roczne", "2023-01-01", "2023-12-31"),
                                  ("h2", "0000000001", "X", "Y", "a", "b")],
                                 "hash_id string, krs_number string, document_name string, document_type string, "
                                 "document_date_from string, document_date_to string")
    got = answers.available_documents(recs, "0000057814").collect()
    assert [(r.document_name, r.document_hash_id) for r in got] == [("Roczne", "h1")]
    assert answers.available_documents(recs, "9999999999").count() == 0
    ev = spark.createDataFrame([("j1", "KRSAPI", "queued", T0, 1, None, None),
                                ("j1", "KRSAPI", "finished", T0 + dt.timedelta(seconds=3), 2, "ok", None)],
                               "job_id string, queue string, state string, ts timestamp, seq long, result string, "
                               "exc_info string")
    assert answers.job_status_of(ev, "j1").first().job_status == "finished"
    assert answers.job_status_of(ev, "nope").count() == 0
    assert {r.queue for r in answers.queue_information(ev).collect()} == {"KRSAPI", "KRSDF"}
    doc = json.dumps({"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {"danePodmiotu": {"nazwa": "NEW"}}}}})
    old = json.dumps({"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {"danePodmiotu": {"nazwa": "OLD"}}}}})
    hist = spark.createDataFrame([(1, T0, True, "0000057814", old), (2, T0 + dt.timedelta(1), True, "0000057814", doc)],
                                 schemas.RAW_EXTRACT)
    info = answers.company_information(hist, "0000057814").collect()
    assert [r.full_name for r in info] == ["NEW"]
    assert answers.company_information(hist, "0000000000").count() == 0


def test_daily_sweep_window(spark, tmp_root, capsys):
    b = spark.createDataFrame([(dt.date(2025, 1, 3), '["1"]'), (dt.date(2025, 1, 4), '["2"]'),
                               (dt.date(2025, 1, 5), '["3"]'), (dt.date(2025, 1, 6), '["4"]')],
                              schemas.BULLETINS)
    b.write.parquet(f"{tmp_root}/b")
    landed_b = spark.read.parquet(f"{tmp_root}/b")
    plan = flows.daily_sweep(landed_b, as_of="2025-01-05", n_days=2)
    assert {r.krs_number for r in plan.collect()} == {"0000000002", "0000000003"}
    plan.explain()
    assert "GreaterThanOrEqual(day,2025-01-04)" in capsys.readouterr().out
    one = flows.daily_sweep(landed_b, as_of=dt.date(2025, 1, 6), n_days=1)
    assert {r.krs_number for r in one.collect()} == {"0000000004"}
