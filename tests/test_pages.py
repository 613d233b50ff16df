"""Landed register pages: structure, listing rows (P6-P8), diagnosis."""

import hashlib
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from regiflow.operators import pages


def py_key(*parts):
    s = unicodedata.normalize("NFKD", "".join(parts)).strip().lower().replace("\xa0", " ")
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


ROW = ("<tr><td>{id}</td><td>{t}</td><td>{n}</td><td>{f}</td><td>{to}</td><td>{s}</td>"
       "<td><a id=\"{link}\" href=\"#\">Pokaż szczegóły</a></td>{extra}</tr>")


def listing(update_id="searchForm", rows="", pager="Strona: 1/7"):
    table = (f"<span class=\"ui-paginator-current\">{pager}</span>"
             f"<table><tr><th>Id</th><th>Rodzaj</th></tr>{rows}</table>")
    return ("<?xml version='1.0' encoding='UTF-8'?><partial-response><changes>"
            f"<update id=\"{update_id}\"><![CDATA[{table}]]></update>"
            "<update id=\"j_id1:javax.faces.ViewState:0\"><![CDATA[123:456]]></update>"
            "</changes></partial-response>")


def message_page(*updates):
    body = "".join(f"<update id=\"{i}\"><![CDATA[<div><span>{t}</span></div>]]></update>" for i, t in updates)
    return f"<partial-response><changes>{body}</changes></partial-response>"


R1 = ROW.format(id="1", t="Roczne sprawozdanie finansowe", n="Bilans", f="01.01.2023",
                to="31.12.2023", s="Złożony", link="searchForm:docTable:0:j_idt1", extra="")
R2 = ROW.format(id="2", t="Opinia biegłego rewidenta", n="Opinia &amp; raport", f="01.01.2022",
                to="31.12.2022", s="Złożony", link="searchForm:docTable:1:j_idt1",
                extra="<td>extra</td>")
SHORT = "<tr><td>a</td><td>b</td><td>c</td><td>d</td></tr>"


def parsed_df(spark, bodies):
    rows = [(str(i), "0000057814", 1, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "request_id string, krs_number string, page int, body string")
    return pages.parse_pages(df, "body", ["request_id", "krs_number", "page"])


def test_listing_rows_and_keys(spark):
    parsed = parsed_df(spark, [listing(rows=R1 + SHORT + R2),
                               listing("searchForm:docTable", rows=R1)])
    rows = pages.listing_rows(parsed, keep=["request_id"]).orderBy("request_id", "position").collect()
    assert len(rows) == 3                       # the 4-cell row is in the quarantine, the header is no row
    odd = pages.listing_quarantine(parsed, keep=["request_id"]).collect()
    assert [(r.table_row, r.n_cells, r.cells, r.reason) for r in odd] == [(2, 4, ["a", "b", "c", "d"], "few_cells")]
    first = rows[0]
    assert first.document_type == "Roczne sprawozdanie finansowe"
    assert first.internal_element_id == "searchForm:docTable:0:j_idt1"
    assert first.position == 1                  # the header row does not count
    assert first.document_hash_id == py_key("0000057814", "Roczne sprawozdanie finansowe", "Bilans",
                                            "01.01.2023", "31.12.2023")
    second = rows[1]
    assert second.document_name == "Opinia & raport"   # entities decoded
    assert second.document_hash_id == py_key("0000057814", "Opinia biegłego rewidenta",
                                             "Opinia & raport", "01.01.2022", "31.12.2022")
    assert rows[2].request_id == "1"            # fallback to searchForm:docTable
    skipped = parsed.select(pages.skipped_rows().alias("n")).orderBy("n").collect()
    assert [r.n for r in skipped] == [1, 2]


def test_row_without_a_key_part_is_quarantined(spark):
    no_id = ("<tr><td>1</td><td>T</td><td><a href='#'>Pokaż szczegóły</a></td><td>f</td><td>t</td></tr>")
    parsed = parsed_df(spark, [listing(rows=no_id + R1)])
    assert [(r.position, r.table_row) for r in pages.listing_rows(parsed).collect()] == [(2, 2)]
    assert [(r.table_row, r.reason) for r in pages.listing_quarantine(parsed).collect()] == [(1, "null_part")]


def test_rows_and_quarantine_share_one_numbering(spark):
    """Every table row has one number, whichever side it goes to."""
    no_id = ("<tr><td>1</td><td>T</td><td><a href='#'>Pokaż szczegóły</a></td><td>f</td><td>t</td></tr>")
    parsed = parsed_df(spark, [listing(rows=R1 + SHORT + no_id + R2), listing(rows=SHORT + R1)])
    rows = pages.listing_rows(parsed, keep=["request_id"]).orderBy("request_id", "table_row").collect()
    odd = pages.listing_quarantine(parsed, keep=["request_id"]).orderBy("request_id", "table_row").collect()
    assert [(r.request_id, r.position, r.table_row) for r in rows] == [("0", 1, 1), ("0", 3, 4), ("1", 1, 2)]
    assert [(r.request_id, r.table_row, r.reason) for r in odd] == [("0", 2, "few_cells"), ("0", 3, "null_part"), ("1", 1, "few_cells")]


def test_page_count(spark):
    parsed = parsed_df(spark, [listing(rows=R1, pager="Strona: 1/7"),
                               listing(rows=R1, pager="Strona: 3/12 "),
                               listing(rows=R1, pager="brak")])
    got = [r.num_pages for r in pages.total_pages(parsed).orderBy("request_id").collect()]
    assert got == [7, 12, None]


def test_diagnosis_precedence_and_scopes(spark):
    no_docs = "Brak dokumentów dla KRS: 0000057814"
    cannot = "Witryna sieci Web nie może wyświetlić strony"
    wait = "Wymagane oczekiwanie pomiędzy kolejnymi wywołaniami"
    bodies = [
        message_page(("unloggedForm:j_idt12", no_docs)),
        message_page(("javax.faces.ViewRoot", cannot)),
        message_page(("unloggedForm:j_idt99", wait)),
        message_page(("unloggedForm:j_idt12", wait), ("javax.faces.ViewRoot", cannot)),
        message_page(("unloggedForm:j_idt1", "ok"), ("unloggedForm:j_idt2", no_docs)),  # first only
        message_page(("otherForm", no_docs)),                                           # wrong scope
        "<partial-response><changes><update id='x'>unclosed",                           # malformed
        listing(rows=R1),
        "<html><head><title>Przerwa techniczna</title></head><body><br></body></html>",
    ]
    parsed = parsed_df(spark, bodies)
    out = parsed.select("request_id", pages.diagnose(pages.register_page_checks(F.col("title"))).alias("d"))
    got = [r.d for r in out.orderBy(F.col("request_id").cast("int")).collect()]
    assert got == ["no_documents", "cannot_display", "throttled", "cannot_display", "no_listing",
                   "no_listing", "malformed", "ok", "maintenance"]
    plain = parsed.select(pages.diagnose(pages.register_page_checks(listing=False)).alias("d"))
    assert [r.d for r in plain.collect()].count("ok") == 3
    empty = parsed_df(spark, [listing(rows="")])
    assert empty.select(pages.diagnose(pages.register_page_checks()).alias("d")).first().d == "no_table"


def test_maintenance_title(spark):
    df = spark.createDataFrame([("<html><head><title>Przerwa techniczna</title></head></html>",),
                                ("<html><head></head><body>no title</body></html>",),
                                ("<html><title>Szukaj</title></html>",)], "html string")
    checks = [("maintenance", pages.page_title(F.col("html")) == F.lit("Przerwa techniczna"))]
    got = [r.d for r in df.select(pages.diagnose(checks).alias("d")).collect()]
    assert got == ["maintenance", "ok", "ok"]


def test_parser_is_total():
    for body in [None, "", "<x>", "<partial-response/>", listing(rows="<tr></tr>")]:
        out = pages.parse_partial_response(body)
        assert set(out) == set(pages.PARSED_FIELDS.fieldNames())


def test_update_block_by_id(spark):
    df = spark.createDataFrame([("1", listing(rows=R1))], "request_id string, body string")
    parsed = pages.parse_pages(df, "body", ["request_id"], keep_updates=True)
    row = parsed.select(F.col("updates")["j_id1:javax.faces.ViewState:0"].alias("vs"),
                        F.col("updates")["nope"].alias("none")).first()
    assert row.vs == "123:456" and row.none is None


def test_unclosed_cells_are_kept():
    html = ("<table><tr><td>1<td>Roczne<td>Bilans<td>01.01.2023<td>31.12.2023<td>Złożony"
            "<td><a id='x:1'>Pokaż szczegóły</a><tr><td>2<td>A<td>B<td>C<td>D</table>")
    body = ("<partial-response><changes><update id='searchForm'><![CDATA[" + html
            + "]]></update></changes></partial-response>")
    rows = pages.parse_partial_response(body)["rows"]
    assert rows == [["1", "Roczne", "Bilans", "01.01.2023", "31.12.2023", "Złożony", "x:1"],
                    ["2", "A", "B", "C", "D"]]


def test_script_style_and_comments_are_not_text():
    msg = ("<div><script>var m='Brak dokumentów dla KRS:';</script><style>p{}</style>"
           "<!-- Brak dokumentów dla KRS: -->ok</div>")
    out = pages.parse_partial_response(message_page(("unloggedForm:j_idt1", msg)))
    assert out["message_text"] == "ok"
    cell = ("<table><tr><td>1<script>x()</script></td><td>T</td><td>N</td><td>F</td><td>D</td></tr></table>")
    body = ("<partial-response><changes><update id='searchForm'><![CDATA[" + cell
            + "]]></update></changes></partial-response>")
    assert pages.parse_partial_response(body)["rows"] == [["1", "T", "N", "F", "D"]]


def test_missing_pages_without_any_count(spark):
    from regiflow.plans import requests

    rows = [("a", 1, None, "throttled"), ("b", 1, None, "maintenance"), ("b", 2, None, "malformed"), ("c", 1, None, "no_documents"),
            ("d", 1, 3, "ok"), ("d", 3, None, "throttled"), ("e", 1, 1, "ok"), ("f", 2, None, "cannot_display"),
            ("g", 1, 1, "ok"), ("g", 1, None, "throttled"), ("g", 4, None, "throttled"), ("h", 1, None, None)]
    parsed = spark.createDataFrame(rows, "krs_number string, page int, num_pages int, diagnosis string")
    got = sorted(tuple(r) for r in requests.missing_pages(parsed).collect())
    assert got == [("a", 1), ("b", 1), ("b", 2), ("d", 2), ("d", 3), ("f", 1), ("f", 2), ("g", 4), ("h", 1)]


def test_update_blocks_as_rows(spark):
    two = ("<partial-response><changes><update id='a'><![CDATA[<b>x</b>]]></update><update id='b'>ż</update><update id='a'>later</update>"
           "<update>none</update></changes></partial-response>")
    df = spark.createDataFrame([(1, two), (2, "<broken"), (3, None), (4, "<partial-response/>")], "request_id int, body string")
    out = pages.update_blocks(df)
    assert sorted(map(tuple, out.collect())) == [(1, "", 2, "none"), (1, "a", 0, "<b>x</b>"), (1, "b", 1, "ż")]
    assert [r.update_text for r in out.filter("update_id = 'b'").collect()] == ["ż"]
    parsed = pages.parse_pages(df, keep_updates=True).filter("updates is not null").collect()
    assert {(r.request_id, i): t for r in parsed for i, t in r.updates.items()} == {(r[0], r[1]): r[3] for r in out.collect()}


def test_a_slice_of_a_batch_is_parsed_at_a_time():
    """A worker's memory does not grow with the pages of an Arrow batch, nor
    with their size: the results leave it in bounded slices."""
    names = pages.PARSED_FIELDS.fieldNames()
    columns = ["request_id", "body"]

    def parsed(bodies):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies, pa.string())], columns)
        return pages.parsed_batches(iter([batch]), ["request_id"], False, names)

    def peak(n):
        found, batches = 0, parsed([listing(rows=R1 + SHORT + R2)] * n)
        tracemalloc.start()
        for out in batches:
            assert out.num_rows <= pages.SLICE_PAGES
            found += out.num_rows
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == n
        return most

    assert peak(2048) < 1.5 * peak(256)
    large = listing(rows=R1 + "<!--" + "x" * (pages.SLICE_BYTES // 3) + "-->")
    bodies = [large, None, large, large, listing(rows=R1), "", large * 4, listing(rows=SHORT)]
    out = list(parsed(bodies))
    assert [b.num_rows for b in out] == [3, 3, 1, 1]
    got = [r for b in out for r in b.to_pylist()]
    assert got == [{"request_id": i, **pages.parse_partial_response(b)} for i, b in enumerate(bodies)]


def test_parsed_pages_keep_their_columns(spark):
    """Kept columns pass the parser as they are, nulls and long numbers too."""
    df = spark.createDataFrame([(2**60 + 1, None, listing(rows=SHORT)), (None, 3, None), (7, 4, "<broken")], "id long, page int, body string")
    for updates in (False, True):
        out = pages.parse_pages(df, "body", ["id", "page"], keep_updates=updates).collect()
        assert sorted(((r.id, r.page, r.malformed, r.rows) for r in out), key=str) == sorted(
            [(2**60 + 1, None, False, [[], ["a", "b", "c", "d"]]), (None, 3, True, None), (7, 4, True, None)], key=str)
    assert pages.parse_pages(df.limit(0), "body", ["id"]).collect() == []
