"""Landed register pages: structure, diagnosis (F8/F9), listing rows (P6),
page count (P7).

A landed page is a JSF partial response - XML whose ``<update id=...>``
elements carry HTML in CDATA.  Spark's ``xpath`` functions fail the whole
query on one malformed page, and the table cells need an HTML parser, so one
Python step parses each page (``mapInArrow``, a few pages of a batch at a
time, stdlib ``xml.etree`` and ``html.parser``) into plain columns; everything after that -
the marker checks, zipping cells to column names, hashing, exploding - is
built-in Spark.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiflow import constants as K
from regiflow.functions import keys
from regiflow.functions.text import html_title, pages_count

_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title>")

PARSED_FIELDS = T.StructType([
    T.StructField("malformed", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("has_listing", T.BooleanType()),
    T.StructField("message_text", T.StringType()),
    T.StructField("viewroot_text", T.StringType()),
    T.StructField("pager_text", T.StringType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])


class _TableReader(HTMLParser):
    """Cells of every ``tr`` of an HTML fragment.

    A cell is the ``id`` of its first link when that link's text contains the
    details label, else the cell's text pieces stripped and joined.  Also
    keeps the text of the first ``span.ui-paginator-current`` and the whole
    text of the fragment.  Text inside ``script``/``style`` and comments is
    not page text."""

    _NOT_TEXT = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str | None]] = []
        self.text: list[str] = []
        self.pager: list[str] | None = None
        self._pager_depth = 0
        self._row: list | None = None
        self._cell: list[str] | None = None
        self._link: dict | None = None      # first link of the current cell
        self._in_link = 0
        self._hidden = 0                    # depth inside script/style

    def _close_cell(self) -> None:
        """Finish the open cell (also when its end tag is missing)."""
        if self._cell is None or self._row is None:
            self._cell, self._link = None, None
            return
        link = self._link
        if link is not None and K.DETAILS_LINK_TEXT in "".join(link["text"]):
            self._row.append(link["id"])
        else:
            self._row.append("".join(p.strip() for p in self._cell if p.strip()))
        self._cell, self._link, self._in_link = None, None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self._NOT_TEXT:
            self._hidden += 1
            return
        if tag == "tr":
            self._close_cell()
            self._row = []
            self.rows.append(self._row)
        elif tag == "td" and self._row is not None:
            self._close_cell()
            self._cell, self._link = [], None
        elif tag == "a" and self._cell is not None:
            if self._link is None:
                self._link = {"id": a.get("id"), "text": []}
                self._in_link = 1
            elif self._in_link:
                self._in_link += 1
        if tag == "span":
            if self._pager_depth:
                self._pager_depth += 1
            elif self.pager is None and "ui-paginator-current" in (a.get("class") or "").split():
                self.pager, self._pager_depth = [], 1

    def handle_endtag(self, tag):
        if tag in self._NOT_TEXT:
            self._hidden = max(0, self._hidden - 1)
            return
        if tag == "a" and self._in_link:
            self._in_link -= 1
        elif tag == "td":
            self._close_cell()
        elif tag == "tr":
            self._close_cell()
            self._row = None
        if tag == "span" and self._pager_depth:
            self._pager_depth -= 1

    def handle_data(self, data):
        if self._hidden:
            return
        self.text.append(data)
        if self._cell is not None:
            self._cell.append(data)
            if self._in_link and self._link is not None:
                self._link["text"].append(data)
        if self._pager_depth and self.pager is not None:
            self.pager.append(data)


def _read_html(fragment: str | None) -> _TableReader | None:
    if fragment is None:
        return None
    reader = _TableReader()
    reader.feed(fragment)
    reader.close()
    reader._close_cell()
    return reader


UPDATES_FIELD = T.StructField("updates", T.MapType(T.StringType(), T.StringType()))

_ARROW_TYPES = {"malformed": pa.bool_(), "has_listing": pa.bool_(), "rows": pa.list_(pa.list_(pa.string())),
                "updates": pa.map_(pa.string(), pa.string())}     # the other parsed fields are strings


def update_texts(body: str | None) -> dict[str, str] | None:
    """The text of every update block of a partial response by id, the first
    of each id, in their order; null for a body that is no XML."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return None
    out: dict[str, str] = {}
    for el in root.iter("update"):
        out.setdefault(el.get("id") or "", el.text or "")
    return out


@F.udtf(returnType="update_id string, place int, update_text string", useArrow=True)
class UpdateBlocks:
    """One row per update block of a page body."""

    def eval(self, body: str) -> Iterator[tuple[str, int, str]]:
        for place, (update_id, text) in enumerate((update_texts(body) or {}).items()):
            yield update_id, place, text


def update_blocks(pages: DataFrame, body: str = "body", keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """P8 as rows: the update blocks of every landed page, ``(keep, update_id,
    place, update_text)``, by a lateral join with a table function.  A block is
    looked up by a filter on its id; a page that is no XML has none."""
    rows = pages.select(*keep, F.col(body).alias("_body")).lateralJoin(UpdateBlocks(F.col("_body").outer()))
    return rows.select(*keep, "update_id", "place", "update_text")


def parse_partial_response(body: str | None, keep_updates: bool = False) -> dict:
    """Structure of one landed page (see ``PARSED_FIELDS``); with
    ``keep_updates`` also every update block's text by id (first of each
    id), for P8 lookups."""
    out = {"malformed": False, "title": None, "has_listing": False, "message_text": None,
           "viewroot_text": None, "pager_text": None, "rows": None}
    if keep_updates:
        out["updates"] = None
    if body is None:
        out["malformed"] = True
        return out
    title = _TITLE.search(body)
    if title:
        out["title"] = html.unescape(title.group(1)) or None
    by_id = update_texts(body)
    if by_id is None:
        out["malformed"] = True
        return out
    message = next((t for i, t in by_id.items() if i.startswith(K.MESSAGE_UPDATE_PREFIX)), None)
    if message is not None:
        out["message_text"] = "".join(_read_html(message).text)
    if K.VIEWROOT_UPDATE_ID in by_id:
        out["viewroot_text"] = "".join(_read_html(by_id[K.VIEWROOT_UPDATE_ID]).text)
    if keep_updates:
        out["updates"] = by_id
    listing = next((by_id[i] for i in K.LISTING_UPDATE_IDS if i in by_id), None)
    if listing is not None:
        out["has_listing"] = True
        reader = _read_html(listing)
        out["rows"] = reader.rows
        if reader.pager is not None:
            out["pager_text"] = "".join(p.strip() for p in reader.pager if p.strip())
    return out


SLICE_PAGES, SLICE_BYTES = 256, 1 << 20


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of runs of at most ``SLICE_PAGES`` pages and
    ``SLICE_BYTES`` bytes; a larger page is a run of its own."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == SLICE_PAGES or held + size > SLICE_BYTES):
            yield start, i - start
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def _parsed_slice(batch: pa.RecordBatch, keep: Sequence[str], keep_updates: bool, names: Sequence[str]) -> pa.RecordBatch:
    parsed = [parse_partial_response(b.as_py(), keep_updates) for b in batch.column(len(keep))]
    if keep_updates:
        for p in parsed:
            p["updates"] = p["updates"] and list(p["updates"].items())
    fields = [pa.array([p[f] for p in parsed], _ARROW_TYPES.get(f, pa.string())) for f in names]
    return pa.RecordBatch.from_arrays(batch.columns[:len(keep)] + fields, [*keep, *names])


def parsed_batches(batches: Iterator[pa.RecordBatch], keep: Sequence[str], keep_updates: bool,
                   names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The parsed pages of Arrow batches of ``keep`` columns and the body, a
    slice at a time: as Python objects there are only the pages of one slice,
    however many a batch has."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).to_pylist()
        for start, length in _slices(sizes):
            yield _parsed_slice(batch.slice(start, length), keep, keep_updates, names)
        del batch       # not held while the next one is read


def parse_pages(pages: DataFrame, body: str = "body", keep: Sequence[str] = ("request_id",),
                keep_updates: bool = False) -> DataFrame:
    """Parse every landed page; output ``keep`` columns + ``PARSED_FIELDS``
    (+ ``updates``, id -> text of every update block, with
    ``keep_updates``: P8 is then ``F.col("updates")[id]``).

    Runs inside the executors, a slice of an Arrow batch at a time; the body
    is not carried past this step."""
    keep = list(keep)
    fields = PARSED_FIELDS.fields + ([UPDATES_FIELD] if keep_updates else [])
    schema = T.StructType([pages.schema[c] for c in keep] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed_batches(batches, keep, keep_updates, names)

    return pages.select(*keep, body).mapInArrow(run, schema)


MIN_CELLS = 5   # a listing row has at least the five key parts
_KEY_PARTS = ("document_type", "document_name", "document_from", "document_to")


def _data_rows() -> Column:
    """Table rows with cells; a row without any ``td`` is a header."""
    return F.filter(F.coalesce(F.col("rows"), F.array()), lambda r: F.size(r) >= 1)


def diagnose(checks: Sequence[tuple[str, Column]], default: str = "ok") -> Column:
    """F8: the first check that holds, in the given (precedence) order."""
    expr = None
    for label, cond in checks:
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def register_page_checks(parsed_title: Column | None = None,
                         listing: bool = True) -> list[tuple[str, Column]]:
    """F8/F9 for register pages, in precedence order.  Each marker is looked
    for only in its own scope: the page title (equality; ``parse_pages`` gives
    it as ``title``), the first message update, the view-root update.  A missing scope never flags.  With
    ``listing`` (answers to listing requests) a missing listing block or an
    empty table is flagged after the markers."""
    checks = []
    if parsed_title is not None:
        checks.append(("maintenance", parsed_title == F.lit(K.MAINTENANCE_TITLE)))
    checks += [
        ("malformed", F.col("malformed")),
        ("no_documents", F.col("message_text").contains(K.NO_DOCUMENTS_TEXT)),
        ("cannot_display", F.col("viewroot_text").contains(K.CANNOT_DISPLAY_TEXT)),
        ("throttled", F.col("message_text").contains(K.THROTTLED_TEXT)),
    ]
    if listing:
        # a listing answer without its listing block, or without any table
        # row, is an error upstream (not an empty listing)
        checks += [
            ("no_listing", ~F.col("has_listing")),
            ("no_table", F.size(_data_rows()) == 0),
        ]
    return checks


def page_title(html: Column) -> Column:
    """Title of an HTML page for the maintenance check (null if absent: not
    in maintenance)."""
    return html_title(html)


def listing_rows(parsed: DataFrame, krs: str = "krs_number", page: str = "page",
                 min_cells: int = MIN_CELLS, keep: Sequence[str] = ()) -> DataFrame:
    """P6+P11: one row per table row of a parsed listing page, cells zipped to
    the listing's column names (longer rows cut), with the content key.

    ``position`` counts the rows with at least ``min_cells`` cells from 1, so
    ``(page - 1) * 10 + position`` is the row's index in the whole listing;
    ``table_row`` counts all rows with cells, as in ``listing_quarantine``,
    where rows with fewer cells than the key needs, or without one of its
    parts, are.  Rows without cells are headers."""
    named = _named_rows(parsed, krs, page, min_cells, keep).filter(_row_reason(krs).isNull())
    return named.withColumn("document_hash_id", keys.document_key(
        F.col(krs), F.col("document_type"), F.col("document_name"),
        F.col("document_from"), F.col("document_to")))


def _named_rows(parsed: DataFrame, krs: str, page: str, min_cells: int, keep: Sequence[str]) -> DataFrame:
    numbered = F.transform(_data_rows(), lambda r, i: F.struct((i + 1).alias("table_row"), r.alias("cells")))
    long_enough = F.filter(numbered, lambda r: F.size(r["cells"]) >= min_cells)
    rows = parsed.select(*keep, krs, page, F.posexplode(long_enough).alias("_pos", "_row"))
    cell = lambda i: F.try_element_at(F.col("_row.cells"), F.lit(i + 1))
    return rows.select(
        *keep, krs, page, (F.col("_pos") + 1).alias("position"), F.col("_row.table_row").alias("table_row"),
        *[cell(i).alias(name) for i, name in enumerate(K.LISTING_COLUMNS)])


def _row_reason(krs: str) -> Column:
    return keys.document_key_reason(*[F.col(c) for c in (krs, *_KEY_PARTS)])


def listing_quarantine(parsed: DataFrame, krs: str = "krs_number", page: str = "page",
                       min_cells: int = MIN_CELLS, keep: Sequence[str] = ()) -> DataFrame:
    """The data rows of a parsed page that are no listing rows: ``(krs_number,
    page, table_row, n_cells, cells, reason)`` with reason ``few_cells`` or
    ``null_part``.  ``table_row`` counts all rows with cells, from 1: a page's
    rows here and in ``listing_rows`` have the numbers 1 to n, each once."""
    keep = list(keep)
    every = parsed.select(*keep, krs, page, F.posexplode(_data_rows()).alias("_pos", "cells"))
    cell = lambda name: F.try_element_at(F.col("cells"), F.lit(K.LISTING_COLUMNS.index(name) + 1))
    reason = (F.when(F.size("cells") < min_cells, F.lit("few_cells"))
              .otherwise(keys.document_key_reason(F.col(krs), *map(cell, _KEY_PARTS))))
    return (every.select(*keep, krs, page, (F.col("_pos") + 1).alias("table_row"), F.size("cells").alias("n_cells"), "cells",
                         reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def skipped_rows(min_cells: int = MIN_CELLS) -> Column:
    """Rows of a parsed page that are not listing rows (too few cells)."""
    return F.size(F.filter(F.coalesce(F.col("rows"), F.array()), lambda r: F.size(r) < min_cells))


def total_pages(parsed: DataFrame) -> DataFrame:
    """P7 on parsed pages."""
    return parsed.withColumn("num_pages", pages_count(F.col("pager_text")))
