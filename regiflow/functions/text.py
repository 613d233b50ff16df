"""Text columns: file headers, file names, page titles and links.

All built-in expressions.  ``regexp_extract`` answers '' when nothing matches,
so every extraction is wrapped in ``nullif(..., '')``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiflow import constants as K

_LATIN1_ONLY = r"\A[\x00-\xFF]*\z"


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def repair_header(c: Column) -> Column:
    """A UTF-8 header that was decoded as Latin-1 is re-encoded to
    Latin-1 bytes and decoded as UTF-8.  Text that is not Latin-1, or whose
    bytes are not UTF-8, gives null (``repair_reason`` says why) instead of
    failing the query as ``encode``/``decode`` do under ANSI."""
    latin1 = c.rlike(_LATIN1_ONLY)
    raw = F.encode(F.when(latin1, c), "ISO-8859-1")
    return F.try_validate_utf8(raw.cast("string"))


def repair_reason(c: Column) -> Column:
    return (
        F.when(c.isNull(), F.lit("no_header"))
        .when(~c.rlike(_LATIN1_ONLY), F.lit("not_latin1"))
        .when(repair_header(c).isNull(), F.lit("not_utf8"))
    )


def file_name(header: Column) -> Column:
    """The quoted file name of a Content-Disposition text, or null."""
    return nullif_empty(F.regexp_extract(header, K.FILENAME_PATTERN, 1))


def file_extension(name: Column) -> Column:
    """Text after the last dot; the whole name when it has no dot."""
    return F.substring_index(name, ".", -1)


def archive_entry_name(krs: Column, save_name: Column) -> Column:
    """``{krs}_{save_name}``."""
    return F.concat(krs, F.lit("_"), save_name)


def html_title(html: Column) -> Column:
    """Text of the first ``<title>`` element (null when there is none)."""
    return nullif_empty(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def pages_count(pager_text: Column) -> Column:
    """Total pages from the pager text ``Strona: 1/7``."""
    return nullif_empty(F.regexp_extract(pager_text, K.PAGER_PATTERN, 1)).try_cast("int")


def nav_links(html: Column) -> Column:
    """Targets of the links inside the first ``<nav>`` block, in order."""
    nav = F.regexp_extract(html, r"(?s)<nav>(.*?)</nav>", 1)
    return F.regexp_extract_all(nav, F.lit(r"<a href=\"([^\"]*)\""), F.lit(1))
