"""Company keys and content keys of documents.

* ``zfill`` never cuts a longer key (``lpad`` would) and keeps a sign first.
* The document key is SHA-256 of the normalised concatenation of company,
  type, name, date from and date to, with no separator.  Normalising is
  NFKD -> strip -> lower -> NBSP to space:

  - NFKD is built of array functions over tables (``nfkd``); ASCII rows, where
    it is the identity, skip it;
  - strip is ``btrim`` with Python's whitespace set (``str.isspace``), which
    only looks at the two ends of the text - a regex would scan all of it;
  - the rest is built-in.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiflow import constants as K
from regiflow.functions.nfkd import nfkd

# Python's str.strip() removes exactly the characters for which
# str.isspace() holds; built from that rule, ASCII subset apart.
PY_WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
ASCII_WHITESPACE = "".join(ch for ch in PY_WHITESPACE if ord(ch) < 128)


def zfill(c: Column, width: int = K.KRS_LENGTH) -> Column:
    """``str.zfill``: pad with zeros to ``width``; keep a leading sign first;
    never truncate."""
    signed = c.startswith("+") | c.startswith("-")
    padded = F.when(
        signed,
        F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, 2, 1 << 30), width - 1, "0")),
    ).otherwise(F.lpad(c, width, "0"))
    return F.when(F.length(c) < width, padded).otherwise(c)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def ascii_normalize(c: Column) -> Column:
    """NFKD -> strip -> lower -> NBSP to space, for ASCII text (NFKD is the
    identity there and NBSP cannot occur)."""
    return F.lower(F.btrim(c, F.lit(ASCII_WHITESPACE)))


def normalize(c: Column) -> Column:
    """NFKD, strip, lower, NBSP to space - on any text."""
    full = F.replace(F.lower(F.btrim(nfkd(c), F.lit(PY_WHITESPACE))), F.lit("\xa0"), F.lit(" "))
    return F.when(is_ascii(c), ascii_normalize(c)).otherwise(full)


def sha256_hex(c: Column) -> Column:
    """P10: SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(c, 256)


def document_key(krs: Column, doc_type: Column, name: Column, date_from: Column,
                 date_to: Column) -> Column:
    """``sha256(normalize(krs+type+name+from+to))``; null if a part is
    null (the caller sends such rows to quarantine)."""
    return sha256_hex(normalize(F.concat(krs, doc_type, name, date_from, date_to)))


def document_key_reason(*parts: Column) -> Column:
    cond = None
    for p in parts:
        cond = p.isNull() if cond is None else (cond | p.isNull())
    return F.when(cond, F.lit("null_part"))
