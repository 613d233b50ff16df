"""Archives of requested documents (S10) and their manifest.

Upstream builds one in-memory zip for a whole request.  Here every company's
documents are split into parts of bounded size before grouping, on records
without contents: ``bounded_parts`` cuts a company by its running bytes, so no
part is over ``part_bytes`` but a single document that is.  A company holding a
third of all bytes becomes many groups, and no task holds more than one group's
bytes at a time.  Each group is zipped by ``applyInPandas`` (deflate, entry
``{krs}_{save_name}``).  ``assign_parts`` spreads documents by hash instead,
which needs no order but holds a part to ``part_bytes`` only in expectation.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiflow.functions.text import archive_entry_name
from regiflow.operators.running import running_sums

ARCHIVE_SCHEMA = ("krs_number string, part int, n_parts int, n_entries bigint, "
                  "n_bytes bigint, archive binary")
DEFAULT_PART_BYTES = 64 << 20
ZIP_TIME = (1980, 1, 1, 0, 0, 0)


def manifest(docs: DataFrame, krs: str = "krs_number", save_name: str = "document_content_save_name",
             content: str = "document_content") -> DataFrame:
    """Entry name and size of every requested document; the size is the
    record's ``n_bytes`` where it is stored, so no content is read."""
    size = F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length(F.col(content))
    return docs.select(
        krs, "hash_id",
        archive_entry_name(F.col(krs), F.col(save_name)).alias("entry_name"),
        size.cast("bigint").alias("n_bytes"),
    )


def assign_parts(docs: DataFrame, krs: str = "krs_number", content: str = "document_content",
                 part_bytes: int = DEFAULT_PART_BYTES) -> DataFrame:
    """Salt each company's documents into ``n_parts`` bounded parts.

    The sizes are one row per company (``n_bytes`` of the records, or the
    content's length).  They are joined by AQE's choice; a company's rows are
    spread by ``build_archives`` right after."""
    size = F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length(F.col(content))
    sizes = (docs.select(krs, size.alias("_b"))
                 .groupBy(krs).agg(F.sum("_b").alias("_company_bytes")))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("_company_bytes") / F.lit(part_bytes))).cast("int")
    sized = sizes.select(krs, n_parts.alias("n_parts"))
    return (docs.join(sized, krs, "inner")
                .withColumn("part", F.pmod(F.xxhash64("hash_id"), F.col("n_parts")).cast("int")))


def bounded_parts(records: DataFrame, krs: str = "krs_number", part_bytes: int = DEFAULT_PART_BYTES) -> DataFrame:
    """``(krs, hash_id, n_bytes, part, n_parts)`` of records with ``n_bytes``:
    no part of more than one document holds over ``part_bytes``.

    Documents of at most half a part go, in key order, to the part of
    ``part_bytes // 2`` running bytes in which they start: a part then holds
    less than a half and one more document.  Larger ones are parts of their
    own, numbered after these.  Parts count from 0 without gaps."""
    half = part_bytes // 2
    size = F.coalesce(F.col("n_bytes"), F.lit(0)).cast("long")
    small = size <= half
    summed = running_sums(records.select(krs, "hash_id", "n_bytes"), [krs], ["hash_id"],
                          {"_before": F.when(small, size), "_large": F.when(small, 0).otherwise(1)})
    start = F.expr(f"_before div {max(half, 1)}L")
    shape = summed.groupBy(F.col(krs).alias("_krs")).agg(
        (F.coalesce(F.max(F.when(small, start)), F.lit(-1)) + 1).alias("_small_parts"), F.count_if(~small).alias("_large_parts"))
    part = F.when(small, start).otherwise(F.col("_small_parts") + F.col("_large"))
    return summed.join(shape, F.col(krs).eqNullSafe(F.col("_krs"))).select(
        krs, "hash_id", "n_bytes", part.cast("int").alias("part"), (F.col("_small_parts") + F.col("_large_parts")).cast("int").alias("n_parts"))


def build_from_store(records: DataFrame, contents: DataFrame, krs: str = "krs_number",
                     save_name: str = "document_content_save_name", content: str = "document_content",
                     part_bytes: int = DEFAULT_PART_BYTES) -> DataFrame:
    """S10 over records that carry ``n_bytes`` and have a ``hash_id`` each:
    parts are cut on the narrow records, and only then the contents are joined
    by ``hash_id``, so contents are read once."""
    parts = bounded_parts(records, krs, part_bytes).drop("n_bytes")
    parted = records.select(krs, "hash_id", save_name).join(parts, [krs, "hash_id"])
    return _zipped(parted.join(contents.select("hash_id", content), "hash_id"), krs, save_name, content)


def _zip_group(pdf: pd.DataFrame) -> pd.DataFrame:
    buf = io.BytesIO()
    pdf = pdf.sort_values("entry_name", kind="stable")
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, content in zip(pdf["entry_name"], pdf["document_content"]):
            # fixed entry time: a retried task writes the same bytes
            info = zipfile.ZipInfo(name, date_time=ZIP_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            zf.writestr(info, b"" if content is None else bytes(content))
    first = pdf.iloc[0]
    return pd.DataFrame({
        "krs_number": [first["krs_number"]],
        "part": [int(first["part"])],
        "n_parts": [int(first["n_parts"])],
        "n_entries": [len(pdf)],
        "n_bytes": [int(pdf["document_content"].map(lambda b: 0 if b is None else len(b)).sum())],
        "archive": [buf.getvalue()],
    })


def build_archives(docs: DataFrame, krs: str = "krs_number",
                   save_name: str = "document_content_save_name",
                   content: str = "document_content",
                   part_bytes: int = DEFAULT_PART_BYTES) -> DataFrame:
    """One deflated zip per (company, part)."""
    return _zipped(assign_parts(docs, krs, content, part_bytes), krs, save_name, content)


def _zipped(parted: DataFrame, krs: str, save_name: str, content: str) -> DataFrame:
    parted = parted.select(
        F.col(krs).alias("krs_number"), "part", "n_parts", "hash_id",
        archive_entry_name(F.col(krs), F.col(save_name)).alias("entry_name"),
        F.col(content).alias("document_content"),
    )
    # Shuffle on (company, part) explicitly: grouping right after a join on
    # the company alone could reuse that partitioning and keep a hot company
    # in one task, which is what the parts are for.
    spread = parted.repartition("krs_number", "part")
    return spread.groupBy("krs_number", "part").applyInPandas(_zip_group, ARCHIVE_SCHEMA)
