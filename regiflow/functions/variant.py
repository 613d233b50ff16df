"""Register extracts as ``variant``: parse once, read fields by path.

The extract's shape differs between domestic and foreign entities and, in the
full extract, a field can be a history list instead of a scalar, so the
document is kept as a variant rather than an inferred struct.  Malformed JSON
gives null (``try_parse_json``), never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "$.odpis"
KIND_PATH = "$.odpis.rodzaj"
SECTION1 = "$.odpis.dane.dzial1"

# --- fixed values: field map of the company record ------------------------
# entity = danePodmiotu or danePodmiotuZagranicznego
# seat   = siedzibaIAdres or siedzibaIAdresPodmiotuZagranicznego
ENTITY_KEYS = ["danePodmiotu", "danePodmiotuZagranicznego"]
SEAT_KEYS = ["siedzibaIAdres", "siedzibaIAdresPodmiotuZagranicznego"]
COMPANY_FIELDS = [
    ("full_name", "entity", ["nazwa"]),
    ("legal_form", "entity", ["formaPrawna", "nazwaFormaPrawnaPrzedsiebiorcyZagranicznego"]),
    ("nip_number", "entity", ["identyfikatory.nip"]),
    ("regon_number", "entity", ["identyfikatory.regon"]),
    ("country", "seat", ["adres.kraj"]),
    ("voivodeship", "seat", ["siedziba.wojewodztwo"]),
    ("county", "seat", ["siedziba.powiat"]),
    ("municipality", "seat", ["siedziba.gmina"]),
    ("city", "seat", ["adres.miejscowosc"]),
    ("postal_number", "seat", ["adres.kodPocztowy"]),
    ("street", "seat", ["adres.ulica"]),
    ("house_number", "seat", ["adres.nrDomu"]),
    ("email", "seat", ["adresPocztyElektronicznej"]),
    ("webpage", "seat", ["adresStronyInternetowej"]),
]


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def get(v: Column, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(v, path, dtype)


def _present(v: Column) -> Column:
    """Python truthiness of a JSON value: not null, not '', {}, [], false or
    0.  Objects (the common case here) are tested by their number of keys,
    which is far cheaper than writing them out as JSON text."""
    as_object = F.try_variant_get(v, "$", "map<string,variant>")
    other = ~F.to_json(v).isin('""', "[]", "false", "0")
    return v.isNotNull() & ~F.is_variant_null(v) & F.when(as_object.isNotNull(), F.size(as_object) > 0) \
        .otherwise(other)


def first_present(*values: Column) -> Column:
    """P20: ``a or b or ...`` with Python's notion of an empty value: the
    first present value, else the last one (as Python's ``or`` answers)."""
    expr = None
    for v in values[:-1]:
        expr = F.when(_present(v), v) if expr is None else expr.when(_present(v), v)
    return values[-1] if expr is None else expr.otherwise(values[-1])


def scalar(v: Column) -> Column:
    """A field that is either a scalar or a history list: take the list's last
    entry.  (The list form is not confirmed by any sample.)"""
    as_list = F.try_variant_get(v, "$", "array<variant>")
    picked = F.when(as_list.isNotNull(), F.element_at(as_list, -1)).otherwise(v)
    return F.try_variant_get(picked, "$", "string")


def extract_kind(raw: Column) -> Column:
    """``odpis.rodzaj`` of a raw extract text."""
    return get(parse(raw), KIND_PATH)


def company_record(df: DataFrame, raw: str = "raw_data", keep: Sequence[str] = ()) -> DataFrame:
    """P18+P19: the extract kind and the company record of every raw extract,
    one column per field; ``keep`` columns pass through.

    Staged projections: parse once, take section 1 once, resolve the entity
    and the seat (domestic or foreign, P20) once, then read the fields.  Each
    stage is used several times by the next, so Catalyst keeps it as its own
    projection instead of copying the parse into every field.  County takes
    ``powiat`` and municipality ``gmina`` (upstream had them swapped)."""
    keep = list(keep)
    values = [scalar(value).alias(name) for name, value in _fields()]
    return _scoped(df, raw, keep).select(*keep, "extract_kind", *values)


def _scoped(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """The extract kind, the entity and the seat of every extract."""
    parsed = df.select(*keep, parse(F.col(raw)).alias("_v"))
    section = parsed.select(*keep, get(F.col("_v"), KIND_PATH).alias("extract_kind"),
                            get(F.col("_v"), SECTION1, "variant").alias("_d"))
    return section.select(
        *keep, "extract_kind",
        first_present(*[get(F.col("_d"), f"$.{k}", "variant") for k in ENTITY_KEYS]).alias("_entity"),
        first_present(*[get(F.col("_d"), f"$.{k}", "variant") for k in SEAT_KEYS]).alias("_seat"))


def _fields() -> list[tuple[str, Column]]:
    """The fields of the company record as variants."""
    out = []
    for name, scope, paths in COMPANY_FIELDS:
        options = [get(F.col(f"_{scope}"), f"$.{p}", "variant") for p in paths]
        out.append((name, options[0] if len(options) == 1 else first_present(*options)))
    return out


def field_history(df: DataFrame, raw: str = "raw_data", keep: Sequence[str] = ()) -> DataFrame:
    """P19 over full extracts: one row for every entry of every field of the
    company record, ``(keep, extract_kind, field, entry, value, is_last)``.

    A field that is a list gives a row for each entry, numbered from 0 as it
    stands; a scalar or an object is one entry.  ``value`` is a scalar as
    text, an object or list as its JSON, null for a JSON null in a list.  A
    field that is missing, null or an empty list has no row.  ``is_last``
    marks the entries that ``company_record`` shows.

    Each extract is parsed once; its fields become rows of one short array and
    their lists are exploded by a lateral ``variant_explode``, so no list is
    gathered again and nothing is shuffled."""
    keep = list(keep)
    fields = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("_value")) for name, value in _fields()])
    rows = _scoped(df, raw, keep).select(*keep, "extract_kind", F.inline(fields))
    rows = rows.filter(F.col("_value").isNotNull() & ~F.is_variant_null("_value"))
    # The number of entries is null for anything but a list, which the explode then leaves as one row without a place.
    size = F.size(F.try_variant_get("_value", "$", "array<variant>"))
    rows = rows.withColumn("_size", F.when(size >= 0, size)).filter("_size is null or _size > 0")
    listed = F.when(F.col("_size").isNotNull(), F.col("_value"))
    entries = rows.withColumn("_list", listed).lateralJoin(
        df.sparkSession.tvf.variant_explode_outer(F.col("_list").outer()))
    entry = F.when(F.col("_size").isNull(), F.col("_value")).otherwise(F.col("value"))
    text = F.coalesce(F.try_variant_get(entry, "$", "string"), F.when(~F.is_variant_null(entry), F.to_json(entry)))
    at = F.coalesce(F.col("pos"), F.lit(0))
    return entries.select(*keep, "extract_kind", "field", at.alias("entry"), text.alias("value"),
                          (at == F.coalesce(F.col("_size"), F.lit(1)) - 1).alias("is_last"))
