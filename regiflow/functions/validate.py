"""Row-level validation as ``reason`` columns (null = valid).

The upstream client raises on the first bad parameter; here every rule is one
branch of a ``CASE`` chain evaluated in the same order, so a bad row gets the
reason the client would have raised and never fails the job.  All checks are
built-in expressions and stay inside whole-stage codegen.

Digits are ASCII only (``[0-9]``): a documented narrowing of ``str.isdigit``,
which also accepts superscripts and other scripts' digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiflow import constants as K

# Reason codes.
NOT_STRING = "not_string"
WRONG_LENGTH = "wrong_length"
NOT_DIGITS = "not_digits"
NOT_ALLOWED = "not_allowed"
BAD_EXTRACT_KIND = "bad_extract_kind"
BAD_DAY = "bad_day"
HOUR_ORDER = "hour_order"
BAD_PAGE = "bad_page"
FILE_ERROR = "file_error"
NO_FILE_NAME = "no_file_name"

# Python's strptime("%Y-%m-%d") accepts exactly four year digits, a month of
# one or two digits and a day of one or two digits (or a space and a digit).
_DAY_SHAPE = r"\A([0-9]{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])\z"


def _is_string(df: DataFrame | None, name: str | None) -> bool:
    if df is None or name is None:
        return True
    return isinstance(df.schema[name].dataType, T.StringType)


def _chain(*branches: tuple[Column, str]) -> Column:
    expr = None
    for cond, reason in branches:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


def digits_only(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def company_key_reason(c: Column, is_string: bool = True, length: int = K.KRS_LENGTH) -> Column:
    """string, exactly ``length`` characters, digits only."""
    if not is_string:  # decided from the schema at plan time
        return F.lit(NOT_STRING)
    return _chain(
        (c.isNull(), NOT_STRING),
        (F.length(c) != length, WRONG_LENGTH),
        (~digits_only(c), NOT_DIGITS),
    )


def registry_reason(c: Column, allowed=tuple(K.REGISTRIES), is_string: bool = True) -> Column:
    """string, one character, one of the allowed registries."""
    if not is_string:
        return F.lit(NOT_STRING)
    return _chain(
        (c.isNull(), NOT_STRING),
        (F.length(c) != 1, WRONG_LENGTH),
        (~c.isin(list(allowed)), NOT_ALLOWED),
    )


def extract_kind_reason(c: Column, allowed=tuple(K.EXTRACT_KINDS)) -> Column:
    """the extract kind is one of the known kinds."""
    return F.when(c.isNull() | ~c.isin(list(allowed)), F.lit(BAD_EXTRACT_KIND))


def parse_day(c: Column) -> Column:
    """F3 helper: the date a ``%Y-%m-%d`` text names, or null."""
    y = F.regexp_extract(c, _DAY_SHAPE, 1)
    m = F.regexp_extract(c, _DAY_SHAPE, 2)
    d = F.trim(F.regexp_extract(c, _DAY_SHAPE, 3))
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    ok = c.rlike(_DAY_SHAPE) & (y != "0000")
    return F.when(ok, F.try_to_date(text, "yyyy-MM-dd"))


def day_reason(c: Column) -> Column:
    """a real calendar day written as ``%Y-%m-%d``."""
    return _chain((c.isNull(), NOT_STRING), (parse_day(c).isNull(), BAD_DAY))


def hour_reason(c: Column) -> Column:
    """two characters, digits.  No 0-23 range rule, as upstream."""
    return _chain(
        (c.isNull(), NOT_STRING),
        (F.length(c) != 2, WRONG_LENGTH),
        (~digits_only(c), NOT_DIGITS),
    )


def combine_bulletin_reasons(day: Column, parsed_day: Column, hour_from_reason: Column,
                             hour_to_reason: Column, hour_from: Column, hour_to: Column) -> Column:
    """F3-F5 in the client's order - day, start hour, end hour, start < end -
    from the already computed parts (parsed day, per-hour reasons)."""
    return (
        F.when(day.isNull(), F.lit(NOT_STRING))
        .when(parsed_day.isNull(), F.lit(BAD_DAY))
        .when(hour_from_reason.isNotNull(), F.concat(F.lit("hour_from_"), hour_from_reason))
        .when(hour_to_reason.isNotNull(), F.concat(F.lit("hour_to_"), hour_to_reason))
        .when(hour_from.cast("int") >= hour_to.cast("int"), F.lit(HOUR_ORDER))
    )


def bulletin_params_reason(day: Column, hour_from: Column, hour_to: Column) -> Column:
    """F3-F5 in the client's order: day, start hour, end hour, start < end."""
    return combine_bulletin_reasons(day, parse_day(day), hour_reason(hour_from), hour_reason(hour_to),
                                    hour_from, hour_to)


def response_outcome(status: Column) -> Column:
    """404 is 'not_found', any other non-200 is 'error', a missing
    response (not landed yet) is 'pending'."""
    return (
        F.when(status.isNull(), F.lit("pending"))
        .when(status == K.NOT_FOUND_STATUS, F.lit("not_found"))
        .when(status != K.OK_STATUS, F.lit("error"))
        .otherwise(F.lit("ok"))
    )


def file_name_reason(name: Column) -> Column:
    """F10 on a file name taken from a header (P13): none found, or the
    service answered with an error file (case-sensitive)."""
    return (
        F.when(name.isNull(), F.lit(NO_FILE_NAME))
        .when(name.contains(K.FILE_ERROR_WORD), F.lit(FILE_ERROR))
    )


def page_reason(page: Column) -> Column:
    """listing pages start at 1."""
    return F.when(page.isNull() | (page < 1), F.lit(BAD_PAGE))


def with_reason(df: DataFrame, reason: Column, name: str = "reason") -> DataFrame:
    return df.withColumn(name, reason).withColumn("valid", F.col(name).isNull())


def split_valid(df: DataFrame, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine, from one ``reason`` column."""
    return df.filter(F.col(name).isNull()), df.filter(F.col(name).isNotNull())


def validate_company_keys(df: DataFrame, key: str) -> DataFrame:
    """F1 over a column; a non-string column fails every row at plan time."""
    return with_reason(df, company_key_reason(F.col(key), _is_string(df, key)))
