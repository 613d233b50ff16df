"""Request plans: which days, pages and companies to fetch, as tables.

The upstream client walks these in Python loops with HTTP calls; here each
plan is a DataFrame (an ``explode`` of a ``sequence``, an ``explode`` of a
literal array) that any fetcher can consume, and the landed answers come back
as tables (``regiflow.sources.landed``).  No plan joins or collects.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiflow import constants as K
from regiflow.functions import keys, validate


def days_back(as_of: Column, n_days: int | Column) -> Column:
    """The ``n`` days ending at ``as_of`` (today included), oldest first;
    empty for ``n < 1``."""
    n = n_days if isinstance(n_days, Column) else F.lit(n_days)
    start = F.date_sub(as_of, n - 1)
    return F.when(n >= 1, F.sequence(start, as_of)).otherwise(F.array().cast("array<date>"))


def _fill(template: str, **parts: Column) -> Column:
    """Fill a ``{name}`` template with columns (``format_string`` keeps the
    fixed text in one place)."""
    fmt, args = template, []
    names = re.findall(r"\{(\w+)\}", template)
    for name in names:
        fmt = fmt.replace("{" + name + "}", "%s", 1)
        args.append(parts[name])
    return F.format_string(fmt, *args)


def bulletin_url(day: Column, hour_from: Column | None = None,
                 hour_to: Column | None = None) -> Column:
    """Change-bulletin address of one day; the sweep asks for hours 0-23."""
    hf = F.lit(str(K.SWEEP_HOUR_FROM)) if hour_from is None else hour_from
    ht = F.lit(str(K.SWEEP_HOUR_TO)) if hour_to is None else hour_to
    return _fill(K.BULLETIN_URL, day=F.date_format(day, "yyyy-MM-dd"),
                 hour_from=hf, hour_to=ht)


def extract_url(krs: Column, registry: Column, kind: str = "pelny") -> Column:
    """Address of a company's current or full extract."""
    template = K.EXTRACT_CURRENT_URL if kind == "aktualny" else K.EXTRACT_FULL_URL
    return _fill(template, krs=krs, registry=registry)


def bulletin_requests(sweeps: DataFrame, as_of: str = "as_of", n_days: int | str = 1) -> DataFrame:
    """P2+P3: one request per distinct day that any sweep needs.

    ``sweeps`` has one row per sweep run (its ``as_of`` day); ``n_days`` is a
    number or a column name."""
    n = F.col(n_days) if isinstance(n_days, str) else n_days
    days = sweeps.select(F.explode(days_back(F.col(as_of).cast("date"), n)).alias("day")).distinct()
    return days.select("day", bulletin_url(F.col("day")).alias("url"))


def bulletin_request_checked(df: DataFrame, day: str, hour_from: str, hour_to: str) -> DataFrame:
    """F3-F5 + P3 (client form, D1 repaired): validate the parameters and
    build the address for the valid rows; hours are sent as given (two
    digits by F4).

    Two projections: the day is parsed and each parameter checked once, then
    the reasons are combined in the client's order."""
    cols = df.columns
    checked = df.select(
        *cols,
        validate.parse_day(F.col(day)).alias("_day"),
        validate.hour_reason(F.col(hour_from)).alias("_hf"),
        validate.hour_reason(F.col(hour_to)).alias("_ht"))
    reason = validate.combine_bulletin_reasons(F.col(day), F.col("_day"), F.col("_hf"), F.col("_ht"),
                                               F.col(hour_from), F.col(hour_to))
    staged = checked.select(*cols, "_day", reason.alias("reason"))
    url = F.when(F.col("reason").isNull(), bulletin_url(F.col("_day"), F.col(hour_from), F.col(hour_to)))
    return staged.select(*cols, "reason", url.alias("url"))


def page_plan(df: DataFrame, num_pages: str = "num_pages",
              page_size: int = K.LISTING_PAGE_SIZE) -> DataFrame:
    """One row per listing page ``1..num_pages`` with the first
    row index the service expects, ``(page - 1) * page_size``."""
    n = F.col(num_pages)
    pages = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("page", F.explode(pages))
    return (out.filter(validate.page_reason(F.col("page")).isNull())
               .withColumn("first_row", (F.col("page") - 1) * F.lit(page_size)))


def bulletin_numbers(body: Column) -> Column:
    """P5: the register numbers listed in a bulletin body (a JSON/Python list
    literal of strings; both quote styles parse).  Malformed -> null."""
    return F.from_json(body, "array<string>")


def bulletin_quarantine(bulletins: DataFrame, body: str = "body", day: str = "day") -> DataFrame:
    """Bulletins that give no or not all of their numbers: ``(day, body,
    reason)``, reason ``no_body``, ``malformed`` (not a list) or ``null_number``
    (a list with nulls).  Upstream stops at these; here the rest goes on."""
    numbers = bulletin_numbers(F.col(body))
    reason = (F.when(F.col(body).isNull(), F.lit("no_body"))
              .when(numbers.isNull(), F.lit("malformed"))
              .when(F.exists(numbers, lambda n: n.isNull()), F.lit("null_number")))
    return bulletins.select(day, body, reason.alias("reason")).filter(F.col("reason").isNotNull())


def missing_pages(parsed: DataFrame, krs: str = "krs_number", page: str = "page",
                  num_pages: str = "num_pages", ok: str = "diagnosis") -> DataFrame:
    """Known listing pages of a company that have not landed as ok:
    ``(krs_number, page)``.  Known are ``1..num_pages``, the greatest count
    that any landed page of the company shows, page 1 without a count (unless
    it says that there are no documents), and every landed page that failed.
    A listing is whole only without such rows."""
    at, said = F.col(page).cast("int"), F.coalesce(F.col(ok), F.lit(""))
    none = F.coalesce(F.max((at == 1) & (said == "no_documents")), F.lit(False))
    total = parsed.groupBy(krs).agg(
        F.greatest(F.max(F.col(num_pages).cast("int")), F.when(none, 0).otherwise(1)).alias(num_pages))
    failed = parsed.filter(~said.isin("ok", "no_documents")).select(krs, at.alias(page))
    known = page_plan(total).select(krs, page).unionAll(failed.filter(validate.page_reason(F.col(page)).isNull())).distinct()
    landed = parsed.filter(said == "ok").select(krs, at.alias(page))
    return known.join(landed, [krs, page], "left_anti")


def in_window(day: Column, as_of, n_days: int) -> Column:
    """P2 as a filter: ``day`` is one of the ``n_days`` days ending at
    ``as_of`` (a plain range predicate, so it reaches the scan)."""
    end = F.lit(as_of).cast("date")
    return (day >= F.date_sub(end, n_days - 1)) & (day <= end)


def changed_companies(bulletins: DataFrame, body: str = "body", day: str = "day",
                      as_of=None, n_days: int | None = None) -> DataFrame:
    """P5+P1+U1+A3: distinct companies named by the bulletins, zero-padded;
    with ``as_of``/``n_days`` only the bulletins of those days (P2).

    ``distinct`` aggregates partially on the map side, so a number repeated
    in a third of all bulletins is one row per map task before the shuffle."""
    if as_of is not None and n_days is not None:
        bulletins = bulletins.filter(in_window(F.col(day), as_of, n_days))
    numbers = bulletins.select(F.explode(bulletin_numbers(F.col(body))).alias("_n"))
    return (numbers.filter(F.col("_n").isNotNull())
                   .select(keys.zfill(F.col("_n")).alias("krs_number"))
                   .distinct())


def dispatch_plan(companies: DataFrame, key: str = "krs_number") -> DataFrame:
    """Each company x the two update routes.  The fixed two-row relation
    is a literal array exploded per row - a map-side step, no join."""
    routes = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("_path"))
                       for kind, path in K.DISPATCH_ROUTES])
    out = companies.select(key, F.inline(routes))
    return out.select(key, "kind",
                      F.replace(F.col("_path"), F.lit("{krs}"), F.col(key)).alias("path"))
