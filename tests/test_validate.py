"""F1-F7, F10, F13 as reason columns: the upstream rejection cases, table-driven."""

import pytest
from pyspark.sql import functions as F

from regiflow.functions import validate as V
from regiflow.plans import requests

# key, registry, expected reason (key rules first, then registry rules)
KEY_CASES = [
    ("0000057814", "P", None),
    ("abc1234567", "P", "not_digits"),
    ("12345678901", "P", "wrong_length"),
    ("0000057814", "X", "not_allowed"),
    ("0000057814", "PP", "wrong_length"),
    ("9999999999", "P", None),          # valid key; not found is a response, not a rule
    (None, "P", "not_string"),
    ("0000057814", "S", None),
    ("00000578１4", "P", "not_digits"),  # full-width digit: ASCII digits only
]


def test_company_key_and_registry(spark):
    df = spark.createDataFrame(KEY_CASES, "krs string, registry string, expected string")
    reason = F.coalesce(V.company_key_reason(F.col("krs")), V.registry_reason(F.col("registry")))
    rows = df.select(reason.alias("got"), "expected").collect()
    assert [r.got for r in rows] == [r.expected for r in rows]


def test_non_string_key_column_fails_at_plan_time(spark):
    df = spark.createDataFrame([(1234567890,)], "krs long")
    out = V.validate_company_keys(df, "krs").collect()
    assert out[0].reason == "not_string" and out[0].valid is False


@pytest.mark.parametrize("kind,expected", [("aktualny", None), ("pelny", None),
                                           ("pełny", "bad_extract_kind"), (None, "bad_extract_kind")])
def test_extract_kind(spark, kind, expected):
    df = spark.createDataFrame([(kind,)], "k string")
    assert df.select(V.extract_kind_reason(F.col("k")).alias("r")).first().r == expected


DAY_CASES = [
    ("2025-01-05", "07", "12", None),
    ("2025-1-5", "07", "12", None),
    ("2025-02-30", "07", "12", "bad_day"),
    ("25-1-5", "07", "12", "bad_day"),
    (None, "07", "12", "not_string"),
    ("2024-02-29", "07", "12", None),
    ("2025-01- 5", "07", "12", None),      # strptime accepts a space before a day digit
    ("2025-01-05", "7", "12", "hour_from_wrong_length"),
    ("2025-01-05", "ab", "12", "hour_from_not_digits"),
    ("2025-01-05", "07", "99", None),      # no range rule for hours
    ("2025-01-05", "12", "12", "hour_order"),
    ("2025-01-05", "13", "12", "hour_order"),
]


def test_day_and_hours(spark):
    df = spark.createDataFrame(DAY_CASES, "d string, hf string, ht string, expected string")
    out = requests.bulletin_request_checked(df, "d", "hf", "ht").collect()
    assert [r.reason for r in out] == [r.expected for r in out]
    ok = [r for r in out if r.reason is None]
    assert ok[0].url.endswith("/Biuletyn/2025-01-05?godzinaOd=07&godzinaDo=12")
    assert ok[1].url.endswith("/Biuletyn/2025-01-05?godzinaOd=07&godzinaDo=12")
    assert all(r.url is None for r in out if r.reason is not None)


@pytest.mark.parametrize("status,outcome", [(200, "ok"), (404, "not_found"), (500, "error"),
                                            (302, "error"), (None, "pending")])
def test_response_outcome(spark, status, outcome):
    df = spark.createDataFrame([(status,)], "s int")
    assert df.select(V.response_outcome(F.col("s")).alias("o")).first().o == outcome


def test_file_name_and_page_rules(spark):
    df = spark.createDataFrame([("bilans.xml", 1), ("error.txt", 0), ("Error.txt", 3), (None, None)],
                               "n string, p int")
    out = df.select(V.file_name_reason(F.col("n")).alias("f"), V.page_reason(F.col("p")).alias("p")).collect()
    assert [r.f for r in out] == [None, "file_error", None, "no_file_name"]
    assert [r.p for r in out] == [None, "bad_page", None, "bad_page"]


def test_split_valid(spark):
    df = spark.createDataFrame([(k,) for k, _, _ in KEY_CASES], "krs string")
    checked = V.validate_company_keys(df, "krs")
    good, bad = V.split_valid(checked)
    assert good.count() + bad.count() == len(KEY_CASES)
    assert {r.reason for r in bad.collect()} == {"not_digits", "wrong_length", "not_string"}
