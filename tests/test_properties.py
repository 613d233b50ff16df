"""Properties against plain-Python models of the upstream behaviour.

One Spark job per example (each example is a whole batch of inputs), few
examples, no deadline.
"""

import ast
import datetime as dt
import hashlib
import json
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiflow.functions import keys, validate
from regiflow.operators import versions
from regiflow.plans import requests

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

KEYISH = st.text(alphabet="0123456789+-ab ", max_size=14)


@SETTINGS
@given(st.lists(KEYISH, min_size=1, max_size=40))
def test_zfill_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k string")
    got = [r.z for r in df.select(keys.zfill(F.col("k")).alias("z")).collect()]
    assert got == [v.zfill(10) for v in values]


TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF)
               | st.sampled_from(["\xa0", "ﬁ", "ł", "ż", "Å", " ", "\t", " "]), max_size=30)


@SETTINGS
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=30))
def test_document_key_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.h for r in df.select(keys.document_key(F.col("a"), F.col("b"), F.lit(""), F.lit(""),
                                                    F.lit("")).alias("h")).collect()]
    want = [hashlib.sha256(unicodedata.normalize("NFKD", a + b).strip().lower().replace("\xa0", " ")
                           .encode()).hexdigest() for a, b in pairs]
    assert got == want


DAYISH = st.builds(lambda y, m, d, sep: f"{y}{sep}{m}{sep}{d}",
                   st.text(alphabet="0123456789", min_size=2, max_size=5),
                   st.text(alphabet="0123456789 ", min_size=1, max_size=3),
                   st.text(alphabet="0123456789 ", min_size=1, max_size=3),
                   st.sampled_from(["-", "-", "/"]))


def python_day_ok(s):
    try:
        dt.datetime.strptime(s, "%Y-%m-%d")
        return True
    except ValueError:
        return False


@SETTINGS
@given(st.lists(DAYISH, min_size=1, max_size=60))
def test_day_rule_matches_strptime(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [r.r is None for r in df.select(validate.day_reason(F.col("d")).alias("r")).collect()]
    assert got == [python_day_ok(d) for d in days]


ROWS = st.lists(st.tuples(st.sampled_from("ABCD"), st.integers(0, 3)), min_size=1, max_size=40)


@SETTINGS
@given(ROWS)
def test_current_flag_matches_brute_force(spark, rows):
    t0 = dt.datetime(2025, 1, 1)
    data = [(i, k, t0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k string, ts timestamp_ntz")
    got = {r.id: r.is_current for r in versions.mark_current(df, "k", ["ts", "id"]).collect()}
    best = {}
    for i, k, ts in data:
        if k not in best or (ts, i) > best[k]:
            best[k] = (ts, i)
    assert got == {i: (ts, i) == best[k] for i, k, ts in data}
    assert sum(got.values()) == len(best)


RESP = st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("PS"), st.sampled_from([200, 404, 500]),
                          st.integers(0, 5)), max_size=20)


def walk(company, responses):
    for reg in "PS":
        mine = [(ts, i, status) for i, (c, r, status, ts) in enumerate(responses) if c == company and r == reg]
        if not mine:
            return reg, None, "pending"
        status = max(mine)[2]
        if status == 404:
            continue
        return reg, status, "ok" if status == 200 else "error"
    return None, None, "not_found"


@SETTINGS
@given(RESP)
def test_first_found_matches_walk(spark, responses):
    t0 = dt.datetime(2025, 1, 1)
    data = [(c, r, s, t0 + dt.timedelta(minutes=ts), i) for i, (c, r, s, ts) in enumerate(responses)]
    resp = spark.createDataFrame(data, "krs_number string, registry string, status_code int, ts timestamp_ntz, "
                                       "response_id long")
    comp = spark.createDataFrame([(c,) for c in "ABC"], "krs_number string")
    got = {r.krs_number: (r.registry, r.status_code, r.outcome)
           for r in versions.first_found(comp, resp).collect()}
    assert got == {c: walk(c, responses) for c in "ABC"}


BODY = st.one_of(
    st.lists(st.text(alphabet="0123456789", min_size=1, max_size=12), max_size=5).map(json.dumps),
    st.lists(st.text(alphabet="0123456789", min_size=1, max_size=12), max_size=5).map(
        lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"),
    st.sampled_from(["", "[", "not a list", "{}"]),
)


def python_changed(bodies):
    out = set()
    for b in bodies:
        try:
            xs = ast.literal_eval(b)
        except (ValueError, SyntaxError):
            continue
        if isinstance(xs, list):
            out.update(x.zfill(10) for x in xs)
    return out


@SETTINGS
@given(st.lists(BODY, min_size=1, max_size=20))
def test_changed_companies_match_literal_eval(spark, bodies):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), b) for b in bodies], "day date, body string")
    got = {r.krs_number for r in requests.changed_companies(df).collect()}
    assert got == python_changed(bodies)


@SETTINGS
@given(ROWS, st.integers(0, 40))
def test_refresh_current_equals_full(spark, rows, cut):
    t0 = dt.datetime(2025, 1, 1)
    data = [(i, k, t0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate(rows)]
    schema = "id long, k string, ts timestamp_ntz"
    old, new = data[:cut], data[cut:]
    snap = versions.current_rows(spark.createDataFrame(old, schema), "k", ["ts", "id"])
    got = versions.refresh_current(snap, spark.createDataFrame(new, schema), "k", ["ts", "id"])
    full = versions.current_rows(spark.createDataFrame(data, schema), "k", ["ts", "id"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in full.collect())


INCOMING = st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 50)), max_size=30)


@SETTINGS
@given(INCOMING, st.sets(st.sampled_from("abcdef")))
def test_insert_if_absent_matches_model(spark, incoming, stored):
    from regiflow.operators import documents

    inc = spark.createDataFrame(incoming, "hash_id string, doc_id long")
    existing = spark.createDataFrame([(h,) for h in sorted(stored)], "hash_id string")
    got = {(r.hash_id, r.doc_id) for r in documents.insert_if_absent(inc, existing, "hash_id", ["doc_id"]).collect()}
    firsts = {}
    for h, i in incoming:
        firsts[h] = min(i, firsts.get(h, i))
    assert got == {(h, i) for h, i in firsts.items() if h not in stored}
    # appending what was inserted and running again inserts nothing
    after = existing.unionByName(spark.createDataFrame(sorted(got), "hash_id string, doc_id long").select("hash_id"))
    assert documents.insert_if_absent(inc, after, "hash_id", ["doc_id"]).count() == 0


LISTING = st.lists(st.tuples(st.sampled_from("KL"), st.integers(1, 4), st.integers(1, 10)), max_size=30, unique=True)


@SETTINGS
@given(LISTING, st.sets(st.integers(0, 29)))
def test_next_pending_matches_model(spark, listing, stored_idx):
    from regiflow.operators import documents

    rows = [(k, p, pos, f"h{i}") for i, (k, p, pos) in enumerate(listing)]
    stored = sorted({f"h{i}" for i in stored_idx})
    lst = spark.createDataFrame(rows, "krs_number string, page int, position int, hash_id string")
    st_df = spark.createDataFrame([(h,) for h in stored], "hash_id string")
    got = {r.krs_number: r.hash_id for r in documents.next_pending(documents.pending_work(lst, st_df)).collect()}
    want = {}
    for k, p, pos, h in sorted(rows, key=lambda r: ((r[1] - 1) * 10 + r[2], r[3])):
        if h not in stored and k not in want:
            want[k] = h
    assert got == want
