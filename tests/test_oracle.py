"""Every registered query equals its DuckDB SQL (row count, column names and
an order-insensitive value hash), as the driver's correctness gate checks."""

import pytest

import __spark_entry__ as E
from compare import digest, duck
from conftest import SF_CHECK, SF_SMALL
from regiflow.oracle import SQL
from regiflow.queries import QUERIES

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(SQL) == set(QUERIES)
    assert set(SQL) <= set(E.oracle_sql()) and set(QUERIES) <= set(E.queries())


def test_letters_of_the_texts_are_covered_by_the_sql():
    """The SQL's NFKD is a list of replacements for Latin letters: the texts
    hold no other character that NFKD changes."""
    import unicodedata

    import duckdb

    for sf in (SF_SMALL, SF_CHECK):
        texts = duckdb.sql(f"SELECT source || lang || text FROM '{sf}/documents.parquet'").fetchall()
        letters = set("".join(t for t, in texts))
        assert all(0xA0 <= ord(c) < 0x180 for c in letters if unicodedata.normalize("NFKD", c) != c)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toArrow()
    want = con.sql(E.oracle_sql()[name]).to_arrow_table()
    # same column names and types, then the same values
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert digest(got.to_pandas()) == digest(want.to_pandas())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "krs_number", "record_created_at", "raw_data", "is_current"]
    assert df.count() > 0


def test_document_content_keys_brute_force(spark):
    """Every document of the small table, hashed in plain Python."""
    import hashlib
    import unicodedata

    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    want = {i: hashlib.sha256(unicodedata.normalize("NFKD", s + l + t).strip().lower()
                              .replace("\xa0", " ").encode()).hexdigest() for i, s, l, t in docs}
    got = {r.doc_id: r.document_hash_id for r in E.queries()["document_content_keys"](spark, SF_SMALL).collect()}
    assert got == want
    assert len(docs) >= 200


def test_readme_lists_every_registered_query():
    import os

    readme = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    assert [k for k in QUERIES if f"`{k}`" not in readme] == []
