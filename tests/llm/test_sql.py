"""Registered queries of this subpackage: SQL where there is some, README."""

import os

import pytest

from compare import digest, duck
from conftest import ROOT, SF_SMALL
from regiflow.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toArrow()
    want = duck(SF_SMALL).sql(SQL[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert digest(got.to_pandas()) == digest(want.to_pandas())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_its_whole_table(spark, name):
    table = "pages" if name.startswith("op9_") else "documents"
    rows = QUERIES[name](spark, SF_SMALL)
    ids = "page_id" if table == "pages" else "doc_id"
    whole = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
    assert rows.select(ids).distinct().count() == whole.count()


def test_readme_lists_every_query():
    with open(os.path.join(ROOT, "README.md")) as f:
        readme = f.read()
    assert [k for k in [*QUERIES, "pipeline"] if f"`{k}`" not in readme] == []
