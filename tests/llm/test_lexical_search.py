"""Ranked lexical search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import pytest

from conftest import SF_SMALL
from regiflow.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=20):
    own = [(d, brute_terms(t)) for d, t in docs]
    own = [(d, Counter(t), len(t)) for d, t in own if t]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in brute_terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, **more):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in ls.search(spark, docs, items, **more).collect()], key=str)


@pytest.mark.parametrize("blocks", [{}, {"block_items": 7}, {"block_bytes": 500}])
def test_whole_table(spark, blocks):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 100 and result(spark, docs, items, **blocks) == want


def test_terms_are_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x2000), 0x1F600])) for _ in range(40))
        assert [t.decode() for t in ls.terms(text.encode())] == brute_terms(text)


def test_ties_copies_nulls_and_clashing_columns(spark):
    rng = random.Random(2)
    docs = [(d, "red red blue") for d in range(200, 100, -1)] + [(d, f"red blue n{d}") for d in range(40)] + [
        (None, "red red blue"), (None, None), (7, ""), (8, "..."), (300, "RED-red,Blue"), (300, "RED-red,Blue"), (301, "Été été É"),
        (302, "grün"), (303, "x" * 50_000 + " red " * 30_000)]
    rng.shuffle(docs)
    items = [(1, "red blue"), (1, "red blue"), (2, None), (3, "nothing here"), (None, "Été É"), (5, "blue blue blue red"), (6, "n3 n4 n5")]
    df = spark.createDataFrame([(d, t, 1, "a", b"b", 2) for d, t in docs], "doc_id long, text string, m int, hash string, bag binary, item int")
    its = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    assert result(spark, df, its) == brute(docs, items)
    assert result(spark, df.repartition(5), its, top=3) == brute(docs, items, 3)


def test_one_text_that_a_third_of_the_rows_hold(spark):
    docs = [(d, "common words of all") for d in range(3000, 0, -1)] + [(d, f"common words w{d % 50} of {d}") for d in range(3001, 9001)]
    items = [(0, "common words"), (1, "all of w7")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert result(spark, df, spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert result(spark, docs, items.limit(0)) == []
    assert result(spark, docs.limit(0), items) == []
    assert result(spark, docs.withColumn("text", __import__("pyspark").sql.functions.lit(None).cast("string")), items) == []
