"""Block naming against grouping by the text itself."""

import hashlib

import pytest

from conftest import SF_CHECK
from regiflow.llm import exact_dedup


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(exact_dedup.exact_duplicates(spark, docs)) == brute(rows)


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_block_borders_nulls_and_repeats(spark, block):
    texts = [None, "", "a", "ab", "abc", "abcd", "abcde", "abcdabcd", "abcdabcda", "abcdabcdabcd", "äöü", "äö", "ab\n", "AB",
             "abcdabcdabcdabcdabcd", "\0", "\0\0"]
    rows = [(i * 7 % 31, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[::2])]
    rows += [(100, None), (None, "solo"), (None, "ab"), (3, "twice"), (3, "twice"), (None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, name string, row int")
    assert result(exact_dedup.exact_duplicates(spark, df, block_bytes=block)) == brute(rows)


def test_long_texts_that_differ_at_the_end(spark):
    long = "lorem ipsum " * 100_000
    rows = [(1, long), (2, long), (3, long + "x"), (4, "x" + long), (5, long[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(exact_dedup.exact_duplicates(spark, df)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert result(exact_dedup.exact_duplicates(spark, df)) == []


def test_one_block_over_many_partitions(spark):
    rows = [(i, "same text") for i in range(3000)] + [(9000 + i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(exact_dedup.exact_duplicates(spark, df)) == brute(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_two_blocks_of_one_hash_at_a_border(spark, bits):
    """A hash of few bits: every border has blocks of one hash on both sides."""
    rows = [(d, f"text {d % 170}" + "x" * (d % 3 * 9)) for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, texts, names = exact_dedup.identities(spark, df, block_bytes=8, hash_bits=bits).collect(), dict(rows), {}
        for r in found:
            names.setdefault((r.level, r.name), set()).add(texts[r.doc_id])
        assert len(found) == len(rows) and sorted(map(len, names.values())) == [1] * len(set(texts.values()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_block_over_many_partitions_keeps_one_name(spark):
    rows = [(d, "the same block of text" if d % 3 else f"text {d}") for d in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(exact_dedup.exact_duplicates(spark, df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
