"""The pipeline's rows against a brute-force version of every stage."""

import corpus_pipeline
from conftest import SF_SMALL
from llm.test_packing import check_sequences, want_pieces
from llm.test_quality_rules import brute_counts, brute_em
from llm.test_secret_scan import brute_redact
from llm.test_simhash import brute_components, brute_fingerprint
from pyspark.sql import functions as F
from regiflow.llm import quality_rules as qr


def brute_stages(spark, docs):
    """The documents after each stage, as lists of (doc_id, text)."""
    counted = qr.counts(docs)
    votes = counted.select("doc.doc_id", "doc.text", *(r.vote().alias(f"v{j}") for j, r in enumerate(qr.RULES))).collect()
    p = brute_em([list(r[2:]) for r in votes])
    rows = []
    for r, q in zip(votes, p):
        c = brute_counts(r.text)
        if not (c[0] < 10 or 100 * c[4] > 20 * c[0]) and q >= 0.5:
            rows.append((r.doc_id, r.text or ""))
    out = [rows]
    last = {}
    for d, t in sorted(rows):
        last[t] = d
    rows = [(d, t) for d, t in rows if last[t] == d]
    out.append(rows)
    comp = brute_components([d for d, _ in rows], [brute_fingerprint(t) for _, t in rows], 2)
    rows = [(d, t) for (d, t), c in zip(rows, comp) if d == c]
    out.append(rows)
    rows = [(d, brute_redact(t)) for d, t in rows]
    out.append(rows)
    return out


def test_every_stage_and_the_result(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute_stages(spark, docs)
    assert len(want[0]) > len(want[1]) >= len(want[2]) > 0
    from regiflow.llm.common import materialize
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, SF_SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        docs = materialize(spark, out, "test-stage")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
        assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == want_pieces(want[-1])
    check_sequences(got)


def test_stages_with_nulls_repeats_extra_columns_and_no_rows(spark, tmp_root):
    sound = "here is a clean sentence with enough ordinary words, and then one more for good measure. password=abcdef1"
    rows = [(1, sound, "en", "a", 3, 1), (1, sound, "en", "b", 3, 2), (None, sound + " x", None, None, None, None), (2, None, "en", "c", 0, 4),
            (3, sound, "en", "d", 3, 5), (None, "another null id but with other words entirely, as long as it has to be here.", "en", "e", 1, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int"
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            path = f"{tmp_root}/{name}-{len(table)}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(table)
