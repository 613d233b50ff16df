"""The registered queries: each operator over its whole table, with its
production parameters, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, exact_dedup, html_text, lexical_search, licenses, packing, quality_model, quality_rules,
               repeated_phrases, secret_scan, simhash, structure_repair)
from .common import materialize
from .repair_sql import REPAIR

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The conversation that shows that control strings in texts survive: -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _documents(spark, sf_dir), shingle_words=3, max_distance=2)


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_documents(spark, sf_dir))


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(spark, _documents(spark, sf_dir))


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.counts(_documents(spark, sf_dir).select("doc_id", "text"))
    counted = materialize(spark, counted.withColumn("doc", F.struct("doc.doc_id")), "quality-counts")
    out = quality_rules.judged(counted, quality_rules.fit(counted))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "p_sound")


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), TOKENIZER)


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.digests(chat.format_examples(turns.unionAll(control)))


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.graded(docs, quality_model.fit(docs, labels, grade_of_labels(), grades=3), select=2)


def grade_of_labels():
    """0 to 2: a point for sound text and a point for text that is not toxic."""
    return F.col("quality") + 1 - F.col("toxic")


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _documents(spark, sf_dir), TOKENIZER, capacity=2048)


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, _documents(spark, sf_dir))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=20)


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows, found = structure_repair.repair(spark, structure_repair.damaged(turns))
    return structure_repair.digests(turns, rows, found)


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.digests(repeated_phrases.without_repeats(spark, _documents(spark, sf_dir), window=20))


QUERIES = {
    "op1_simhash_near_dedup": q_op1,
    "op2_license_scan": q_op2,
    "op3_secret_scan": q_op3,
    "op4_quality_rules": q_op4,
    "op5_bpe_round_trip": q_op5,
    "op6_chat_formatting": q_op6,
    "op7_quality_classifier": q_op7,
    "op8_best_fit_packing": q_op8,
    "op9_html_extraction": q_op9,
    "op10_exact_dedup": q_op10,
    "op11_ranked_lexical_search": q_op11,
    "op12_structure_repair": q_op12,
    "op13_substring_dedup": q_op13,
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    # An example is the conversation up to an assistant turn (or to its end): its length is a running sum of rendered turns,
    # each 10 characters of markers around role and text with a backslash behind every one of \\ < [ ].
    "op6_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
        rendered AS (
            SELECT *, 10 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\\\<\\[\\]]', '', 'g')) AS size FROM turns),
        placed AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                   sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS shown
            FROM rendered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(shown) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_ranked_lexical_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
        stats AS (SELECT count(*) FILTER (len(terms) > 0) AS documents, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM docs),
        counts AS (SELECT k, doc_id, len(terms) AS n, term, count(*) AS tf FROM docs, unnest(terms) t(term) GROUP BY ALL),
        wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                    FROM counts, stats GROUP BY term, documents),
        scored AS (
            SELECT item_id, doc_id, k, CAST(sum(repeats * w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * documents // all_terms))))
                                            AS BIGINT) AS score
            FROM counts JOIN wanted USING (term) JOIN weights USING (term), stats GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20""",
    "op12_structure_repair": REPAIR,
    "op13_substring_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT k, doc_id, i, list_slice(words, i, i + 19) AS w FROM docs, unnest(range(1, len(words) - 18)) t(i)),
        later AS (SELECT k, i FROM starts QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, k, i) > 1),
        gone AS (SELECT DISTINCT k, i + j AS i FROM later, range(0, 20) t(j)),
        words AS (SELECT k, i, words[i] AS word FROM docs, unnest(range(1, len(words) + 1)) t(i)),
        kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (k)""",
}
