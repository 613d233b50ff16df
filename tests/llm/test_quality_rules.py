"""Counts against plain Python, EM against a row-wise version, verdicts
against the labels."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_CHECK
from regiflow.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_em(votes, rounds=100):
    """The same model, one row at a time."""
    v = np.array(votes)
    n, rules = v.shape
    up, down = v > 0, v < 0
    strength = max(1.0, 0.02 * n)
    pi, s, j = 0.9, np.array([[0.6, 0.02]] * rules), np.array([[0.1, 0.3]] * rules)

    def posterior():
        odds = math.log(pi / (1 - pi)) + up @ np.maximum(0, np.log(s[:, 0] / j[:, 0])) + down @ np.minimum(0, np.log(s[:, 1] / j[:, 1]))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p = posterior()
        pi = (0.9 * strength + p.sum()) / (n + strength)
        s = np.stack([0.6 * strength + p @ up, 0.02 * strength + p @ down], axis=1) / (strength + p.sum())
        j = np.stack([0.1 * strength + (1 - p) @ up, 0.3 * strength + (1 - p) @ down], axis=1) / (strength + (1 - p).sum())
    return posterior()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    counted = qr.counts(docs.select("doc_id", "text"))
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(qr.RULES)]
    out = qr.judged(counted, qr.fit(counted)).select("doc.doc_id", "doc.text", "p_sound", "kept", "base_failed", *FIELDS, *votes)
    rows = out.collect()
    for r in rows:
        want = brute_counts(r.text)
        assert tuple(r[f] for f in FIELDS) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    p = brute_em([[r[f"v{j}"] for j in range(len(qr.RULES))] for r in rows])
    assert np.allclose(p, [r.p_sound for r in rows], atol=1e-6)
    assert all(r.kept == (not r.base_failed and r.p_sound >= 0.5) for r in rows)


def test_labels_agree(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    counted = qr.counts(docs.select("doc_id", "text"))
    rows = qr.judged(counted, qr.fit(counted)).select("doc.doc_id", "kept", "base_failed").collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r for r in rows if labels.get(r.doc_id) == 0]
    assert good and all(r.kept for r in good)
    assert poor and sum(not r.kept for r in poor) >= 0.95 * len(poor)


def counts_of(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    return {r.doc_id: tuple(r[f] for f in FIELDS) for r in qr.counts(df).select("doc.doc_id", *FIELDS).collect()}


def test_edge_texts(spark):
    texts = [None, "", " \n\t\x0b", "a", "a b c d e a b c d e", "x x x x x x", "x x x x x", "a\nb\na\n a\n\n\n", "#*$%&|<>    x",
             "äöü ß 漢字 \U0001f600", "w " * 20_000, " ".join(f"w{i}" for i in range(20_000)) * 2, "a b c d e f a b c d e x b c d e f"]
    assert counts_of(spark, texts) == {i: brute_counts(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet="ab \n#", max_size=80), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    assert counts_of(spark, texts) == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_stage_keeps_columns_and_rows(spark):
    sound = "this is a plain sentence with some ordinary words in it. " * 1 + "another one follows here, short and clean."
    rows = [(1, sound, 5, "x"), (1, sound, 5, "x"), (None, sound, None, None), (2, None, 0, "y"), (3, "### $$$ " * 50, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `kept.doc` string")
    out = qr.keep_sound(spark, df)
    assert out.schema == df.schema
    assert sorted([tuple(r) for r in out.collect()], key=str) == sorted(rows[:3], key=str)
    assert qr.keep_sound(spark, df.limit(0)).count() == 0


def test_estimates_find_how_often_rules_vote():
    rng = np.random.default_rng(1)
    sound = rng.random(6000) < 0.7
    on_sound, on_junk = (0.5, 0.05), (0.05, 0.6)
    r = rng.random((6000, 4))
    p_up = np.where(sound, on_sound[0], on_junk[0])[:, None]
    p_down = np.where(sound, on_sound[1], on_junk[1])[:, None]
    votes = np.where(r < p_up, 1, np.where(r < p_up + p_down, -1, 0))
    table = {}
    for v in map(tuple, votes.tolist()):
        table[v] = table.get(v, 0) + 1
    model = qr.estimate(table, 4)
    assert all(a > 0.3 and d < 0.15 for a, d in model.on_sound) and all(a < 0.15 and d > 0.4 for a, d in model.on_junk)
    found = np.array([model.log_odds(tuple(v)) >= 0 for v in votes.tolist()])
    assert (found == sound).mean() > 0.9
    assert qr.estimate({}, 4) == qr.VoteModel(0.9, ((0.6, 0.02),) * 4, ((0.1, 0.3),) * 4)
