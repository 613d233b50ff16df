"""Substring dedup against a brute-force removal."""

import hashlib
import random
import re

import numpy as np
import pytest

from conftest import SF_SMALL
from regiflow.llm import repeated_phrases as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """Sorted ``(doc_id, n_words, n_removed, sha of what stays)``; rows in
    the table's order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        words = WORD.findall(rows[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((rows[i][0], len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, df, **more):
    return sorted(map(tuple, rp.digests(rp.without_repeats(spark, df, **more)).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "a") for d, t in rows], "doc_id long, text string, row int, owner int, tag string").coalesce(1)


@pytest.mark.parametrize("shard_words", [rp.SHARD_WORDS, 3000])
def test_whole_table(spark, shard_words):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n for _, _, n, _ in want) > 1000
    assert result(spark, docs, shard_words=shard_words) == want


def passages(rng, n, length):
    return [" ".join(f"p{rng.randrange(50)}" for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("window, phrase, shard_words", [(20, 5, 200_000), (20, 5, 400), (6, 3, 60), (3, 3, 40), (5, 1, 100)])
def test_random_texts(spark, window, phrase, shard_words):
    rng = random.Random(window * 31 + phrase)
    parts = passages(rng, 6, 9) + passages(rng, 4, 26) + passages(rng, 2, 70)
    rows = []
    for d in range(60):
        text = " ".join(rng.choice([rng.choice(parts), f"u{d} v{rng.randrange(9)}", "\t\n", "a a a a a a a a"]) for _ in range(rng.randrange(9)))
        rows.append((rng.choice([d, d, d, 7, None]), text))
    rows += rows[:15]
    rng.shuffle(rows)
    assert result(spark, frame(spark, rows), window=window, phrase_words=phrase, shard_words=shard_words) == brute(rows, window)


def test_one_notice_in_a_third_of_the_rows(spark):
    """The notice's owner has far more words than a shard holds."""
    rng = random.Random(3)
    notice = passages(rng, 1, 33)[0]
    rows = [(d, f"{' '.join(f'x{rng.randrange(4000)}' for _ in range(30))} {notice if d % 3 == 0 else ''} end of {d}") for d in range(900)]
    assert result(spark, frame(spark, rows), shard_words=2000) == brute(rows)


def test_copies_nulls_short_and_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))             # its period is longer than itself
    loop = " ".join(f"w{i % 40}" for i in range(9_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one two three"), (9, "one two three"), (2, long), (1, long), (None, long), (6, long[:5000]),
            (7, loop), (8, "lead " + loop + "\x0btail"), (10, "no break " * 25), (11, "é " * 19), (12, "é " * 20), (13, "é " * 21)]
    assert result(spark, frame(spark, rows)) == brute(rows)
    part = " ".join(long.split()[:50])
    got = {r.doc_id: r for r in rp.without_repeats(spark, frame(spark, [(1, long), (2, f"aa {part} zz"), (3, long)])).collect()}
    assert got[1].kept is None and got[1].spans == [] and got[3].kept == "" and got[3].spans is None
    assert got[2].kept == "aa zz" and [tuple(s) for s in got[2].spans] == [(1, 51)]


def test_empty_table(spark):
    assert result(spark, frame(spark, [(1, "a")]).limit(0)) == []


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in rng.integers(0, 30, 400)]
    words[300:340] = words[100:140]
    anchor, start, n = rp.anchor_runs(words, 20, 5)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(words) - 19
    of = np.repeat(anchor, n)
    assert (of[100:121] == of[300:321]).all()
    assert len(rp.anchor_runs(words[:19], 20, 5)[0]) == 0 and len(rp.anchor_runs(words[:20], 20, 5)[0]) == 1
