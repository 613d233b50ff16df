"""Licence findings against trying every window."""

import random

from conftest import SF_CHECK
from regiflow.llm import licenses as lic

KNOWN = lic.compiled(lic.NOTICES)          # the brute force tries every window; whole texts have tests of their own
ALL = lic.compiled()


def brute_names(text):
    """Names of the templates that some window of words matches."""
    grams = lic.bigrams(lic.words_of(text))
    out = set()
    for t in KNOWN:
        for a in range(len(grams)):
            for size in range(t.least, min(t.most, len(grams) - a) + 1):
                if t.dice(grams[a:a + size]) >= lic.THRESHOLD:
                    out.add(t.license)
                    break
            if t.license in out:
                break
    return out


def names(text):
    return {f[2] for f in lic.findings(text, KNOWN)}


def test_templates_find_themselves_and_only_their_licence():
    for name, text in lic.TEMPLATES:
        found = lic.findings(text, ALL)
        assert [f[2] for f in found] == [name] and found[0][4] == 1.0, name


def test_embedded_wrapped_and_edited():
    apache = lic.TEMPLATES[1][1]
    words = ("lorem ipsum dolor sit amet " * 40).strip()
    wrapped = "\n".join("// " + line.strip() for line in apache.split("\n"))
    assert names(f"{words}. {apache} {words}") == {"Apache-2.0"}
    assert names(f"{words}\n{wrapped}\n{words}") == {"Apache-2.0"}
    edited = apache.replace("software", "program").replace("governing", "about")
    assert names(edited) == {"Apache-2.0"}
    half = " ".join(apache.split()[8:35])
    assert names(half) == set()
    assert names("the license of the software is not stated here") == set()


def test_positions_and_repeats():
    mit = lic.TEMPLATES[3][1]
    text = f"Äußerung İ. {mit} {mit}\n{mit} end"
    found = lic.findings(text, KNOWN)
    assert [text[s:e] for s, e, *_ in found] == [mit[:-1]] * 3


def test_bounds_prune_no_match():
    rng = random.Random(3)
    filler = "with this work and under public terms of a the file".split()
    for _ in range(150):
        t = rng.choice(KNOWN)
        words = list(t.words)
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            i = rng.randrange(len(words))
            words[i:i + rng.randint(0, 1)] = rng.choices(filler, k=rng.randint(0, 1))
        text = " ".join(rng.choices(filler, k=rng.randint(0, 8)) + words + rng.choices(filler, k=rng.randint(0, 8)))
        mine = {f[2] for f in lic.findings(text, KNOWN)}
        grams = lic.bigrams(lic.words_of(" ".join(words)))
        exact = t.least <= len(grams) <= t.most and t.dice(grams) >= 0.9     # clear of the fillers' share
        if exact:
            assert mine, text
        assert mine <= brute_names(text), text


GPL = "Licensed under the GNU General Public License, version 3, and distributed under the terms below."


def test_shortened_notice_beside_common_words():
    assert names(GPL) == {"GPL-3.0"}
    filler = "and of the work in the file under the terms of a list for the use of the copyright holder by the public"
    mit = lic.TEMPLATES[4][1].split()
    for cut in (slice(0, -10), slice(9, None)):
        assert names(f"{filler} {' '.join(mit[cut])} {filler}") == {"MIT"}
    assert names(f"{GPL} {GPL} Licensed under the MIT License. {GPL}") == {"GPL-3.0", "MIT"}


def test_every_name_of_the_brute_force():
    """Each template alone; with all of them, a name may only be missing where a longer or closer finding overlaps."""
    rng = random.Random(5)
    filler = "with this work and under the public of the terms of a the file in the software under the".split()
    matched = 0
    for _ in range(120):
        t = rng.choice(KNOWN)
        words = list(t.words)
        for _ in range(rng.randint(0, 2 + len(words) // 5)):
            i = rng.randrange(len(words)) if words else 0
            words[i:i + rng.randint(0, 2)] = rng.choices(filler, k=rng.randint(0, 2))
        text = " ".join(rng.choices(filler, k=rng.randint(0, 30)) + words + rng.choices(filler, k=rng.randint(0, 30)))
        grams = lic.bigrams(lic.words_of(text))
        found = lic.findings(text, KNOWN)
        for t in KNOWN:
            scores = [(t.dice(grams[a:a + n]), a, n) for a in range(len(grams)) for n in range(t.least, min(t.most, len(grams) - a) + 1)]
            best = max(scores, default=(0, 0, 0))
            alone = lic.findings(text, [t])
            assert bool(alone) == (best[0] >= lic.THRESHOLD - 1e-9), (t.license, text)
            if alone:
                matched += 1
                assert abs(max(f[4] for f in alone) - best[0]) < 1e-9
                assert t.license in {f[2] for f in found} or any(f[0] < alone[0][1] and alone[0][0] < f[1] for f in found), text
    assert matched > 60


def test_whole_texts_edited_and_side_by_side():
    """A whole text stays one finding of its licence when words of it are
    changed, wrapped or left out; a closest window by brute force agrees."""
    rng = random.Random(9)
    filler = "lorem ipsum dolor sit amet".split()
    for t in ALL[len(lic.NOTICES):]:
        words = list(t.words)
        for _ in range(len(words) // 30):
            words[rng.randrange(len(words))] = rng.choice(filler)
        text = " ".join(filler * 9 + words[:len(words) // 2]) + "\n * " + "\n * ".join(words[len(words) // 2:]) + " " + " ".join(filler * 9)
        found = [f for f in lic.findings(text, ALL) if f[4] >= 0.8]
        assert t.license in {f[2] for f in found}
        grams = lic.bigrams(lic.words_of(text))
        best = max(t.dice(grams[a:a + n]) for a in range(35, 55) for n in range(len(words) - 20, len(words) + 20))
        alone = lic.findings(text, [t])
        assert len(alone) == 1 and alone[0][4] >= best - 1e-9
    both = " ".join(filler * 9).join([lic.FULL_TEXTS[0][1], lic.FULL_TEXTS[5][1], lic.FULL_TEXTS[1][1]])
    assert [f[2] for f in lic.findings(both, ALL)] == ["MIT", "Zlib", "BSD-2-Clause"]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = {r.doc_id: set(r.licenses) for r in lic.scanned(docs).collect()}
    lines = {lic.TEMPLATES[i][1]: lic.TEMPLATES[i][0] for i in (0, 3, 6, 9 - 1)}
    for r in docs.collect():
        want = {lines[line] for line in r.text.split("\n") if line in lines}
        assert got[r.doc_id] >= want
        if "licen" not in r.text.lower():
            assert not got[r.doc_id]
    assert any(got.values())


def test_null_empty_and_repeated_rows(spark):
    mit = lic.TEMPLATES[3][1]
    rows = [(1, None, 0), (None, mit, 1), (2, "", 2), (3, mit, 3), (3, mit, 3), (4, "x " * 100_000 + mit, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings int")
    got = sorted([(r.doc_id, r.n_findings, tuple(r.licenses)) for r in lic.scanned(df).collect()], key=str)
    assert got == sorted([(d, int(bool(t)), ("MIT",) if t else ()) for d, t, _ in rows], key=str)
    assert lic.scanned(df.limit(0)).count() == 0
