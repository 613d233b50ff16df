"""Structure repair against enumeration and a plain dynamic program."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from regiflow.llm import structure_repair as sr

SOUND = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows):
    """Every edit string with at most four insertions, by brute force."""
    faults, best = faults_of(rows), None
    for inserts in range(5):
        for letters in set(product("DIKR", repeat=len(rows) + inserts)):
            if letters.count("I") != inserts:
                continue
            shapes = [("", 0, 0)]                                        # initials so far, cost, next row
            for e in letters:
                grown = []
                for initials, cost, k in shapes:
                    if e == "I":
                        grown += [(initials + r, cost + 2, k) for r in "ua"]
                        continue
                    extra = (faults[k] == "truncated") if e != "D" else 0
                    if e == "D":
                        grown.append((initials, cost + 3, k + 1))
                    elif faults[k] not in ("blank", "duplicate"):
                        if e == "K":
                            grown.append((initials + rows[k][0][:1], cost + extra, k + 1))
                        else:
                            grown += [(initials + r, cost + 2 + extra, k + 1) for r in "ua"]
                shapes = grown
            for initials, cost, _ in shapes:
                if SOUND.fullmatch(initials):
                    best = min(best or (cost, letters), (cost, letters))
    return best[0], "".join(best[1])


def planned(rows):
    """(cost, audit, repaired lines) by the plain recursion over suffixes."""
    faults = faults_of(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def rest(k, state, room):
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, to, k, room):
            if to is not None and (tail := rest(k, to, room)):
                found.append((cost + tail[0], letter + tail[1], ((line,) if line is not None else ()) + tail[2]))

        if room:
            for r, name in NAMES.items():
                add(2, "I", f"{name}:", step.get((state, r)), k, room - 1)
        if k < len(rows):
            role, text = rows[k]
            add(3, "D", None, state, k + 1, 2)
            if faults[k] in (None, "truncated"):
                extra = faults[k] == "truncated"
                add(extra, "K", f"{role}:{text}", step.get((state, role[:1])), k + 1, 2)
                for r, name in NAMES.items():
                    add(2 + extra, "R", f"{name}:{text}", step.get((state, r)), k + 1, 2)
        return min(found) if found else None

    for k in range(len(rows), -1, -1):                                   # no deep recursion
        for state, room in product(["", "s", "u", "a"], range(3)):
            rest(k, state, room)
    return rest(0, "", 2)


def expected(conversations):
    """Rows of ``digests`` from {conv: [(turn, role, text)]}."""
    out = []
    for conv, rows in conversations.items():
        rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                      key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [t for known, t, _, _ in rows if known]
        plain = [(r, x) for *_, r, x in rows]
        faults = faults_of(plain)
        cost, audit, lines = planned(plain)
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(plain, plain[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, df, ids=None, **more):
    rows, found = sr.repair(spark, df, **more)
    out = sr.digests(df if ids is None else ids, rows, found)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def frame(spark, conversations):
    rows = [(c, t, r, x, 1, "k") for c, own in conversations.items() for t, r, x in own]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int, symbol string")


def random_rows(rng, n):
    texts = ["Yes.", "no", "Well, so it is!", "", " \t", "what?\n", "cut off", "ok."] + [f"say {i}." for i in range(6)]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "admin", "", None]
    return [(rng.choice([None, rng.randrange(n + 2), k]), rng.choice(roles), rng.choice([*texts, None])) for k in range(n)]


def test_the_plain_program_is_the_enumeration():
    rng = random.Random(1)
    for n in range(4):
        for _ in range(40):
            rows = [(r or " ", " " if x is None else x) for _, r, x in random_rows(rng, n)]
            assert planned(rows)[:2] == enumerated(rows)


@pytest.mark.parametrize("segment", [sr.SEGMENT, 3, 1])
def test_random_conversations(spark, segment):
    rng = random.Random(segment)
    conversations = {c: random_rows(rng, rng.randrange(1, 14)) for c in range(300)}
    conversations[None] = random_rows(rng, 9)
    conversations[500] = random_rows(rng, 120)
    assert result(spark, frame(spark, conversations), segment=segment) == expected(conversations)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def test_whole_table_damaged(spark):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    more = spark.createDataFrame([(c, t, r, x) for c in (-3, None) for t, r, x in [(None, None, "a."), (2, "user", None), (3, "assistant", "b")]]
                                 + [(-7, t, "user", "x.") for t in range(40)], turns.schema)
    rows = turns.unionAll(more)
    want = damaged([tuple(r) for r in rows.collect()])
    assert result(spark, sr.damaged(rows), rows) == expected(want)


def test_conversations_that_lose_every_row_are_listed(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(spark, sr.damaged(rows), rows) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_with_a_third_of_the_rows(spark):
    """It lies in several partitions and segments; one row in it has a
    four hundred copies, one text is said at every third turn."""
    rng = random.Random(4)
    hot = [(t, "user" if t % 2 == 0 else "assistant", f"t{t}." if t % 3 else "again!") for t in range(1200)] + [(77, "user", "same.")] * 400
    conversations = {1: hot} | {c: random_rows(rng, 8) for c in range(2, 400)}
    df = frame(spark, conversations)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        space = F.lit(" ")
        rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
        assert sr._places(spark, rows, 100).filter("conv_id = 1").select("part").distinct().count() > 1
        assert result(spark, df, segment=100) == expected(conversations)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_text_extreme_turns_and_empty_table(spark):
    conversations = {1: [(0, "user", "x" * 300_000 + " "), (1, "assistant", "y. " * 100_000)], 2: [(-2**63, "user", "a."), (2**63 - 1, "assistant", "b.")]}
    got = {r[0]: r for r in result(spark, frame(spark, conversations))}
    assert got[1] == expected({1: conversations[1]})[0]
    assert got[2][1] is None and got[2][6:8] == (0, "KK")
    assert result(spark, frame(spark, {1: [(0, "user", "a")]}).limit(0)) == []


def test_rows_are_the_conversation_as_it_should_be(spark):
    rows, found = sr.repair(spark, frame(spark, {1: [(0, "system", "Be brief."), (1, "assistant", "Hello."), (3, "user", "Why"), (4, "tool", "So.")]}))
    got = rows.orderBy("part", "seg", "k", "step").select("edit", "turn", "role", "text").collect()
    assert list(map(tuple, got)) == [("K", 0, "system", "Be brief."), ("I", None, "user", ""), ("K", 1, "assistant", "Hello."),
                                     ("K", 3, "user", "Why"), ("R", 4, "assistant", "So.")]
    assert tuple(found.first()) == (1, 1, 0, 0, 1, 2, 5, "KIKKR")


def test_rules_are_shared():
    words = ["ua" * 50, "sua" + "ua" * 40, "ua" * 30 + "x"]
    solved = list(sr.solve(words))
    rules = solved[0][0]
    assert len(rules.of_pair) < 30 and all(r is rules for r, _ in solved)
    assert [rules.edits(s, sr.START, sr.AFTER_A) for _, s in solved] == ["k" * 100, "k" * 83, "k" * 60 + "d"]
    assert [int(rules.cost[s][sr.START, sr.AFTER_A]) for _, s in solved] == [0, 0, 3]
