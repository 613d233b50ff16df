"""Unicode NFKD in built-in functions.

Python's ``unicodedata`` gives the tables when the module is loaded; in the
plan they are constants that are folded once.  A code point's entry is found
by two array look-ups (its block of 256, then its place in it), so a character
costs the same whatever the size of the tables.

1. The different characters of a text that come apart are found; Hangul
   syllables are decomposed by arithmetic, others by table.
2. Where they are few, as in texts of one alphabet, each is replaced in one
   pass over the text.  Where they are many, the text is cut into runs of other
   characters, which stay, and single ones.
3. Where marks stand side by side they are put into canonical order: by
   combining class, those of one class as they stood.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
_FEW = 64                               # characters that are replaced one after the other
_SEPARATOR = "\x01"                    # in no decomposition
# Hangul by rule: first syllable and the first letters, vowels and tails with their numbers.
_SYLLABLES, _LEADS, _VOWELS, _TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _two_level(values: dict[int, str]) -> tuple[list[int], list[str]]:
    """Number of each block (0: nothing in it) and the blocks' entries."""
    blocks = sorted({c // _BLOCK for c in values})
    number = [0] * (blocks[-1] + 2)                              # the last one is for all further code points
    entries = [""] * _BLOCK
    for n, block in enumerate(blocks, 1):
        number[block] = n
        entries += [values.get(block * _BLOCK + k, "") for k in range(_BLOCK)]
    return number, entries


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@lru_cache(maxsize=1)
def _tables() -> tuple[tuple, tuple, str]:
    """Decompositions, combining classes, and the marks as a class."""
    points = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    syllables = range(_SYLLABLES, _SYLLABLES + _LEADS[1] * _VOWELS[1] * _TAILS[1])
    apart = {c: d for c in points if c not in syllables and (d := unicodedata.normalize("NFKD", chr(c))) != chr(c)}
    classes = {c: n for c in points if (n := unicodedata.combining(chr(c)))}
    return _two_level(apart), _two_level({c: str(n) for c, n in classes.items()}), _ranges(sorted(classes))


def _entry(table: tuple[list[int], list[str]], point: Column) -> Column:
    """The entry of a code point, empty where it has none."""
    number, entries = table
    blocks = F.split(F.lit(",".join(map(str, number))), ",").cast("array<int>")
    block = F.element_at(blocks, F.least(F.shiftright(point, 8), F.lit(len(number) - 1)) + 1)
    return F.element_at(F.split(F.lit(_SEPARATOR.join(entries)), _SEPARATOR), block * _BLOCK + point.bitwiseAND(0xFF) + 1)


def _letter(first: tuple[int, int], n: Column, none: bool = False) -> Column:
    letters = [chr(first[0] + k) for k in range(first[1])]
    if none:
        letters[0] = ""                 # no tail
    return F.element_at(F.split(F.lit(_SEPARATOR.join(letters)), _SEPARATOR), n.cast("int") + 1)


def _decomposed(piece: Column) -> Column:
    """One character taken apart; a piece that starts with ASCII stays."""
    point = F.ascii(piece)
    s = point - _SYLLABLES
    per_lead = _VOWELS[1] * _TAILS[1]
    hangul = F.concat(_letter(_LEADS, F.floor(s / per_lead)), _letter(_VOWELS, F.floor(s % per_lead / _TAILS[1])),
                      _letter(_TAILS, s % _TAILS[1], none=True))
    found = _entry(_tables()[0], point)
    return (F.when(point < 0x80, piece)
            .when((s >= 0) & (s < _LEADS[1] * per_lead), hangul)
            .when(found == "", piece).otherwise(found))


def _ordered(text: Column) -> Column:
    """Marks in canonical order."""
    _, classes, marks = _tables()

    def run(piece: Column) -> Column:
        chars = F.filter(F.split(piece, ""), lambda c: c != "")
        keyed = F.transform(chars, lambda c, i: F.struct(_entry(classes, F.ascii(c)).cast("int").alias("order"), i.alias("i"), c.alias("c")))
        return F.when(piece.rlike(f"^[{marks}]{{2}}"), F.array_join(F.transform(F.array_sort(keyed), lambda k: k["c"]), "")).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"[{marks}]+|[^{marks}]+"), F.lit(0))
    # A quick look first: every such mark has a mark's category, or none yet that the JVM knows.
    ordered = F.when(text.rlike(f"[{marks}]{{2}}"), F.array_join(F.transform(pieces, run), "")).otherwise(text)
    return F.when(text.rlike(r"[\p{M}\p{Cn}]{2}"), ordered).otherwise(text)


def _apart(text: Column) -> Column:
    def by(found: Column) -> Column:
        one_by_one = F.aggregate(found, text, lambda t, c: F.replace(t, c, _decomposed(c)))
        pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
        return F.when(F.size(found) <= _FEW, one_by_one).otherwise(F.array_join(F.transform(pieces, _decomposed), ""))

    wide = F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), ""))
    return _once(F.filter(wide, lambda c: (c != "") & (_decomposed(c) != c)), by)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def nfkd(text: Column) -> Column:
    """Unicode NFKD of a text column (null stays null)."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_once(_apart(text), _ordered))
