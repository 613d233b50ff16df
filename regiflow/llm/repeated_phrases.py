"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words.  A word goes when a window over it
has the same words as a window that starts earlier, in a document with a
smaller id or further up in the same one.

1. *Copies.*  Rows with equal words (by SHA-256) are reduced to the first by
   id; every window of the others starts earlier in it.
2. *Recurring passages.*  The windows of a document are cut into runs by their
   anchor, the least hash among a window's phrases of ``phrase_words`` words.
   Equal windows have the same anchor, so only runs whose anchor is met twice
   can hold a recurring window.  Adjacent runs whose anchors were first met in
   the same document, their owner, are one segment.
3. *Automata.*  Segments are dealt by owner, so all places of a window are in
   one shard.  A shard confirms the windows that recur, compiles them into an
   Aho-Corasick automaton (a letter per word of the shard), streams the
   segments through it and marks every place but the first.
4. *Owners with more words than a shard holds* (a notice that a third of the
   documents carry) are dealt out again by place.  Each part gives its windows
   with their counts, the counts are added up over the parts, and the
   confirmed ones go, in groups of bounded size, to every part; the segments
   are streamed through the same automata there.

Scale: texts are read once for hashes, once for segments, once for the cut;
shuffled are anchors (about one for eight words, 8-byte hashes), segments of
recurring passages, and texts that hold one.  A task holds one shard's words.
Counts are partial aggregates; nothing is collected or broadcast by hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, materialize, tagged, whole_text

WINDOW = 20
PHRASE_WORDS = 5
SHARD_WORDS = 200_000        # words of segments, or of confirmed windows, that one automaton's task holds; 400,000 at most
_RUN_WINDOWS = 4096          # windows of one segment at most
_SEGMENT = "owner long, row long, doc_id long, start int, windows int, words binary"
_FIRST_LETTER, _OTHER_WORD = 0xE000, "\x00"          # letters lie above the surrogates


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor_runs(words: list[bytes], window: int, phrase_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a document as runs ``(anchor, start, windows)``: the
    leftmost least phrase hash of every window of a run is the same phrase."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    phrase = np.zeros(len(words) - phrase_words + 1, np.uint64)
    for i in range(phrase_words):
        phrase = phrase * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(phrase)]
    phrase = _mixed(phrase)
    step = window - phrase_words + 1
    at = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):                                   # bounded scratch on very long texts
        own = np.lib.stride_tricks.sliding_window_view(phrase[lo:lo + (1 << 16) + step - 1], step)[:n - lo]
        at[lo:lo + len(own)] = own.argmin(axis=1) + np.arange(lo, lo + len(own))
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return phrase[at[start]].view(np.int64), start.astype(np.int32), np.diff(np.r_[start, n]).astype(np.int32)


def _list_of(sizes, structs: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)), structs)


def _hashed(rows: DataFrame, window: int, phrase_words: int) -> DataFrame:
    """Per row: its word count, the digest of its words and its runs."""

    def run(batches):
        for batch in batches:
            n, digest, sizes, runs = [], [], [], []
            for data in batch.column("data"):
                words = data.as_py().split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).digest())
                runs.append(anchor_runs(words, window, phrase_words))
                sizes.append(len(runs[-1][0]))
            cols = [np.concatenate(c) for c in zip(*runs)] if runs else [np.zeros(0, t) for t in ("i8", "i4", "i4")]
            structs = pa.StructArray.from_arrays([pa.array(c) for c in cols], ["anchor", "start", "windows"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tag"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _list_of(sizes, structs)],
                ["tag", "doc_id", "n_words", "digest", "runs"])

    return rows.mapInArrow(run, "tag string, doc_id long, n_words long, digest binary, "
                                "runs array<struct<anchor:long,start:int,windows:int>>")


def _segments(texts: DataFrame, window: int) -> DataFrame:
    """``texts`` with ``(row, doc_id, data, spots)``: the recurring runs, cut
    out as segments of at most ``_RUN_WINDOWS`` windows."""

    def run(batches):
        for batch in batches:
            out = []
            for row, doc, data, spots in zip(*(batch.column(c) for c in ("row", "doc_id", "data", "spots"))):
                words, row, doc = data.as_py().split(), row.as_py(), doc.as_py()
                spots = sorted((s["start"], s["windows"], s["owner"]) for s in spots.as_py())
                held: list[list[int]] = []                            # owner, start, windows
                for start, n, owner in spots:
                    last = held[-1] if held else None
                    if last and last[0] == owner and last[1] + last[2] == start and last[2] + n <= _RUN_WINDOWS:
                        last[2] += n
                    else:
                        held.append([owner, start, n])
                out += [(owner, row, doc, s, n, b" ".join(words[s:s + n + window - 1])) for owner, s, n in held]
            cols = zip(*out) if out else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["owner", "row", "doc_id", "start", "windows", "words"])

    return texts.mapInArrow(run, _SEGMENT)


class _Shard:
    """Segments of one shard, their words as letters."""

    def __init__(self, window: int):
        self.window, self.letters = window, {}

    def letter(self, word: bytes) -> str:
        found = self.letters.get(word)
        if found is None:
            found = self.letters[word] = chr(_FIRST_LETTER + len(self.letters))
        return found

    def spelled(self, words: bytes, known_only: bool = False) -> str:
        """One letter per word; with ``known_only`` words that no phrase of
        the shard holds are all the same letter."""
        if known_only:
            return "".join([self.letters.get(w, _OTHER_WORD) for w in words.split()])
        return "".join(map(self.letter, words.split()))

    def automaton(self, firsts: dict):
        """Aho-Corasick over the confirmed windows, each with its first place."""
        out = ahocorasick.Automaton()
        for phrase, place in firsts.items():
            out.add_word(phrase, place)
        out.make_automaton()
        return out

    def later_spans(self, automaton, text: str, place: tuple) -> Iterator[tuple[int, int]]:
        """Word spans of ``text`` (whose first word is at ``place``) covered by
        windows that are not where they are first met; merged."""
        begin = end = -1
        *doc, start = place
        for last, first in automaton.iter(text):
            at = start + last - self.window + 1
            if first == (*doc, at):
                continue
            if at > end:
                if end > 0:
                    yield begin, end
                begin = at
            end = at + self.window
        if end > 0:
            yield begin, end


def _place(doc, row, start) -> tuple:
    """Order of windows: by id (none last), row, start."""
    return doc is None, doc or 0, row, start


def _spans_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))],
                                      ["row", "begin", "end"])


def _rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _windows_of(text: str, windows: int, window: int) -> Iterable[tuple[int, str]]:
    return ((k, text[k:k + window]) for k in range(windows))


def _located(shards: DataFrame, window: int, limit: int) -> DataFrame:
    """Step 3 on segments sorted by owner, all of an owner in one partition:
    ``(row, begin, end)`` of words to remove."""

    def solve(held):
        shard, found = _Shard(window), {}
        spelled = [shard.spelled(s["words"]) for s in held]
        for s, text in zip(held, spelled):
            for k, phrase in _windows_of(text, s["windows"], window):
                place = _place(s["doc_id"], s["row"], s["start"] + k)
                known = found.get(phrase)
                found[phrase] = (place, False) if known is None else (min(place, known[0]), True)
        confirmed = {p: place for p, (place, again) in found.items() if again}
        if not confirmed:
            return []
        automaton = shard.automaton(confirmed)
        return [(s["row"], *span) for s, text in zip(held, spelled)
                for span in shard.later_spans(automaton, text, _place(s["doc_id"], s["row"], s["start"]))]

    def run(batches):
        held, words = [], 0
        for _, group in groupby(_rows_of(batches), lambda s: s["owner"]):       # an owner is never split
            for s in group:
                held.append(s)
                words += s["windows"] + window
            if words >= limit:
                yield _spans_batch(solve(held))
                held, words = [], 0
        yield _spans_batch(solve(held))

    return shards.mapInArrow(run, "row long, begin int, end int")


def _counted(parts: DataFrame, window: int, limit: int) -> DataFrame:
    """Step 4, first half: the windows of owners that are dealt out, counted
    per shard: ``(owner, phrase, count, place)``."""

    def counted(held):
        found = {}
        for s in held:
            words = s["words"].split()
            for k in range(s["windows"]):
                key = s["owner"], b" ".join(words[k:k + window])
                place = _place(s["doc_id"], s["row"], s["start"] + k)
                n, first = found.get(key, (0, place))
                found[key] = n + 1, min(first, place)
        rows = [(owner, phrase, n, dict(zip(("no_id", "doc_id", "row", "start"), place))) for (owner, phrase), (n, place) in found.items()]
        cols = zip(*rows) if rows else [()] * 4
        kind = pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), kind))],
                                          ["owner", "phrase", "count", "place"])

    def run(batches):
        held, words = [], 0
        for s in _rows_of(batches):
            held.append(s)
            words += s["windows"] + window
            if words >= limit:
                yield counted(held)
                held, words = [], 0
        yield counted(held)

    return parts.mapInArrow(run, "owner long, phrase binary, count long, "
                                 "place struct<no_id:boolean,doc_id:long,row:long,start:long>")


def _streamed(dealt: DataFrame, window: int) -> DataFrame:
    """Step 4, second half: rows sorted by ``(owner, part, group, kind)``; the
    confirmed windows of a shard come first (kind 0), then its segments."""

    def run(batches):
        for _, rows in groupby(_rows_of(batches), lambda r: (r["owner"], r["part"], r["group"])):
            shard, firsts, automaton, out = _Shard(window), {}, None, []
            for r in rows:
                if r["kind"] == 0:
                    firsts[shard.spelled(r["words"])] = _place(None if r["no_id"] else r["doc_id"], r["row"], r["start"])
                    continue
                if automaton is None:
                    if not firsts:
                        break
                    automaton = shard.automaton(firsts)
                text = shard.spelled(r["words"], known_only=True)
                out += [(r["row"], *span) for span in shard.later_spans(automaton, text, _place(r["doc_id"], r["row"], r["start"]))]
                if len(out) >= 65536:
                    yield _spans_batch(out)
                    out = []
            yield _spans_batch(out)

    return dealt.mapInArrow(run, "row long, begin int, end int")


def _hot_spans(spark: SparkSession, hot: DataFrame, window: int, limit: int) -> DataFrame:
    """Spans of the owners with more words than a shard holds; ``hot`` has
    their segments with ``parts``, the number to deal an owner out to."""
    part = F.pmod(F.xxhash64("row", "start"), F.col("parts"))
    dealt = hot.withColumn("part", part).repartition("owner", "part").sortWithinPartitions("owner", "part")
    sums = _counted(dealt, window, limit).groupBy("owner", "phrase").agg(F.sum("count").alias("count"), F.min("place").alias("place"))
    confirmed = materialize(spark, sums.filter(F.col("count") > 1), "phrases-confirmed")
    shape = (confirmed.groupBy("owner").agg(F.count("*").alias("phrases"))
             .select("owner", F.ceil(F.col("phrases") * window / limit).cast("long").alias("groups")))
    owners = hot.groupBy("owner").agg(F.first("parts").alias("parts")).join(shape, "owner")
    columns = ["owner", "part", "group", "kind", "words", "no_id", "doc_id", "row", "start"]
    group = F.pmod(F.xxhash64("phrase"), F.col("groups"))
    phrases = (confirmed.join(owners, "owner").withColumn("group", group)
               .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
               .select("owner", "part", "group", F.lit(0).alias("kind"), F.col("phrase").alias("words"), "place.*"))
    places = (hot.withColumn("part", part).join(owners.select("owner", "groups"), "owner")
              .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
              .select("owner", "part", "group", F.lit(1).alias("kind"), "words", F.col("doc_id").isNull().alias("no_id"), "doc_id", "row",
                      F.col("start").cast("long").alias("start")))
    both = phrases.select(columns).unionAll(places.select(columns))
    shards = both.repartition("owner", "part", "group").sortWithinPartitions("owner", "part", "group", "kind")
    return _streamed(shards, window)


def _cut(texts: DataFrame) -> DataFrame:
    """``texts`` with ``(row, data, marks)``: merged spans and what is left."""

    def run(batches):
        for batch in batches:
            sizes, begins, ends, kept = [], [], [], []
            for data, marks in zip(batch.column("data"), batch.column("marks")):
                spans: list[list[int]] = []
                for begin, end in sorted((m["begin"], m["end"]) for m in marks.as_py()):
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([begin, end])
                words, left, at = data.as_py().split(), [], 0
                for begin, end in spans:
                    left += words[at:begin]
                    at = end
                kept.append(b" ".join(left + words[at:]).decode())
                sizes.append(len(spans))
                begins += [s[0] for s in spans]
                ends += [s[1] for s in spans]
            structs = pa.StructArray.from_arrays([pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), _list_of(sizes, structs), pa.array(kept, pa.string())],
                                             ["row", "spans", "kept"])

    return texts.mapInArrow(run, "row long, spans array<struct<begin:int,end:int>>, kept string")


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    phrase_words: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, n_words, words_sha256, n_removed, spans, kept)``, one row per
    row of ``docs``: the digest of its words joined by one space, the number
    of words that go, their spans (word numbers, end exclusive; null where all
    go with a copy) and the words that stay, joined by one space (null where
    none goes).

    Defined results: a null text has no words; a text shorter than ``window``
    stays whole; of rows that share an id the first in the table's files
    counts as earlier, rows without an id come last; an empty table gives no
    rows.  Other columns are not read.
    """
    tags = tagged(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("data")))
    texts = tags.select("tag", "doc.doc_id", F.col("doc.data").cast("binary").alias("data"))
    hashed = materialize(spark, _hashed(texts, window, phrase_words).withColumn("row", F.monotonically_increasing_id()), "phrases-hashed")

    # 1. The first row of every text.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = hashed.groupBy("digest").agg(F.min(order).alias("first")).select("first.row")
    rows = materialize(spark, hashed.select("row", "tag", "doc_id", "n_words", F.hex("digest").alias("digest"))
                       .join(first.withColumn("is_first", F.lit(True)), "row", "left"), "phrases-rows")
    own = rows.filter("is_first")

    # 2. Runs whose anchor is met twice, with the row that met it first.
    runs = hashed.join(own.select("row"), "row", "left_semi").select("row", F.inline("runs"))
    met = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("row").alias("owner")).filter(F.col("n") > 1)
    # Written first: then both sides of the join are plain shuffles, and AQE can split an anchor that many documents have.
    met = materialize(spark, met.select("anchor", "owner"), "phrases-met")
    spots = runs.join(met, "anchor").groupBy("row").agg(F.collect_list(F.struct("start", "windows", "owner")).alias("spots"))
    spots = spots.join(own.select("row", "tag", "doc_id"), "row")
    segments = materialize(spark, _segments(texts.select("tag", "data").join(spots, "tag"), window), "phrases-segments")
    drop_written(spark, hashed)

    # 3. and 4. Shards by owner; owners with too many words for one are dealt out.
    load = segments.groupBy("owner").agg(F.ceil(F.sum(F.col("windows") + window) / shard_words).alias("parts")).filter(F.col("parts") > 1)
    load = materialize(spark, load, "phrases-load")
    shards = segments.join(load, "owner", "left_anti").repartition("owner").sortWithinPartitions("owner")
    marks = _located(shards, window, shard_words)
    if not load.isEmpty():
        hot = materialize(spark, segments.join(load, "owner"), "phrases-hot")
        marks = marks.unionAll(_hot_spans(spark, hot, window, shard_words))
    marks = materialize(spark, marks.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("marks")), "phrases-marks")
    drop_written(spark, segments)

    marked = own.select("row", "tag").join(marks, "row")
    left = _cut(texts.select("tag", "data").join(marked, "tag").select("row", "data", "marks"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    copy = F.col("is_first").isNull() & (F.col("n_words") >= window)
    return rows.join(left, "row", "left").select(
        "doc_id", "n_words", F.lower("digest").alias("words_sha256"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce(size, F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("spans").isNull() & ~copy, F.array().cast("array<struct<begin:int,end:int>>")).otherwise(F.col("spans")).alias("spans"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of ``without_repeats``."""
    return rows.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), "words_sha256").alias("kept_sha256"))
