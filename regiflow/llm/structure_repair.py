"""Conversation structure repair by grammar-compressed dynamic programming.

A sound conversation is an optional system row followed by pairs of a user
and an assistant row: role initials ``(s?(ua)+)?``.  Rows are kept, given
another role, deleted, or inserted, at least cost.  What a row allows depends
on its role and fault alone, so a conversation is a word over nine symbols.

The words are cut into segments of bounded length, equal segments are solved
once, and the segments of a task share one Re-Pair grammar: the most frequent
pair of symbols becomes a rule until no pair is met twice.  A symbol's transfer
matrix has, for each pair of states (start, after s, after u, after a), the
least cost of passing the symbol and a rope of the edits; a rule's matrix is
the min-plus product of its two parts, with ropes that point into them.  Of
equal costs the least edit string counts.  Every edit string of a segment ends
with the edit of its last row (insertions stand before a row), so none is the
beginning of another: the order of two concatenations follows from the order
of the parts, and a rope carries only its rank among the matrix's sixteen.

Scale: equal rows are counted before they are shuffled; conversations are
ranged by (conversation, turn), so a conversation with a third of all rows
spreads over many tasks, each of which emits bounded segments.  The segments
of a conversation meet as sixteen costs and ranks.  Rows meet their edits by
place.  Only ``digests`` brings a conversation together, in a sorted stream
that holds one row at a time, and its edit string, which is its result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SEGMENT = 4096               # rows of a segment at most
BATCH_SYMBOLS = 200_000      # symbols that share a grammar
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_BLANKS = " \t\n\x0b\x0c\r"
_STEPS = {"s": [(START, AFTER_S)], "u": [(START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)], "a": [(AFTER_U, AFTER_A)]}
#: What can be inserted at the end to finish a conversation.
_ENDS = {START: "", AFTER_S: "UA", AFTER_U: "A", AFTER_A: ""}
_FAR = 1 << 40

# An edit is one letter: U, A insert a user or assistant row, u, a give a row that role, k keeps and d deletes it.
_EDITS, _AUDIT = "UAuakd", "IIRRKD"
_ROLES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}


def audit_of(edits: Column) -> Column:
    """The initials of edits: Insert, Rerole, Keep, Delete."""
    return F.translate(edits, _EDITS, _AUDIT)


class Rules:
    """Transfer matrices of symbols and of pairs of them."""

    def __init__(self):
        self.cost, self.rank, self.via, self.parts = [], [], [], []
        self.of_symbol = {s: self._terminal(s) for s in "xsuaoSUAO"}
        self.of_pair: dict[tuple[int, int], int] = {}

    def _terminal(self, symbol: str) -> int:
        """A row: insertions, then its own edit.  x must be deleted; an upper
        case letter is a truncated row of that role (o: any other)."""
        extra, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        inserted = [(i, i, 0, "") for i in range(4)]
        for letter, to in (("U", "u"), ("A", "a")):
            inserted += [(i, k, INSERT, letter) for i, k in _STEPS[to]]
        inserted += [(i, AFTER_A, 2 * INSERT, "UA") for i, _ in _STEPS["u"]]
        own = [(k, k, DELETE, "d") for k in range(4)]
        if role != "x":
            own += [(k, j, extra, "k") for k, j in _STEPS.get(role, [])]
            own += [(k, j, REROLE + extra, to) for to in "ua" for k, j in _STEPS[to]]
        best: dict[tuple[int, int], tuple] = {}
        table = str.maketrans(_EDITS, _AUDIT)
        for i, k, c, before in inserted:
            for m, j, d, edit in own:
                if m == k:
                    new = (c + d, (before + edit).translate(table), before + edit)
                    best[i, j] = min(best.get((i, j), new), new)
        cost, rank = np.full((4, 4), _FAR, np.int64), np.full((4, 4), 31, np.int64)
        order = {a: n for n, a in enumerate(sorted({b[1] for b in best.values()}))}
        for (i, j), (c, audit, _) in best.items():
            cost[i, j], rank[i, j] = c, order[audit]
        return self._add(cost, rank, None, {at: b[2] for at, b in best.items()})

    def _add(self, cost, rank, via, parts) -> int:
        self.cost.append(cost)
        self.rank.append(rank)
        self.via.append(via)
        self.parts.append(parts)
        return len(self.cost) - 1

    def product(self, left: int, right: int) -> int:
        """The symbol that stands for ``left`` followed by ``right``."""
        found = self.of_pair.get((left, right))
        if found is None:
            cost = self.cost[left][:, :, None] + self.cost[right][None]
            key = (cost << 10) + (self.rank[left][:, :, None] << 5) + self.rank[right][None]
            via = key.argmin(axis=1)
            i, j = np.indices((4, 4))
            order = (self.rank[left][i, via] << 5) + self.rank[right][via, j]
            rank = np.unique(order, return_inverse=True)[1].reshape(4, 4)
            found = self._add(np.minimum(cost[i, via, j], _FAR), rank, via, (left, right))
            self.of_pair[left, right] = found
        return found

    def edits(self, symbol: int, i: int, j: int) -> str:
        """The rope of one entry, written out."""
        out, todo = [], [(symbol, i, j)]
        while todo:
            symbol, i, j = todo.pop()
            if self.via[symbol] is None:
                out.append(self.parts[symbol][i, j])
            else:
                k = int(self.via[symbol][i, j])
                left, right = self.parts[symbol]
                todo += [(right, k, j), (left, i, k)]
        return "".join(out)


def re_pair(words: list[list[int]], rules: Rules) -> list[list[int]]:
    """The words with the most frequent pair of neighbours replaced by a rule,
    as long as one is met twice."""
    symbol = [s for w in words for s in w]
    ends = np.cumsum([len(w) for w in words])
    after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
    for start, end in zip([0, *ends[:-1]], ends):
        if end > start:
            after[end - 1], before[start] = -1, -1
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, j in enumerate(after):
        if j >= 0:
            places[symbol[i], symbol[j]].add(i)
    queue = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    while queue:
        n, pair = heapq.heappop(queue)
        now = len(places.get(pair, ()))
        if now != -n:
            if now > 1:
                heapq.heappush(queue, (-now, pair))
            continue
        new, touched = rules.product(*pair), set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if j < 0 or (symbol[i], symbol[j]) != pair:
                continue                                     # taken by the place before it
            h, k = before[i], after[j]
            if h >= 0:
                places[symbol[h], symbol[i]].discard(h)
                touched.add((symbol[h], new))
                places[symbol[h], new].add(h)
            if k >= 0:
                places[symbol[j], symbol[k]].discard(j)
                touched.add((new, symbol[k]))
                places[new, symbol[k]].add(i)
                before[k] = i
            symbol[i], symbol[j], after[i] = new, -1, k
        for p in touched:
            if len(places[p]) > 1:
                heapq.heappush(queue, (-len(places[p]), p))
    return [[s for s in symbol[a:b] if s >= 0] for a, b in zip([0, *ends[:-1]], ends)]


def _finish(cost, rank) -> tuple[int, int]:
    """Best state to end in, and the whole cost."""
    whole, _, j = min((int(cost[j]) + INSERT * len(end), int(rank[j]), j) for j, end in _ENDS.items())
    return j, whole


def solve(words: list[str]) -> Iterator[tuple[Rules, int]]:
    """The symbol that stands for each word (not empty)."""
    rules = Rules()
    for word in re_pair([[rules.of_symbol[s] for s in w] for w in words], rules):
        whole = word[0]
        for s in word[1:]:
            whole = rules.product(whole, s)
        yield rules, whole


def _solved(words: DataFrame) -> DataFrame:
    """``(symbols, cut)`` with, for whole conversations, ``cost`` and
    ``edits``; for segments of cut ones the matrix's costs, ranks and ropes."""

    def out(rows):
        cols = [[], [], [], [], [], [], []]
        for (word, cut), (rules, s) in zip(rows, solve([w for w, _ in rows])):
            costs, ranks = rules.cost[s], rules.rank[s]
            if cut:
                ropes = [rules.edits(s, i, j) if costs[i, j] < _FAR else None for i in range(4) for j in range(4)]
                new = (word, cut, None, None, costs.ravel().tolist(), ranks.ravel().tolist(), ropes)
            else:
                j, whole = _finish(costs[START], ranks[START])
                new = (word, cut, whole, rules.edits(s, START, j) + _ENDS[j], None, None, None)
            for c, v in zip(cols, new):
                c.append(v)
        types = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["symbols", "cut", "cost", "edits", "costs", "ranks", "ropes"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for word, cut in zip(batch.column("symbols").to_pylist(), batch.column("cut").to_pylist()):
                rows.append((word, cut))
                size += len(word)
                if size >= BATCH_SYMBOLS:
                    yield out(rows)
                    rows, size = [], 0
        yield out(rows)

    return words.mapInArrow(run, "symbols string, cut boolean, cost long, edits string, costs array<long>, ranks array<long>, "
                                 "ropes array<string>")


def _chained(segments: DataFrame) -> DataFrame:
    """The states between the segments of each cut conversation: rows sorted
    by ``(conv_id, part, seg)`` give ``(conv_id, part, seg, entry, last,
    cost)``, cost on the last."""

    def chained(conv, places, matrices):
        cost, rank = np.full(4, _FAR, np.int64), np.zeros(4, np.int64)
        cost[START] = 0
        backs = []
        for costs, ranks in matrices:
            sums = cost[:, None] + costs
            back = ((sums << 10) + (rank[:, None] << 5) + ranks).argmin(axis=0)
            order = (rank[back] << 5) + ranks[back, np.arange(4)]
            cost, rank = np.minimum(sums[back, np.arange(4)], _FAR), np.unique(order, return_inverse=True)[1]
            backs.append(back)
        j, whole = _finish(cost, rank)
        out = []
        for n, (place, back) in enumerate(zip(places[::-1], backs[::-1])):
            out.append((conv, *place, 4 * int(back[j]) + j, n == 0, whole if n == 0 else None))
            j = int(back[j])
        return out

    def batch_of(rows):
        cols = zip(*rows) if rows else [()] * 6
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["conv_id", "part", "seg", "entry", "last", "cost"])

    def run(batches):
        held, places, matrices = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if places and r["conv_id"] != held:
                    yield batch_of(chained(held, places, matrices))
                    places, matrices = [], []
                held = r["conv_id"]
                places.append((r["part"], r["seg"]))
                matrices.append((np.array(r["costs"]).reshape(4, 4), np.array(r["ranks"]).reshape(4, 4)))
        if places:
            yield batch_of(chained(held, places, matrices))

    return segments.mapInArrow(run, "conv_id long, part int, seg int, entry int, last boolean, cost long")


_PIECE = ("conv_id long, part int, seg int, k int, run int, turn long, role string, text string, fault string, symbol string, "
          "illegal long, initial string")


def _pieces(rows: DataFrame, segment: int) -> DataFrame:
    """Sorted rows with their place: partition, segment of a conversation
    there and symbol in it.  The copies of a row follow it as pieces without a
    text.  ``illegal`` counts the pairs with the row before, in the partition."""
    names = [f.split(" ")[0] for f in _PIECE.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 4, pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]

    def run(batches):
        part, held, seg, k, last = TaskContext.get().partitionId(), None, 0, 0, None
        started = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["conv_id"] != held:
                    started, held, seg, k, last = True, r["conv_id"], 0, 0, None
                initial = r["role"][:1]
                again = "blank" if r["fault"] == "blank" else "duplicate"
                left = [(1, r["text"], r["fault"], r["symbol"])] + [(r["copies"] - 1, None, again, "x")] * (r["copies"] > 1)
                for n, text, fault, symbol in left:
                    while n:
                        if k == segment:
                            seg, k = seg + 1, 0
                        own = min(n, segment - k)
                        pairs = [(last, initial)] if last is not None else []
                        bad = sum("".join(p) not in ("su", "ua", "au") for p in pairs) + (own - 1)     # copies have one role
                        out.append((held, part, seg, k, own, r["turn"], r["role"], text, fault, symbol, bad, initial))
                        n, k, last = n - own, k + own, initial
            cols = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return rows.mapInArrow(run, _PIECE)


def _same(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, of which the first may be null."""
    on = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) if n == "conv_id" else F.col(f"a.{n}") == F.col(f"b.{n}") for n in names]
    more = [c for c in b.columns if c not in names]
    return a.alias("a").join(b.alias("b"), on, how).select("a.*", *(F.col(f"b.{c}") for c in more))


def _faults(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role, text): its copies, the fault of
    the first one, and its symbol."""
    rows = materialize(spark, turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "repair-rows")
    said = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = materialize(spark, rows.groupBy("conv_id", "role", "text").agg(F.min(said).alias("first")), "repair-first")
    rows = _same(rows, first, ["conv_id", "role", "text"])
    shown = F.rtrim("text", F.lit(_BLANKS))
    fault = (F.when(shown == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate")
             .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role))
    return rows.withColumn("fault", fault).withColumn("symbol", symbol).drop("first")


def _places(spark: SparkSession, turns: DataFrame, segment: int) -> DataFrame:
    rows = _faults(spark, turns)
    # By ranges that a conversation, turn or role does not bound; texts enter the range with their beginning only.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    ordered = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(spark, _pieces(ordered, segment), "repair-pieces")


def _edits(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """``(conv_id, part, seg, edits, cost)``, cost on a conversation's last
    segment."""
    place = ["conv_id", "part", "seg"]
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "symbol", "run"))),
                                       lambda p: F.repeat(p["symbol"], p["run"])), "")
    segments = materialize(spark, pieces.groupBy(*place).agg(spelled.alias("symbols")), "repair-segments")
    many = materialize(spark, segments.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id"), "repair-cut")
    segments = materialize(
        spark, _same(segments, many.withColumn("cut", F.lit(True)), ["conv_id"], "left").withColumn("cut", F.coalesce("cut", F.lit(False))),
        "repair-words")
    solved = materialize(spark, _solved(segments.select("symbols", "cut").distinct()), "repair-solved")

    on = ["symbols", "cut"]
    whole = segments.filter(~F.col("cut")).join(solved.select(*on, "edits", "cost"), on).select(*place, "edits", "cost")
    cut = segments.filter("cut")
    sorted_ = (cut.join(solved.select(*on, "costs", "ranks"), on).select(*place, "costs", "ranks")
               .repartition("conv_id").sortWithinPartitions(*place))
    chosen = _same(cut, _chained(sorted_), place).join(solved.select(*on, "ropes"), on)
    end = F.element_at(F.array(*(F.lit(_ENDS[j]) for j in range(4))), F.col("entry") % 4 + 1)
    rope = F.concat(F.element_at("ropes", F.col("entry") + 1), F.when(F.col("last"), end).otherwise(""))
    return materialize(spark, whole.unionAll(chosen.select(*place, rope.alias("edits"), "cost")), "repair-edits")


def _repaired(pieces: DataFrame, edits: DataFrame) -> DataFrame:
    place = ["conv_id", "part", "seg"]
    units = F.regexp_extract_all("edits", F.lit("[UA]*[uakd]|[UA]+$"), F.lit(0))
    units = (edits.select(*place, F.posexplode(units).alias("k", "unit")).filter(F.col("unit") != "d"))
    # A row is kept or given a role only with its text, in a piece of one.
    own = pieces.filter(F.col("symbol") != "x").select(*place, "k", "turn", F.col("role").alias("was"), "text")
    rows = _same(units, own, [*place, "k"], "left")
    rows = rows.select(*place, "k", F.posexplode(F.filter(F.split("unit", ""), lambda e: e != "")).alias("step", "edit"), "turn", "was", "text")
    role = F.when(F.col("edit") == "k", F.col("was")).when(F.lower("edit") == "u", F.lit(_ROLES["u"])).otherwise(F.lit(_ROLES["a"]))
    old = F.col("edit").isin("k", "u", "a")
    return rows.filter(F.col("edit") != "d").select(
        *place, "k", "step", audit_of(F.col("edit")).alias("edit"), F.when(old, F.col("turn")).alias("turn"), role.alias("role"),
        F.when(old, F.col("text")).otherwise("").alias("text"))


def repair(spark: SparkSession, turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and the findings of every conversation of ``turns``.

    Rows: ``(conv_id, part, seg, k, step, edit, turn, role, text)``; sorted by
    the four places they are the conversation as it should be.  ``edit`` is
    K, R or I; inserted rows have no turn and an empty text.

    Findings: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit)``, ``audit`` being the initials of all edits.

    Defined results: rows are taken by turn (unknown turns first), then role,
    then text; a null role or text is one space; a null ``conv_id`` is a
    conversation of its own; equal rows are copies, each after the first a
    duplicate; a role is known by its first letter; a span of turns that no
    long can hold gives null ``gaps``; an empty table gives no rows.  Other
    columns are not read.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    pieces = _places(spark, rows, segment)
    edits = _edits(spark, pieces)

    wide = F.col("turn").cast("decimal(20,0)")
    spans = pieces.groupBy("conv_id", "turn").agg(F.first("turn").alias("_")).groupBy("conv_id").agg(
        F.coalesce((F.max(wide) - F.min(wide) + 1 - F.count("turn")).try_cast("long"),
                   F.when(F.count("turn") == 0, 0)).alias("gaps"))
    counted = [F.sum(F.when(F.col("fault") == f, F.col("run")).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")]
    counts = pieces.groupBy("conv_id").agg(*counted, F.sum("illegal").alias("inside"))
    # Neighbours in two partitions: one row per conversation and partition.
    at = F.struct("seg", "k")
    borders = pieces.groupBy("conv_id", "part").agg(F.min_by("initial", at).alias("first"), F.max_by("initial", at).alias("last"))
    pair = F.concat(F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")), "first")
    borders = borders.withColumn("bad", (~pair.isin("su", "ua", "au")).cast("long")).groupBy("conv_id").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("between"))
    initials = F.array_sort(F.collect_list(F.struct("part", "seg", audit_of(F.col("edits")).alias("audit"))))
    audits = edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(initials, lambda e: e["audit"]), "").alias("audit"))
    found = _same(_same(_same(counts, borders, ["conv_id"]), spans, ["conv_id"]), audits, ["conv_id"])
    found = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("inside") + F.col("between")).alias("illegal"), "cost", "audit")
    return _repaired(pieces, edits), found


def text_digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired rows, ``role:text`` joined
    by newlines.  A digest needs a conversation's rows in order, so they are
    sorted by place and streamed; one row is held at a time."""

    def run(batches):
        digest, held, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv != held:
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    digest, held = hashlib.sha256(line), conv
                else:
                    digest.update(b"\n" + line)
        if digest is not None:
            out.append((held, digest.hexdigest()))
        cols = zip(*out) if out else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])

    place = ["conv_id", "part", "seg", "k", "step"]
    lines = rows.select(*place, F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return (lines.repartition("conv_id").sortWithinPartitions(*place).select("conv_id", "line")
            .mapInArrow(run, "conv_id long, repaired_sha256 string"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults, by ``crc32("conv_id:turn") % 20``: 0 drops a row,
    1 empties its text, 2 takes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes it a user's.  Nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.filter("kind <> 0")
            .withColumn("_", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def digests(ids: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the digest of the repaired text, for every conversation
    of ``ids (conv_id)``, without rows or not."""
    out = _same(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), found, ["conv_id"], "left")
    out = _same(out, text_digests(rows), ["conv_id"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    # A span of turns beyond long stays unknown; conversations without rows have zeros.
    counts = [F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
