"""Best-fit packing of documents into token sequences of a fixed capacity.

Hierarchical residual packing.  Texts are tokenised once and cut into pieces;
only the pieces' lengths and places travel on.  Each partition packs its own
pieces best-fit, longest first, and emits the bins that are full or nearly
so.  Underfull bins become the items of the next round, on an eighth of the
partitions, until one is left; where they are too many for one task, they are
mixed afresh round by round until a round saves no bin.  A
task of a later round also tries the pieces of its underfull bins one by one
and takes that result if it needs fewer bins.

Scale: a round moves only underfull bins, as narrow rows; a task gets a
bounded number of them; every round is a written table.  No text and no ids
are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import materialize, whole_text
from .tokens import PieceCache, ids_of

CAPACITY = 2048
SEPARATOR_ID = 0
CACHE_PIECES = 500_000
FAN_IN = 8                   # partitions merged into one per round
ROWS_PER_TASK = 500_000      # underfull rows that one packing task holds

_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = f"{_PIECE}, bin long, offset long, open boolean"


# Pieces of these characters alone are split here: ASCII, and letters that NFC leaves and that have one lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+").fullmatch
_LETTERS = "a-zß-öø-ſ"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    """Ids of pieces between white space, in bounded caches of pieces and,
    below them, of the pre-tokens of plain pieces: many pieces are one word
    with other punctuation or capitals, and the library's model is asked only
    once for it.  Other pieces go to the library whole, and all do where a
    file's steps are not the ones that the split stands for."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a worker uses its own core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    model, letter = tokenizer.model, byte_characters()
    probe = "The cat's 12 DOGS, it'll--'re é."
    own = [t.lower() for t in _PRE_TOKEN.findall(probe.lower())]

    def whole(piece: bytes) -> bytes:
        return array("I", tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def word(pre_token: str) -> bytes:
        text = pre_token if pre_token.isascii() else "".join([letter[b] for b in pre_token.encode()])
        return array("I", [t.id for t in model.tokenize(text)]).tobytes()

    words = PieceCache(word, CACHE_PIECES)

    def split(piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if _PLAIN(text) and "<|" not in text:
            return b"".join([words[t] for t in _PRE_TOKEN.findall(text.lower())])
        return whole(piece)

    same = b"".join(map(word, own)) == whole(probe.encode())
    return PieceCache(split if same else whole, CACHE_PIECES)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Every document as ids plus the separator, cut only where it is longer
    than ``capacity``: ``(doc_id, piece, start, length, ids_crc32)``."""

    def run(batches):
        cache, end = _cache(tokenizer_path), np.array([SEPARATOR_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(data.as_py(), cache) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                _COLUMNS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, _PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place in it of each item, and the
    fill of each bin.  A bitmap of the residuals in use gives the tightest
    bin that takes an item."""
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_residual: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := used >> size:
            residual = size + (fits & -fits).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                used &= ~(1 << residual)
        else:
            b, residual = len(fill), capacity
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        residual -= size
        by_residual.setdefault(residual, []).append(b)
        used |= 1 << residual
    return bins, places, np.array(fill, np.int64)


def _packed(capacity: int, closed_at: int, level: int):
    """Pack the bins (runs of equal ``bin``) of a partition as items."""

    def run(batches):
        part = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        length, old = table["length"].to_numpy(), table["bin"].to_numpy()
        starts = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        item = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(old)]))
        bins, places, fill = best_fit(np.add.reduceat(length, starts), capacity)
        bins, places = bins[item], places[item] + table["offset"].to_numpy()
        loose = best_fit(length, capacity)                  # the same bins, opened
        if len(loose[2]) < len(fill):
            bins, places, fill = loose
        number = (np.int64(level) << 48) | (np.int64(part) << 24)         # rounds are many, bins of a task few
        cols = [table[c] for c in _COLUMNS] + [pa.array(number + bins), pa.array(places), pa.array(fill[bins] < closed_at)]
        out = pa.table(cols, [*_COLUMNS, "bin", "offset", "open"])
        yield from out.to_batches(max_chunksize=65536)

    return run


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, nearly_full: float = 0.999) -> DataFrame:
    """``items`` (as from ``pieces``, lengths 1..capacity) with ``sequence_id``
    and ``offset``.

    A bin leaves the hierarchy when nothing that exists fits it any more (its
    room is below the shortest item) or it is filled to ``nearly_full``.
    """
    written = materialize(spark, items, "pack-pieces")
    shape = written.agg(F.min("length"), F.count("*")).first()
    closed_at = min(capacity - (shape[0] or 1) + 1, int(np.ceil(capacity * nearly_full)))
    # Round 0 packs the pieces where they were written, each an item of its own.
    state = written.select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    parts, level, done, before = state.rdd.getNumPartitions() if shape[1] else 1, 0, [], None
    while True:
        state = materialize(spark, state.mapInArrow(_packed(capacity, closed_at, level), _BINS), "pack-bins")
        done.append(state.filter("not open"))
        left = state.filter("open")
        first = F.col("offset") == 0            # one row of every bin
        total, rows, bins = state.agg(F.count_if(first), F.count_if("open"), F.count_if(first & F.col("open"))).first()
        mixing = before is not None and parts <= -(-rows // ROWS_PER_TASK)
        if parts == 1 or not rows or mixing and total >= before:
            done.append(left)
            break
        before, level = bins, level + 1
        parts = max(1, -(-parts // FAN_IN), -(-rows // ROWS_PER_TASK))
        state = (left.drop("open").repartition(parts, "bin").sortWithinPartitions("bin", "offset"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*_COLUMNS, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one
    row per piece of every row of ``docs``.

    Defined results: null and empty texts are the separator alone (one piece
    of one token); a null id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are not read.  Sequence
    numbers are unique but not dense.
    """
    return pack(spark, pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)
