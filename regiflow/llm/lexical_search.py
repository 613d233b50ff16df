"""Ranked lexical search by bag deduplication.

For a stated set of items, documents are restricted to the items' vocabulary.
What decides a document's score is then its bag (the counts of vocabulary
terms) and its length figure m.  Documents are hashed on the two, equal ones
verified by the bag itself and made one class; each class is scored once, and
only the classes that can reach an item's ranking are expanded into their
members, smallest ids first.

Scale: items go in blocks of bounded size, so what travels to the tasks (the
block's vocabulary, weights and postings) never grows with the documents; each
block reads the documents once.  Classes are counted by partial aggregates, so
a text with millions of copies leaves each task as one row.  A scoring task
holds the best rows of each item of the block and emits those alone; the
members of a class are cut to the ranking's depth before they are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

TOP = 20
BLOCK_BYTES = 1 << 20        # text of the items handled at once, in expectation
BLOCK_ITEMS = 2000
_CELLS = 1 << 20             # scores, or postings, that a task expands at once

# A term is a run of bytes other than these, A-Z lower-cased; the score's constants.
_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
WEIGHT_UNIT, SATURATION_UNIT, COUNT_UNIT, LENGTH_UNIT = 1000, 1_000_000_000, 1000, 12
LENGTH_BASE, LENGTH_SLOPE = 100, 25

_TERM_BYTES = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in (b if b in _KEPT else 0x20 for b in range(256)))
_BAG = "doc_id long, n long, bag binary"
_CLASS = ["hash", "m", "bag"]


def terms(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return data.translate(_TERM_BYTES).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, bag)`` of every row of ``docs``: the number of its terms
    and, by term number, the counts of those in ``vocabulary`` (pairs of
    unsigned 32-bit integers)."""

    def run(batches):
        for batch in batches:
            sizes, packed = [], []
            for data in batch.column(1):
                found = terms(data.as_py())
                counts = Counter(map(vocabulary.get, found))
                counts.pop(None, None)
                sizes.append(len(found))
                packed.append(np.array(sorted(counts.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                                             ["doc_id", "n", "bag"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, _BAG)


def _length_figure(n: Column, documents: int, all_terms: int) -> Column:
    """m of a document with ``n`` terms, in decimals that cannot overflow."""
    product = (n * LENGTH_SLOPE).cast("decimal(18,0)") * F.lit(documents).cast("decimal(19,0)")
    return LENGTH_BASE - LENGTH_SLOPE + F.call_function("div", product, F.lit(all_terms).cast("decimal(19,0)"))


def _unpacked(batch_bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of a column of bags."""
    data = [b.as_py() for b in batch_bags]
    pairs = np.frombuffer(b"".join(data), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(data)), [len(d) // 8 for d in data]), pairs[:, 0], pairs[:, 1]


def document_counts(classes: DataFrame, size: int) -> DataFrame:
    """``(term, df)``: the documents that hold each vocabulary term, from the
    classes and their sizes; a task emits a row per term at most."""

    def run(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            row, term, _ = _unpacked(batch.column(0))
            np.add.at(held, term, batch.column(1).to_numpy(zero_copy_only=False)[row])
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["term", "df"])

    return classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Postings:
    """The items of a block by term: which items hold it, and how often."""

    def __init__(self, item_terms: list[list[int]], size: int):
        pairs = [(t, i, c) for i, own in enumerate(item_terms) for t, c in Counter(own).items()]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.items, self.repeats, self.n_items = table[:, 1], table[:, 2], len(item_terms)
        self.start = np.searchsorted(table[:, 0], np.arange(size + 1))

    def scores(self, n_rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The sum of ``value`` times repeats, per row and item."""
        out = np.zeros(n_rows * self.n_items, np.int64)
        n = self.start[term + 1] - self.start[term]
        cuts = np.searchsorted(np.cumsum(n), np.arange(_CELLS, n.sum() + 1, _CELLS)) + 1
        for own in np.split(np.arange(len(term)), cuts):
            k = n[own]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.start[term[own]], k)
            np.add.at(out, np.repeat(row[own], k) * self.n_items + self.items[at], np.repeat(value[own], k) * self.repeats[at])
        return out.reshape(n_rows, self.n_items)


def _best(item, score, unknown, least, top):
    """Places of the ``top`` best rows of each item: highest score first, then
    smallest id, unknown ids last."""
    order = np.lexsort((least, unknown, -score, item))
    at = item[order]
    first = np.searchsorted(at, at)
    return order[np.arange(len(at)) - first < top]


def leading_classes(classes: DataFrame, postings: _Postings, weights: np.ndarray, top: int) -> DataFrame:
    """``(item, score, least, hash, m, bag)``: of each task's classes the best
    ``top`` of every item, by score, then smallest member id."""
    n_items = postings.n_items

    def run(batches):
        item = score = least = np.zeros(0, np.int64)
        unknown, key = np.zeros(0, bool), pa.table({"hash": pa.array([], pa.int64()), "m": pa.array([], pa.int64()),
                                                    "bag": pa.array([], pa.binary())})
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, _CELLS // n_items)):
                part = batch.slice(at, step)
                row, term, count = _unpacked(part.column("bag"))
                m = part.column("m").to_numpy(zero_copy_only=False)
                value = weights[term] * (SATURATION_UNIT * count // (COUNT_UNIT * count + LENGTH_UNIT * m[row]))
                found = postings.scores(part.num_rows, row, term, value)
                lowest, bar = np.full(n_items, np.iinfo(np.int64).max), np.zeros(n_items, np.int64)
                np.minimum.at(lowest, item, score)
                full = np.bincount(item, minlength=n_items) >= top
                bar[full] = lowest[full]                        # a full item's worst score so far
                r, i = np.nonzero((found > 0) & (found >= bar))
                ids = part.column("least")
                item, score = np.r_[item, i], np.r_[score, found[r, i]]
                unknown = np.r_[unknown, ids.is_null().to_numpy(zero_copy_only=False)[r]]
                least = np.r_[least, ids.fill_null(0).to_numpy(zero_copy_only=False)[r]]
                place = np.r_[np.arange(len(key)), len(key) + r]
                kept = _best(item, score, unknown, least, top)
                item, score, unknown, least = item[kept], score[kept], unknown[kept], least[kept]
                own = pa.Table.from_batches([part.select(_CLASS)]).cast(key.schema)
                key = pa.concat_tables([key, own]).take(pa.array(place[kept])).combine_chunks()     # one for each held row
        out = pa.table([pa.array(item, pa.int32()), pa.array(score), pa.array(least, mask=unknown), *key.columns],
                       ["item", "score", "least", *_CLASS])
        yield from out.to_batches(max_chunksize=4096)

    return classes.select("least", *_CLASS).mapInArrow(run, "item int, score long, least long, hash long, m long, bag binary")


def _searched(spark: SparkSession, docs: DataFrame, items: list[tuple], top: int, id_col: str, text_col: str) -> DataFrame:
    """The ranking of one block of items ``(id, text)``."""
    found = [terms((text or "").encode()) for _, text in items]
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in found for t in own}))}
    postings = _Postings([[vocabulary[t] for t in own] for own in found], len(vocabulary))

    own = materialize(spark, bags(docs, vocabulary, id_col, text_col), "search-bags")
    documents, all_terms = own.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = _length_figure(F.col("n"), documents, all_terms or 1)
    rows = own.filter(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("bag", "m"))
    classes = materialize(
        spark, rows.groupBy(*_CLASS).agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "search-classes")

    weights = np.zeros(len(vocabulary), np.int64)
    for r in document_counts(classes, len(vocabulary)).collect():         # a row per vocabulary term of the block
        weights[r.term] = math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * r.df + 1)))

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("least"), *_CLASS)
    leaders = materialize(
        spark, leading_classes(classes, postings, weights, top).withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top).drop("rank", "least"), "search-leaders")
    # At most top classes per item of the block: their hashes may be broadcast.
    near = rows.join(F.broadcast(leaders.select("hash").distinct()), "hash", "left_semi")
    by_id = Window.partitionBy(*_CLASS).orderBy(F.asc_nulls_last("doc_id"))
    members = near.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= top).drop("place")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = (leaders.join(members, _CLASS).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each row of ``items`` the
    ``top`` documents with the highest score above 0, rank 1 first, equal
    scores by ascending id.

    Defined results: null texts have no terms, and documents without terms
    are not counted; an item that no document matches has no row; rows of
    ``docs`` that share an id are ranked each, null ids after all others of
    the same score; repeated rows of ``items`` are ranked each; without items
    or documents the result is empty.  Other columns are not read.
    """
    own = items.select(F.col(item_id).cast("long").alias("id"), whole_text(item_text).alias("text"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-size // block_bytes), -(-n // block_items))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        chosen = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        if rows := [tuple(r) for r in chosen.sort("id", "text").collect()]:             # one bounded block
            found = _searched(spark, docs, rows, top, id_col, text_col)
            out = found if blocks == 1 else out.unionAll(found)
    return out
