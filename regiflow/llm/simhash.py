"""SimHash near-dedup by anchor-point covering.

A document's fingerprint has 64 bits.  The anchors are the words of a
covering code: the Hamming code over bits 0-62 times the free bit 63.  Every
64-bit value lies within R = 1 of an anchor.  Two fingerprints at most k bits
apart have a value between them that is within ceil(k / 2) of both, and that
value has an anchor within R; so both lie within R + ceil(k / 2) of one common
anchor.  Every distinct fingerprint is replicated to all anchors in that
radius (33 for k = 2; the plain bound R + k would take 652 for the same
links) and fingerprints are compared per anchor.

Scale: copies share a fingerprint and are collapsed first.  One anchor can
get at most as many fingerprints as there are values in its radius (2,081 for
k = 2), whatever the data, so no group is unbounded and no anchor is hot.
Per anchor a spanning forest of the links is emitted, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only_tags, tagged, whole_text
from .components import connected_components

SEED = 42
COVERING_RADIUS = 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK = 1 << 16


def _word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in bounded lists (bytes.split cuts at exactly
    x20 and x09-x0D)."""
    if len(data) <= 1 << 20:
        yield data.split()
        return
    found = (m.group() for m in _WORD.finditer(data))
    while chunk := list(islice(found, _CHUNK)):
        yield chunk


def fingerprint(data: bytes | None, shingle_words: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased (bytes.lower touches ASCII
    only), shingles of ``shingle_words`` words, bit set if set in over half
    of the shingles' XXH64 values.  Fewer words make one shingle; none give 0.
    """
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    for chunk in _word_chunks((data or b"").lower()):
        words = tail + chunk
        if len(words) >= shingle_words:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
            h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        tail = words[-(shingle_words - 1):] if shingle_words > 1 else []
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                 tag: Column | None = None) -> DataFrame:
    """``(doc_id, tag, fp)`` for every row of ``docs``; ``fp`` is the 64-bit
    value as a signed long, ``tag`` is passed through."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "tag", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(None) if tag is None else tag).cast("string").alias("tag"),
                       whole_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, tag string, fp long")


def anchor_masks(radius: int) -> list[np.ndarray]:
    """For each syndrome 0..63 of the Hamming part, the flips of at most
    ``radius`` bits that turn a value with that syndrome into an anchor."""
    masks: list[list[int]] = [[] for _ in range(64)]
    for weight in range(radius + 1):
        for bits in combinations(range(64), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < 63 else 0
            masks[syndrome].append(sum(1 << b for b in bits))
    return [np.array(m, np.uint64) for m in masks]


def syndromes(values: np.ndarray) -> np.ndarray:
    """Hamming syndrome of bits 0-62: the xor of the positions (1-63) set."""
    out = np.zeros(len(values), np.uint8)
    for b in range(63):
        out ^= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) * np.uint8(b + 1)
    return out


def replicas(fps: DataFrame, max_distance: int) -> DataFrame:
    """``(anchor, fp)``: every distinct fingerprint at each anchor within the
    covering radius plus half the maximum distance, rounded up."""
    radius = COVERING_RADIUS + -(-max_distance // 2)

    def run(batches):
        masks = anchor_masks(radius)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            syndrome = syndromes(values)
            for s in np.unique(syndrome):
                own = values[syndrome == s]
                step = max(1, 65536 // len(masks[s]))
                for i in range(0, len(own), step):
                    part = own[i:i + step]
                    anchors = (part[:, None] ^ masks[s][None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.view(np.int64)), pa.array(np.repeat(part, len(masks[s])).view(np.int64))],
                        ["anchor", "fp"])

    return fps.mapInArrow(run, "anchor long, fp long")


def _forest(values: np.ndarray, max_distance: int) -> Iterator[tuple[int, int]]:
    """Spanning edges of the links among the fingerprints at one anchor."""
    rest = values
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= max_distance
            hits, rest = rest[near], rest[~near]
            front.extend(hits)
            for h in hits:
                yield at, h


def _edges_of(anchor: np.ndarray, fp: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Edges within runs of equal ``anchor`` (the rows are sorted)."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    two = starts[sizes == 2]
    hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_distance]
    u, v = list(fp[hit]), list(fp[hit + 1])
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        for a, b in _forest(fp[s:s + n], max_distance):
            u.append(a)
            v.append(b)
    return u, v


def links(spark: SparkSession, fps: DataFrame, max_distance: int) -> DataFrame:
    """``(u, v)`` edges between distinct fingerprints that span every set of
    fingerprints linked at ``max_distance`` bits or fewer."""

    def run(batches):
        held_a = held_f = np.zeros(0, np.uint64)
        for batch in batches:
            a = np.r_[held_a, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
            f = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(a):
                continue
            cut = int(np.flatnonzero(np.r_[True, a[1:] != a[:-1]])[-1])   # the last anchor may go on in the next batch
            held_a, held_f = a[cut:], f[cut:]
            if cut:
                yield out(*_edges_of(a[:cut], f[:cut], max_distance))
        if len(held_a):
            yield out(*_edges_of(held_a, held_f, max_distance))

    def out(u, v):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(np.array(v, np.uint64).view(np.int64))], ["u", "v"])

    near = replicas(fps, max_distance).repartition("anchor").sortWithinPartitions("anchor", "fp")
    return near.mapInArrow(run, "u long, v long").distinct()


def _classes(spark: SparkSession, own: DataFrame, max_distance: int) -> DataFrame:
    """``(fp, root, component_id)`` of the distinct fingerprints of ``own``,
    the written ``fingerprints``; ``root`` is the component's smallest one."""
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = materialize(
        spark, connected_components(spark, links(spark, least.select("fp"), max_distance))
        .withColumnRenamed("node", "fp"), "simhash-roots")
    grouped = materialize(
        spark, least.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-grouped")
    components = materialize(spark, grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-components")
    return materialize(spark, grouped.join(components, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Defined results: a null text counts as empty; a text without a word has
    fingerprint 0 and is linked like any other; repeated rows stay repeated
    and share a component; ``component_id`` is the smallest non-null id of the
    component, null only if it has none; an empty table gives no rows; other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    own = materialize(spark, fingerprints(docs, id_col, text_col, shingle_words), "simhash-fp")
    return own.join(_classes(spark, own, max_distance), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                 max_distance: int = 2) -> DataFrame:
    """One row of ``docs`` per component of ``near_duplicates``, with its own
    columns: the one with the smallest id (null ids last; of rows that share
    it, the first in the table's files)."""
    rows = tagged(spark, docs)
    plain = rows.select("tag", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    own = materialize(spark, fingerprints(plain, "id", "text", shingle_words, F.col("tag")), "simhash-fp")
    # Per fingerprint first: copies are pre-aggregated before they meet their component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("keep")
    kept = (own.groupBy("fp").agg(first).join(_classes(spark, own, max_distance), "fp")
            .groupBy("root").agg(F.min("keep").alias("keep")))
    return only_tags(rows, kept.select("keep.tag"))
