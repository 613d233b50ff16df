"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  One distributed
sort of all blocks gives equal blocks the same integer name and different
blocks different names (names are dense ranks, so there are no collisions).
Adjacent names of a document are paired, the pairs are sorted and named the
same way, and so on until each document has one name.  Two texts are equal
exactly if they end at the same level with the same name.

Scale: each text crosses the network once, in the sort of its blocks; every
later level moves integers, half as many each time.  The sort key ends with
the row number, so a block that a third of all documents share spreads over
many partitions; its name is made whole again by comparing the last block of
a partition with the first of the next.  Blocks are ranged by a hash, so the
driver's sample of range bounds holds a few numbers per row; the only broadcast
is one row per sort partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, materialize, only_tags, tagged, whole_text

BLOCK_BYTES = 1024
_CARRIED = ["row", "pos", "n", "doc_id", "digest", "tag"]
_CARRIED_DDL = "row long, pos long, n long, doc_id long, digest binary, tag string"


def _ranks(batches):
    """Rank of each key among the distinct keys of this partition, sorted by
    hash and key.  After the data rows (kind 0) come two rows with the
    partition's first (kind 1) and last key (kind 2), their hashes and how
    many keys of the partition have that hash."""
    part, rank, schema = TaskContext.get().partitionId(), -1, None
    first = last = None                     # key, hash
    with_first = since = 0                  # ranks: end of the first hash's keys, begin of the last one's
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, hashes = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(len(keys), bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        if first is None:
            first = last = keys[0].as_py(), int(hashes[0])
        else:
            new[0] = keys[0].as_py() != last[0]
        ranks = rank + np.cumsum(new)
        other = np.flatnonzero(hashes != np.r_[last[1], hashes[:-1]])
        if len(other):
            with_first, since = with_first or int(ranks[other[0]]), int(ranks[other[-1]])
        rank, last = int(ranks[-1]), (keys[-1].as_py(), int(hashes[-1]))
        n = len(keys)
        rows = [batch.column(i) for i in range(2, batch.num_columns)]
        out = pa.RecordBatch.from_arrays(
            rows + [pa.array(np.full(n, part, np.int32)), pa.array(ranks), pa.array(np.zeros(n, np.int8)),
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            _CARRIED + ["part", "rank", "kind", "key", "hash", "alike"])
        schema = out.schema
        yield out
    if schema is not None:
        edge = {"part": [part] * 2, "rank": [rank] * 2, "kind": [1, 2], "key": [first[0], last[0]], "hash": [first[1], last[1]],
                "alike": [with_first or rank + 1, rank + 1 - since]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(edge.get(f.name, [None] * 2), f.type) for f in schema], schema=schema)


def _ranked(spark: SparkSession, keyed: DataFrame, hashed: bool, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their ranks, and one row per sort partition: its edges."""
    value = F.shiftrightunsigned(F.xxhash64("key"), 64 - hash_bits) if hashed else F.lit(0).cast("long")
    order = ["hash", "row", "pos"] if hashed else ["key", "row", "pos"]
    rows = keyed.select("key", value.alias("hash"), *_CARRIED)
    ranked = materialize(
        spark, rows.repartitionByRange(*order).sortWithinPartitions("hash", "key", "row", "pos")
        .mapInArrow(_ranks, f"{_CARRIED_DDL}, part int, rank long, kind byte, key binary, hash long, alike long"),
        "block-ranks")
    edge = [F.max(F.when(F.col("kind") == k, F.struct("key", "hash", "alike"))).alias(name) for k, name in ((1, "first"), (2, "last"))]
    edges = ranked.filter("kind > 0").groupBy("part").agg(*edge, (F.max("rank") + 1).alias("distinct"))
    return ranked, edges.withColumn("before", F.lag("last").over(Window.orderBy("part")))


def named(spark: SparkSession, keyed: DataFrame, hashed: bool = False, hash_bits: int = 64) -> DataFrame:
    """Rows of ``keyed`` (key binary + the carried columns) with ``name``, a
    dense rank of the key among all keys.

    ``hashed``: the rows are ranged by a hash of the key, so Spark's sample of
    range bounds on the driver holds hashes in place of whole blocks.  Keys
    stay the names' base: where a hash goes on over a border of partitions and
    more than one key has it there, the rows are ranged by the keys instead.
    """
    ranked, edges = _ranked(spark, keyed, hashed, hash_bits)
    goes_on, same = F.col("first.hash") == F.col("before.hash"), F.col("first.key") == F.col("before.key")
    if hashed and not edges.filter(goes_on & ~(same & (F.col("first.alike") == 1) & (F.col("before.alike") == 1))).isEmpty():
        drop_written(spark, ranked)
        ranked, edges = _ranked(spark, keyed, False, hash_bits)
    # The names used before a partition, and whether its first key continues the last of the partition before.
    by_part = Window.orderBy("part")
    edges = edges.withColumn("same", F.coalesce(same.cast("long"), F.lit(0)))
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    starts = edges.select(
        "part", (F.coalesce(F.sum("distinct").over(before), F.lit(0))
                 - F.sum("same").over(by_part.rowsBetween(Window.unboundedPreceding, 0))).alias("start"))
    return (ranked.filter("kind = 0").join(F.broadcast(starts), "part")      # a row per sort partition
            .select(*_CARRIED, (F.col("start") + F.col("rank")).alias("name")))


def _pair_key(a: str, b: str):
    """Two names as 16 bytes that sort like the pair; no second name is -1."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.coalesce(F.col(c), F.lit(-1))), 16, "0") for c in (a, b))))


def identities(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, tag: Column | None = None, hash_bits: int = 64) -> DataFrame:
    """``(row, doc_id, level, name, digest, tag)`` per row of ``docs``: equal
    ``(level, name)`` exactly for equal texts; ``digest`` is the SHA-256 of
    the text; ``tag`` is passed through."""
    size = F.octet_length("data")
    blocks = F.expr(f"transform(sequence(0L, greatest(cast(ceil(octet_length(data) / {block_bytes}) as bigint) - 1, 0L)), "
                    f"i -> substring(data, cast(i * {block_bytes} + 1 as int), {block_bytes}))")
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).cast("binary").alias("data"),
                        (F.lit(None) if tag is None else tag).cast("string").alias("tag"))
            .select("row", "doc_id", "tag", F.unhex(F.sha2("data", 256)).alias("digest"),
                    F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("long").alias("n"),
                    F.posexplode(blocks).alias("pos", "key"))
            .select("key", "row", F.col("pos").cast("long").alias("pos"), "n",
                    *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "digest", "tag"))))
    done, level = [], 0
    while True:
        rows = named(spark, rows, hashed=level == 0, hash_bits=hash_bits)
        done.append(rows.filter("n = 1").select("row", "doc_id", F.lit(level).alias("level"), "name", "digest", "tag"))
        rows = rows.filter("n > 1")
        if rows.isEmpty():
            break
        rows = (rows.groupBy("row", F.expr("pos div 2").alias("pos"))
                .agg(*(F.max(c).alias(c) for c in ("n", "doc_id", "digest", "tag")),
                     F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                     F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
                .select(_pair_key("a", "b").alias("key"), "row", "pos", F.expr("(n + 1) div 2").alias("n"),
                        "doc_id", "digest", "tag"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of
    ``docs``; of equal texts the row with the largest id stays.

    Defined results: null text is the empty text; null ids sort below all
    others (a group of null ids only has a null ``keep_id``); of rows that
    repeat both id and text exactly one is kept; an empty table gives no rows;
    other columns are not read, so their names cannot clash.
    """
    return _decided(spark, identities(spark, docs, id_col, text_col, block_bytes)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _decided(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``identities`` with ``keep_id``, ``group_size`` and ``kept``.  The sizes
    and survivors are pre-aggregated and written, so AQE can split the rows of
    a large group when they are joined back."""
    ids = materialize(spark, found, "block-identities")
    groups = materialize(
        spark, ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")),
        "block-groups")
    return ids.join(groups, ["level", "name"]).select(
        "*", F.col("keep.doc_id").alias("keep_id"), (F.col("row") == F.col("keep.row")).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with their own
    columns, whatever their names."""
    rows = tagged(spark, docs)
    found = identities(spark, rows.select("tag", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text")),
                       "id", "text", tag=F.col("tag"))
    return only_tags(rows, _decided(spark, found).filter("kept").select("tag"))
