"""Change streams of the raw extract table (S3-S5, ST1-ST5).

The change events are JSON without a schema wrapper (``before``, ``after``,
``op``, ``ts_ms``) keyed by a string.  Any DataFrame with ``key string, value
string`` works as the source - a Kafka topic in production, a JSON/Parquet
file stream in tests.

Idempotence: a micro-batch replayed after a failure must not duplicate rows.
File sinks write each batch into its own ``writer=<stream>/batch_id=<n>``
folder and overwrite exactly that folder, so a replay rewrites the same files;
the writer is the id in the stream's checkpoint, so a second stream, or a new
checkpoint that starts at batch 0 again, never touches another's folders.  The
JDBC sink anti-joins the batch against the target's recent ids before
appending.  Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from regiflow import constants as K
from regiflow import schemas
from regiflow.functions import accounting, variant
from regiflow.operators import documents, versions
from regiflow.session import stream_checkpoint_path
from regiflow.sources import tables

VERSION_ORDER = ["record_created_at", "id"]
#: Why an event carries no version.
REJECT_REASONS = ["tombstone", "malformed", "op_*", "no_after", "no_key", "bad_time"]


def utc_wall_clock(text: Column) -> Column:
    """An ISO instant (``...Z`` or with an offset), or an epoch in seconds,
    milliseconds or microseconds (10, 13 or 16 digits), as its UTC wall-clock
    time, ``timestamp_ntz``, whatever the session time zone; else null."""
    digits = F.when(text.rlike("^[0-9]{10,16}$"), text).try_cast("long")
    epoch = (F.when(F.length(text) == 10, F.timestamp_seconds(digits))
             .when(F.length(text) == 13, F.timestamp_millis(digits))
             .when(F.length(text) == 16, F.timestamp_micros(digits)))
    instant = F.coalesce(epoch, F.try_to_timestamp(F.when(digits.isNull(), text)))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def parse_changes(events: DataFrame) -> DataFrame:
    """ST1: change events -> version rows.

    Only create/snapshot events carry a version: update events only flip the
    flag, which is derived (W1), and may carry a placeholder instead of the
    document.  Every event that gives no row here is in
    ``change_quarantine`` with its reason."""
    return _kept(_parsed(events))


def change_quarantine(events: DataFrame) -> DataFrame:
    """Events that carry no version, with the reason."""
    return _rejected(_parsed(events))


def _parsed(events: DataFrame) -> DataFrame:
    """Every event parsed once: the version's fields, or the event itself and
    why it carries none."""
    env = events.select("key", "value", F.from_json(F.col("value"), schemas.CHANGE_ENVELOPE).alias("_e"))
    timed = env.withColumn("_time", utc_wall_clock(F.col("_e.after.record_created_at"))).withColumn("reason", _reject_reason())
    kept = F.col("reason").isNull()
    fields = {"id": F.col("_e.after.id"), "record_created_at": F.col("_time"), "krs_number": F.col("_e.after.krs_number"),
              "raw_data": F.col("_e.after.raw_data"), "ts_ms": F.col("_e.ts_ms")}
    return timed.select("reason", F.when(~kept, F.col("key")).alias("key"), F.when(~kept, F.col("value")).alias("value"),
                        *[F.when(kept, c).alias(n) for n, c in fields.items()])


def _kept(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("id", "record_created_at", "krs_number", "raw_data", "ts_ms")


def _rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("key", "value", "reason")


def _reject_reason() -> Column:
    """Why an event carries no version (null: it carries one)."""
    op, after = F.col("_e.op"), F.col("_e.after")
    return (F.when(F.col("value").isNull(), F.lit("tombstone"))
            .when(F.col("_e").isNull() | op.isNull(), F.lit("malformed"))
            .when(~op.isin(K.CHANGE_OPS_KEPT), F.concat(F.lit("op_"), op))
            .when(after.isNull(), F.lit("no_after"))
            .when(after["id"].isNull() | after["krs_number"].isNull(), F.lit("no_key"))
            .when(F.col("_time").isNull(), F.lit("bad_time")))


def latest_pointers(version_rows: DataFrame) -> DataFrame:
    """ST2: the latest ``(record_created_at, id)`` of each company.

    On a stream this is a stateful aggregate in update mode whose state is one
    small row per company (the document is not kept in state; it is joined
    back by id from the history)."""
    return versions.latest_per_key(version_rows, "krs_number", VERSION_ORDER).select(
        "krs_number",
        F.col("_max_record_created_at").alias("record_created_at"),
        F.col("_max_id").alias("id"),
    )


def flatten_company(version_rows: DataFrame) -> DataFrame:
    """ST4 transform: the company record (P19) of each version."""
    return variant.company_record(version_rows, "raw_data", keep=["id", "krs_number", "record_created_at"])


def stream_writer(spark: SparkSession) -> str:
    """The id of the stream whose batch is being handled.  Spark keeps it in
    the checkpoint: the same after a restart, another for a new checkpoint."""
    writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not writer:
        raise RuntimeError("not inside a stream's batch; name the writer")
    return writer


def write_batch_folder(df: DataFrame, root: str, batch_id: int,
                       partition_by: Sequence[str] = (), writer: str | None = None) -> None:
    """Idempotent file write of one micro-batch:
    ``<root>/writer=<id>/batch_id=<n>`` is overwritten as a whole, so a
    replayed batch leaves the same files and no other stream's are touched."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    writer = writer or stream_writer(df.sparkSession)
    w.parquet(os.path.join(root, f"writer={writer}", f"batch_id={batch_id}"))


def jdbc_append_new(df: DataFrame, batch_id: int, url: str, table: str,
                    key: Sequence[str] = ("krs_number", "id"), id_col: str = "id",
                    properties: dict | None = None, table_exists: bool = True) -> None:
    """Idempotent JDBC append: rows whose key is already in the target are
    skipped.  The caller says whether the table exists (``False`` for the very
    first batch); an error while reading it fails the batch.  Only target rows with ``id >= min(id of the batch)`` are read
    (the predicate reaches the database), not the whole table."""
    props = properties or {}
    spark = df.sparkSession
    df = df.persist()
    try:
        low = df.agg(F.min(id_col)).first()[0]
        if low is None:
            return
        if table_exists:
            target = spark.read.jdbc(url, table, properties=props).filter(F.col(id_col) >= low)
            fresh = df.join(target.select(*key), list(key), "left_anti")
        else:
            fresh = df
        fresh.write.jdbc(url, table, mode="append", properties=props)
    finally:
        df.unpersist()


def run_available_now(stream_df: DataFrame, on_batch: Callable[[DataFrame, int], None],
                      name: str, checkpoint: str | None = None,
                      output_mode: str = "append") -> StreamingQuery:
    """ST5: process everything available now, then stop (the user's scheduler
    starts it every N hours; missed runs merge into one).  Without an explicit
    ``checkpoint`` the stream's stable folder under ``spark.checkpoint.dir``
    is used, so the next start resumes from the last committed batch."""
    spark = stream_df.sparkSession
    ckpt = checkpoint or stream_checkpoint_path(spark, name)
    q = (stream_df.writeStream.queryName(name).outputMode(output_mode)
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .foreachBatch(on_batch).start())
    q.awaitTermination()
    return q


def stream_versions_to_history(events: DataFrame, history_root: str, pointers_root: str,
                               name: str = "raw_extract_changes",
                               checkpoint: str | None = None,
                               rejects_root: str | None = None) -> StreamingQuery:
    """ST1+S8+ST2+ST5: parse change events, append the versions to the
    history, the latest pointer of each company in the batch to the pointer
    table and the events without a version, with their reason, to the rejects
    (``<history_root>_rejects`` unless named), restartably.  The batch's
    account, ``(outcome, rows)`` for rows in, out and rejected by reason, goes
    to ``<history_root>_accounts``; a batch whose account does not add up fails.

    The current pointer of a company is the greatest over all pointer
    batches (``current_from_pointers``) - the same answer as a stateful
    update-mode aggregate (``latest_pointers`` on the stream), without a state
    store; both write folders keyed by batch id, so a replay is a no-op.

    The history is at-least-once in the source's sense: an event the source
    delivers twice is stored twice (equal rows).  Readers keep one row per
    (company, id) (``current_versions``) - cheaper than a shuffle in every
    micro-batch, and it needs no unbounded stream state."""

    rejects = rejects_root or f"{history_root.rstrip('/')}_rejects"

    def on_batch(raw: DataFrame, batch_id: int) -> None:
        parsed = _parsed(raw).persist()                  # history, pointers and rejects come from one parse
        rows = _kept(parsed)
        try:
            # by day and company: few files a day, each with a narrow company range
            daily = rows.withColumn("ingest_day", F.to_date("record_created_at"))
            write_batch_folder(daily.repartitionByRange("ingest_day", "krs_number"), history_root, batch_id, ["ingest_day"])
            write_batch_folder(latest_pointers(rows), pointers_root, batch_id)
            # All parsed rows pass here once, from memory, without a shuffle: the place to count them.
            counted, seen = accounting.accounted(parsed, REJECT_REASONS)
            write_batch_folder(_rejected(counted), rejects, batch_id)
            account = raw.sparkSession.createDataFrame(accounting.account_of(seen), "outcome string, n_rows long")
            write_batch_folder(account, f"{history_root.rstrip('/')}_accounts", batch_id)
        finally:
            parsed.unpersist()

    return run_available_now(events, on_batch, name, checkpoint)


def current_from_pointers(spark: SparkSession, pointers_root: str,
                          snapshot_root: str | None = None) -> DataFrame:
    """Current pointer per company: the last compacted snapshot (if any) and
    only the pointer batches that it does not include (``writer`` and
    ``batch_id`` are partition columns, so older folders are not read)."""
    batches = spark.read.parquet(pointers_root)
    if snapshot_root is None or not _has_snapshot(spark, snapshot_root):
        return latest_pointers(batches.drop("writer", "batch_id"))
    newer = batches
    for writer, last in _snapshot_positions(spark, snapshot_root).items():
        newer = newer.filter((F.col("writer") != writer) | (F.col("batch_id") > last))
    newer = newer.drop("writer", "batch_id")
    snap = tables.read_snapshot(spark, snapshot_root)
    return latest_pointers(snap.unionByName(newer.select(*snap.columns)))


def read_history(spark: SparkSession, history_root: str, compacted_root: str | None = None,
                 upto: dict[str, int] | None = None) -> DataFrame:
    """The history: the newest compacted files, where there are any, and the
    batches of every writer that they do not include (``writer`` and
    ``batch_id`` are partition columns, so folders they include are not
    read).  With ``upto`` only each writer's batches up to its number."""
    compacted = tables.read_snapshot(spark, compacted_root) if compacted_root and _has_snapshot(spark, compacted_root) else None
    try:
        batches = spark.read.parquet(history_root)
    except AnalysisException:                # every batch so far is compacted and gone
        if compacted is None:
            raise
        return compacted
    if upto is not None:
        wanted = F.lit(False)
        for writer, last in upto.items():
            wanted = wanted | ((F.col("writer") == writer) & (F.col("batch_id") <= last))
        batches = batches.filter(wanted)
    if compacted is None:
        return batches.drop("writer", "batch_id")
    for writer, last in _snapshot_positions(spark, compacted_root).items():
        batches = batches.filter((F.col("writer") != writer) | (F.col("batch_id") > last))
    return compacted.unionByName(batches.drop("writer", "batch_id").select(*compacted.columns))


def compact_history(spark: SparkSession, history_root: str, compacted_root: str) -> int:
    """Rewrite all batch folders so far as files ranged by (day, company) under
    a manifest that ``read_history`` follows; versions that were delivered
    twice become one.  Returns the manifest's version: the number of batches
    included, from 0.

    Which batches are included is settled first, so batches that arrive
    meanwhile stay outside.  Readers see the new files only when the pointer
    row is written, after files and manifest are complete; a run that breaks
    off leaves the answer as it was, and the next one writes its own folder.
    Without a new batch nothing is written.  Batch folders are not touched
    (``forget_compacted`` does that), nor are older compacted files
    (``tables.forget_snapshots``)."""
    positions = _last_batches(spark, history_root)
    if _has_snapshot(spark, compacted_root):                 # of folders that are gone, too
        for writer, last in _snapshot_positions(spark, compacted_root).items():
            positions[writer] = max(last, positions.get(writer, last))
    version = sum(n + 1 for n in positions.values()) - 1
    if tables.published_version(spark, compacted_root) >= version:
        return version                                       # no batch since
    rows = versions.unique_versions(read_history(spark, history_root, compacted_root, upto=positions))
    clustered = rows.repartitionByRange("ingest_day", "krs_number").sortWithinPartitions("ingest_day", "krs_number")
    _publish_positions(spark, compacted_root, version, positions)
    tables.publish_snapshot(clustered, compacted_root, version, ["ingest_day"])
    return version


def forget_compacted(spark: SparkSession, history_root: str, compacted_root: str) -> int:
    """Delete the batch folders that the newest manifest includes, when no
    reader uses an older one any more; returns how many.  A batch among them
    that a stream replays is written again and still not read."""
    gone = 0
    for writer, last in _snapshot_positions(spark, compacted_root).items():
        folder = os.path.join(history_root, f"writer={writer}")
        for path in tables.folders_in(spark, folder):
            name = path.rstrip("/").rsplit("/", 1)[1]
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= last:
                tables.delete_folder(spark, path)
                gone += 1
    return gone


def _last_batches(spark: SparkSession, root: str) -> dict[str, int]:
    """The last batch of each writer: a row per stream, from folder names;
    none where all folders are gone."""
    try:
        rows = spark.read.parquet(root).groupBy("writer").agg(F.max("batch_id").alias("batch_id")).collect()
    except AnalysisException:
        return {}
    return {r.writer: int(r.batch_id) for r in rows}


def _publish_positions(spark: SparkSession, snapshot_root: str, version: int, last: dict[str, int]) -> None:
    rows = [(version, w, n) for w, n in last.items()]
    (spark.createDataFrame(rows, "version long, writer string, batch_id long").write.mode("overwrite")
     .parquet(os.path.join(snapshot_root, "_positions", f"v={version}")))


def current_versions(spark: SparkSession, history_root: str, pointers_root: str,
                     snapshot_root: str | None = None, compacted_root: str | None = None) -> DataFrame:
    """ST2 read side: the current version rows (documents included) - the
    history joined back to the current pointers on (day, company, id, time);
    the day is the history's partition column, so days without a current
    version need not be read.  The pointers are one small row per company, so
    the join keys spread even a company with many versions by hash.  A change event delivered twice
    (at-least-once sources) leaves two equal history rows; the answer keeps
    one per (company, id) - a small de-duplication over about one row per
    company."""
    history = read_history(spark, history_root, compacted_root)
    current = (current_from_pointers(spark, pointers_root, snapshot_root)
               .withColumn("ingest_day", F.to_date("record_created_at")))
    return (history.join(current, ["ingest_day", "krs_number", "id", "record_created_at"], "left_semi")
                   .dropDuplicates(["krs_number", "id"]))


def compact_pointers(spark: SparkSession, pointers_root: str, snapshot_root: str) -> int:
    """Publish the current pointers as a snapshot; later reads start from it.
    The last batch of each writer that it includes is written beside it.
    Returns its version: the number of batches included, from 0; without a new
    batch nothing is written."""
    last = _last_batches(spark, pointers_root)
    version = sum(n + 1 for n in last.values()) - 1
    if tables.published_version(spark, snapshot_root) >= version:
        return version
    current = current_from_pointers(spark, pointers_root, snapshot_root)
    _publish_positions(spark, snapshot_root, version, last)
    tables.publish_snapshot(current, snapshot_root, version)
    return version


def _has_snapshot(spark: SparkSession, snapshot_root: str) -> bool:
    return tables.published_version(spark, snapshot_root) >= 0


def _snapshot_positions(spark: SparkSession, snapshot_root: str) -> dict[str, int]:
    """Last included batch of each writer of the newest snapshot."""
    version = tables.published_version(spark, snapshot_root)
    rows = spark.read.parquet(os.path.join(snapshot_root, "_positions", f"v={version}")).collect()
    return {r.writer: r.batch_id for r in rows}


def stream_registry_walk(responses: DataFrame, walk_root: str, name: str = "registry_walk", checkpoint: str | None = None,
                         **columns) -> StreamingQuery:
    """J5 as a stream of landed answers: per batch the walk of the companies
    that were answered (``versions.first_found_stream``) in a folder of its own.
    A company whose walk is pending is to be asked at its ``registry`` next."""
    walked = versions.first_found_stream(responses, **columns)
    return run_available_now(walked, lambda df, n: write_batch_folder(df, walk_root, n), name, checkpoint, output_mode="update")


def walked_companies(spark: SparkSession, walk_root: str, key: str = "krs_number") -> DataFrame:
    """The walk of every company as its last batch left it (one stream's
    batches are in order; its state holds all answers before)."""
    rows = spark.read.parquet(walk_root)
    columns = [c for c in rows.columns if c not in (key, "writer", "batch_id")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch_id")).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def dedup_stream(rows: DataFrame, key: str = "hash_id") -> DataFrame:
    """ST3: keep the first row of each key across the whole stream (state of
    one key per document)."""
    return rows.dropDuplicates([key])


def insert_new_batch(stored_root: str, key: str = "hash_id",
                     order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """ST3 sink: per batch, append the first row (by ``order``) of each key
    that no other batch of any writer has stored; a replayed batch overwrites
    its own folder, so it adds nothing twice.  Two streams that write at the
    same moment may both store a key; ``stored_once`` resolves that on read.

    Each batch folder is partitioned by key prefix, and the anti-join reads
    only the stored folders of the batch's prefixes (at most 256 values), so
    a micro-batch does not scan the whole store."""

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        writer = stream_writer(spark)
        if order:
            df = documents.keep_first(df, key, order, [c for c in df.columns if c not in (key, *order)])
        else:
            df = df.dropDuplicates([key])
        df = df.withColumn(tables.PREFIX, tables.hash_prefix(key)).persist()
        try:
            try:
                stored = spark.read.parquet(stored_root)
            except AnalysisException:  # nothing stored yet
                fresh = df
            else:
                # a replay must not see its own rows
                stored = stored.filter((F.col("writer") != writer) | (F.col("batch_id") != batch_id))
                near = tables.stored_keys_near(stored, df, key)
                fresh = df.join(near, key, "left_anti")
            # A task writes a key range, so a batch has about as many files as tasks and prefixes, not their product.
            spread = fresh.repartitionByRange(tables.PREFIX, key).sortWithinPartitions(tables.PREFIX, key)
            write_batch_folder(spread, stored_root, batch_id, [tables.PREFIX], writer)
        finally:
            df.unpersist()

    return run


def stored_once(spark: SparkSession, stored_root: str, key: str = "hash_id", order: Sequence[str] = ()) -> DataFrame:
    """The store of ``insert_new_batch`` with one row per key: the first by
    ``order``, then by writer and batch."""
    stored = spark.read.parquet(stored_root)
    order = [*order, "writer", "batch_id"]
    carry = [c for c in stored.columns if c not in (key, tables.PREFIX, *order)]
    return documents.keep_first(stored, key, order, carry).drop("writer", "batch_id")
