"""Change streams (ST1-ST5): file-stream source, availableNow, checkpoints."""

import json
import os

from regiflow import schemas
from regiflow.operators import versions
from regiflow.streaming import changes


def event(i, krs, ts, op="c", raw=None):
    after = {"id": i, "record_created_at": ts, "is_current": True, "krs_number": krs,
             "raw_data": raw or json.dumps({"odpis": {"rodzaj": "Pełny", "n": i}})}
    return {"key": krs, "value": json.dumps({"before": None, "after": after, "op": op, "ts_ms": i})}


BATCHES = [
    [event(1, "0000057814", "2025-01-01T10:00:00Z"), event(2, "0000000001", "2025-01-01T10:00:00Z")],
    [event(3, "0000057814", "2025-01-02T10:00:00Z"), event(4, "0000000001", "2025-01-01T10:00:00Z"),
     {"key": "0000000001", "value": None},                                  # tombstone
     event(9, "0000057814", "2025-01-09T10:00:00Z", op="u", raw="__debezium_unavailable_value")],
    [event(5, "0000057814", "2025-01-01T09:00:00Z"),                       # late, older version
     {"key": "x", "value": "{not json"},                                   # malformed
     event(3, "0000057814", "2025-01-02T10:00:00Z")],                      # same event twice
]


def write_batches(root, batches):
    os.makedirs(root, exist_ok=True)
    for n, rows in enumerate(batches):
        with open(os.path.join(root, f"part-{n:03d}.json"), "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")


def source(spark, root):
    return spark.readStream.schema(schemas.CHANGE_EVENTS).option("maxFilesPerTrigger", 1).json(root)


def batch_answer(spark, root):
    rows = changes.parse_changes(spark.read.schema(schemas.CHANGE_EVENTS).json(root)).dropDuplicates(["id"])
    return {(r.krs_number, r.id) for r in
            versions.current_rows(rows, "krs_number", ["record_created_at", "id"]).collect()}


def test_stream_equals_batch_over_several_batches(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES)
    q = changes.stream_versions_to_history(source(spark, src), f"{tmp_root}/hist", f"{tmp_root}/ptr",
                                           name="t_multi", checkpoint=f"{tmp_root}/ckpt")
    assert q.lastProgress is not None
    cur = {(r.krs_number, r.id) for r in changes.current_from_pointers(spark, f"{tmp_root}/ptr").collect()}
    assert cur == batch_answer(spark, src) == {("0000057814", 3), ("0000000001", 4)}
    hist = spark.read.parquet(f"{tmp_root}/hist")
    assert hist.select("batch_id").distinct().count() == 3          # one folder per micro-batch
    assert sorted(r.id for r in hist.collect()) == [1, 2, 3, 3, 4, 5]   # u event and tombstone dropped


def test_restart_processes_only_new_files(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES[:2])
    args = (f"{tmp_root}/hist", f"{tmp_root}/ptr")
    changes.stream_versions_to_history(source(spark, src), *args, name="t_restart", checkpoint=f"{tmp_root}/ckpt")
    n1 = spark.read.parquet(f"{tmp_root}/hist").count()
    changes.stream_versions_to_history(source(spark, src), *args, name="t_restart", checkpoint=f"{tmp_root}/ckpt")
    assert spark.read.parquet(f"{tmp_root}/hist").count() == n1      # nothing new: nothing written
    with open(os.path.join(src, "part-009.json"), "w") as f:
        f.write(json.dumps(event(7, "0000000001", "2025-02-01T00:00:00Z")) + "\n")
    changes.stream_versions_to_history(source(spark, src), *args, name="t_restart", checkpoint=f"{tmp_root}/ckpt")
    assert spark.read.parquet(f"{tmp_root}/hist").count() == n1 + 1
    cur = {(r.krs_number, r.id) for r in changes.current_from_pointers(spark, f"{tmp_root}/ptr").collect()}
    assert ("0000000001", 7) in cur


def test_replayed_batch_writes_the_same_folder(spark, tmp_root):
    raw = spark.createDataFrame(BATCHES[0], schemas.CHANGE_EVENTS)
    rows = changes.parse_changes(raw)
    for _ in range(2):
        changes.write_batch_folder(rows, f"{tmp_root}/hist", 0, writer="w")
    assert spark.read.parquet(f"{tmp_root}/hist").count() == 2


def test_quarantine_reasons(spark):
    raw = spark.createDataFrame([r for b in BATCHES for r in b], schemas.CHANGE_EVENTS)
    got = sorted(r.reason for r in changes.change_quarantine(raw).collect())
    assert got == ["malformed", "op_u", "tombstone"]


def test_stateful_latest_equals_batch(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES)
    agg = changes.latest_pointers(changes.parse_changes(source(spark, src)))
    q = (agg.writeStream.outputMode("update").format("memory").queryName("t_latest")
         .option("checkpointLocation", f"{tmp_root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    mem = spark.table("t_latest")
    last = versions.current_rows(mem, "krs_number", ["record_created_at", "id"])
    assert {(r.krs_number, r.id) for r in last.collect()} == batch_answer(spark, src)


def test_keep_first_dedup_stream(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    os.makedirs(src)
    for n, hashes in enumerate([["a", "b"], ["b", "c"], ["a", "d", "d"]]):
        with open(os.path.join(src, f"f{n}.json"), "w") as f:
            for h in hashes:
                f.write(json.dumps({"hash_id": h, "n": n}) + "\n")
    stream = spark.readStream.schema("hash_id string, n long").option("maxFilesPerTrigger", 1).json(src)
    changes.run_available_now(changes.dedup_stream(stream), changes.insert_new_batch(f"{tmp_root}/stored"),
                              "t_dedup", f"{tmp_root}/ckpt")
    stored = spark.read.parquet(f"{tmp_root}/stored")
    assert sorted((r.hash_id, r.n) for r in stored.collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_flatten_company_in_foreach_batch(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES[:1])

    def sink(df, batch_id):
        changes.write_batch_folder(changes.flatten_company(changes.parse_changes(df)), f"{tmp_root}/out", batch_id)

    changes.run_available_now(source(spark, src), sink, "t_flat", f"{tmp_root}/ckpt")
    out = spark.read.parquet(f"{tmp_root}/out")
    assert out.count() == 2 and set(out.columns) >= {"full_name", "county", "extract_kind"}
    assert {r.extract_kind for r in out.collect()} == {"Pełny"}


def test_change_times_are_utc_whatever_the_session_zone(spark):
    import datetime as dt

    raw = spark.createDataFrame([event(1, "0000057814", "2025-03-30T01:30:00Z"),
                                 event(2, "0000057814", "2025-03-30T03:30:00+02:00")], schemas.CHANGE_EVENTS)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Warsaw", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.record_created_at for r in changes.parse_changes(raw).orderBy("id").collect()]
            assert got == [dt.datetime(2025, 3, 30, 1, 30), dt.datetime(2025, 3, 30, 1, 30)], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_default_checkpoint_is_stable(spark):
    from regiflow.session import checkpoint_root, stream_checkpoint_path

    a = stream_checkpoint_path(spark, "raw_extract_changes")
    assert a == stream_checkpoint_path(spark, "raw_extract_changes")
    assert a.startswith(checkpoint_root(spark))


def test_compacted_pointers_equal_full_read(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES[:2])
    args = (f"{tmp_root}/hist", f"{tmp_root}/ptr")
    changes.stream_versions_to_history(source(spark, src), *args, name="t_compact", checkpoint=f"{tmp_root}/ckpt")
    assert changes.compact_pointers(spark, f"{tmp_root}/ptr", f"{tmp_root}/snap") == 1
    files = changes.tables.read_snapshot(spark, f"{tmp_root}/snap").inputFiles()
    assert changes.compact_pointers(spark, f"{tmp_root}/ptr", f"{tmp_root}/snap") == 1          # no new batch: the files stay
    assert changes.tables.read_snapshot(spark, f"{tmp_root}/snap").inputFiles() == files
    with open(os.path.join(src, "part-009.json"), "w") as f:
        f.write(json.dumps(event(8, "0000057814", "2025-03-01T00:00:00Z")) + "\n")
    changes.stream_versions_to_history(source(spark, src), *args, name="t_compact", checkpoint=f"{tmp_root}/ckpt")
    full = {(r.krs_number, r.id) for r in changes.current_from_pointers(spark, f"{tmp_root}/ptr").collect()}
    quick = {(r.krs_number, r.id) for r in
             changes.current_from_pointers(spark, f"{tmp_root}/ptr", f"{tmp_root}/snap").collect()}
    assert quick == full == {("0000057814", 8), ("0000000001", 4)}


def test_current_versions_join_documents_back(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES)
    changes.stream_versions_to_history(source(spark, src), f"{tmp_root}/hist", f"{tmp_root}/ptr",
                                       name="t_docs", checkpoint=f"{tmp_root}/ckpt")
    cur = changes.current_versions(spark, f"{tmp_root}/hist", f"{tmp_root}/ptr").collect()
    # id 3 arrived twice (a repeated event): one row per company all the same
    assert sorted((r.krs_number, r.id) for r in cur) == [("0000000001", 4), ("0000057814", 3)]
    assert all(json.loads(r.raw_data)["odpis"]["n"] == r.id for r in cur)


def test_a_second_writer_or_new_checkpoint_loses_nothing(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES)
    for ckpt in ("a", "b"):
        changes.stream_versions_to_history(source(spark, src), f"{tmp_root}/hist", f"{tmp_root}/ptr",
                                           name=f"t_writer_{ckpt}", checkpoint=f"{tmp_root}/{ckpt}")
    hist = spark.read.parquet(f"{tmp_root}/hist")
    assert hist.select("writer").distinct().count() == 2
    assert sorted(r.id for r in hist.collect()) == sorted([1, 2, 3, 3, 4, 5] * 2)
    once = versions.unique_versions(hist)
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4, 5]
    assert versions.mark_current(once, "krs_number", ["record_created_at", "id"]).filter("is_current").count() == 2
    assert changes.current_versions(spark, f"{tmp_root}/hist", f"{tmp_root}/ptr").count() == 2
    assert changes.compact_pointers(spark, f"{tmp_root}/ptr", f"{tmp_root}/snap") == 5
    cur = changes.current_from_pointers(spark, f"{tmp_root}/ptr", f"{tmp_root}/snap")
    assert {(r.krs_number, r.id) for r in cur.collect()} == {("0000057814", 3), ("0000000001", 4)}


def test_times_as_epochs_and_unreadable_times(spark):
    import datetime as dt

    raw = spark.createDataFrame([event(1, "0000057814", "1735725600000"), event(2, "0000057814", "1735725600"),
                                 event(3, "0000057814", "1735725600000000"), event(4, "0000057814", "yesterday"),
                                 event(5, "0000057814", None), event(None, "0000057814", "2025-01-01T10:00:00Z")], schemas.CHANGE_EVENTS)
    got = changes.parse_changes(raw).orderBy("id").collect()
    assert [(r.id, r.record_created_at) for r in got] == [(i, dt.datetime(2025, 1, 1, 10)) for i in (1, 2, 3)]
    assert sorted(r.reason for r in changes.change_quarantine(raw).collect()) == ["bad_time", "bad_time", "no_key"]


def test_rejects_are_written_beside_the_history(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    write_batches(src, BATCHES)
    changes.stream_versions_to_history(source(spark, src), f"{tmp_root}/hist", f"{tmp_root}/ptr", name="t_rej", checkpoint=f"{tmp_root}/c")
    events = spark.read.schema(schemas.CHANGE_EVENTS).json(src).count()
    rejects = spark.read.parquet(f"{tmp_root}/hist_rejects")
    assert sorted(r.reason for r in rejects.collect()) == ["malformed", "op_u", "tombstone"]
    assert events == rejects.count() + spark.read.parquet(f"{tmp_root}/hist").count()


def test_keep_first_inside_one_batch(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    os.makedirs(src)
    with open(os.path.join(src, "f.json"), "w") as f:
        for h, n in (("bb", 2), ("bb", 1), ("aa", 5)):
            f.write(json.dumps({"hash_id": h, "n": n}) + "\n")
    stream = spark.readStream.schema("hash_id string, n long").json(src)
    for ckpt in ("x", "y"):
        changes.run_available_now(stream, changes.insert_new_batch(f"{tmp_root}/stored", order=["n"]), f"t_first_{ckpt}", f"{tmp_root}/{ckpt}")
    assert sorted((r.hash_id, r.n) for r in spark.read.parquet(f"{tmp_root}/stored").collect()) == [("aa", 5), ("bb", 1)]
    assert changes.stored_once(spark, f"{tmp_root}/stored", order=["n"]).count() == 2
