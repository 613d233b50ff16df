"""The change-log source (S3): order, growth, ranges; and accounts of a stream."""

import json
import os
import random

import pytest

from regiflow.functions import accounting
from regiflow.sources.change_log import ChangeLogReader, change_log
from regiflow.streaming import changes


def write(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def lines_of(reader, start, end):
    return [line.rstrip("\n") for p in reader.partitions(start, end) for b in reader.read(p) for line in b.column(0).to_pylist()]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once_whatever_the_ranges(tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    want = []
    for n in range(5):
        own = [f"{n}-{i} " + "ż" * rng.randrange(30) for i in range(rng.randrange(1, 25))]
        write(str(tmp_path / f"{n:03d}.jsonl"), ("\n".join(own) + "\n" * rng.randrange(1, 3)).encode())
        want += own
    write(str(tmp_path / "_SUCCESS"), b"")
    write(str(tmp_path / ".hidden"), b"no\n")
    reader = ChangeLogReader(f"file://{tmp_path}", range_bytes)
    assert lines_of(reader, reader.initialOffset(), reader.latestOffset()) == want


def test_a_stream_resumes_inside_a_file(tmp_path):
    reader = ChangeLogReader(f"file://{tmp_path}", 16)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    log = str(tmp_path / "a.jsonl")
    write(log, b"one\ntwo\nthr")
    first = reader.latestOffset()
    assert lines_of(reader, reader.initialOffset(), first) == ["one", "two"] and first == {"file": "a.jsonl", "byte": 8}
    write(log, b"ee\nfour\n", "ab")
    write(str(tmp_path / "b.jsonl"), b"unfinished")
    second = reader.latestOffset()
    assert lines_of(reader, first, second) == ["three", "four"]
    write(str(tmp_path / "b.jsonl"), b" no more\nlast\n", "ab")
    assert lines_of(reader, second, reader.latestOffset()) == ["unfinished no more", "last"]
    assert lines_of(reader, reader.latestOffset(), reader.latestOffset()) == []


def event(i, op="c", at="2025-01-01T00:00:00Z"):
    after = {"id": i, "record_created_at": at, "krs_number": f"{i % 3:010d}", "raw_data": "{}"}
    return {"key": "k", "value": json.dumps({"after": after, "op": op, "ts_ms": i})}


def test_log_through_the_stream_with_accounts(spark, tmp_root):
    """Started three times on one growing file; every event is a version or
    rejected, and the account says so."""
    log = f"{tmp_root}/log/topic.jsonl"
    shares = [[event(1), event(2), {"key": "k", "value": None}], [event(3, "u"), event(4, at="?"), {"key": "k", "value": "{}"}],
              [event(5), event(6)]]
    for n, share in enumerate(shares):
        text = "".join(json.dumps(e) + "\n" for e in share) + ("not json\n" if n == 1 else "")
        write(log, text.encode(), "ab")
        changes.stream_versions_to_history(change_log(spark, f"{tmp_root}/log", range_bytes=100), f"{tmp_root}/history",
                                           f"{tmp_root}/pointers", "t_log", f"{tmp_root}/ckpt")
    history = spark.read.parquet(f"{tmp_root}/history")
    assert sorted((r.batch_id, r.id) for r in history.collect()) == [(0, 1), (0, 2), (2, 5), (2, 6)]
    rows = spark.read.parquet(f"{tmp_root}/history_accounts").collect()
    said = {(r.batch_id, r.outcome): r.n_rows for r in rows if r.n_rows}
    assert said == {(0, "in"): 3, (0, "out"): 2, (0, "tombstone"): 1, (1, "in"): 4, (1, "op_*"): 1, (1, "bad_time"): 1, (1, "malformed"): 2,
                    (2, "in"): 2, (2, "out"): 2}


def test_an_account_that_does_not_add_up_is_an_error(spark):
    df = spark.createDataFrame([("a",), (None,), ("new",)], "reason string")
    counted, seen = accounting.accounted(df, ["a"])
    counted.collect()
    with pytest.raises(RuntimeError, match="rows in"):
        accounting.account_of(seen)
    counted, seen = accounting.accounted(df, ["a", "n*"])
    counted.collect()
    assert accounting.account_of(seen) == [("in", 3), ("out", 1), ("a", 1), ("n*", 1)]
