"""Logs that grow and rotate, exact upload batches, and a flush after a crash."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tarpit.operators.ids import with_batch_ids
from tarpit.operators.sessionize import emission_order, sessionize
from tarpit.sources import growing as G
from tarpit.sources.events import read_events, stream_events
from tarpit.streaming.batches import BatchQueue
from tarpit.streaming.sessionizer import SessionState, session_batch, stream_sessions


def line(k, kind="connect"):
    return json.dumps({"session": f"k{k}", "eventid": f"cowrie.session.{kind}", "timestamp": "2024-01-01T00:00:00Z"}) + "\n"


def add(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def run(spark, base, order="time", block=1 << 20):
    """One availableNow run; the session keys of the new events, in log order."""
    got = []

    def per_batch(batch, _):
        got.extend(r.session for r in batch.withColumn("row", F.monotonically_increasing_id()).orderBy("split", "row").collect())

    q = (G.stream_growing_events(spark, os.path.join(base, "log"), order, block).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return got


def test_appended_rotated_and_replaced_logs(spark, scratch):
    log = os.path.join(scratch, "log")
    os.makedirs(log)
    now = os.path.join(log, "events.json")
    add(now, line(1) + line(2) + line(3)[:20])  # the last line is still being written
    assert run(spark, scratch) == ["k1", "k2"]
    add(now, line(3)[20:] + "not json\n\n" + line(4))
    assert run(spark, scratch) == ["k3", "k4"]
    assert run(spark, scratch) == []
    add(now, line(5))
    os.rename(now, now + ".1")  # rotated with a line unread
    os.utime(now + ".1", (1, 1))
    add(now, line(6) + line(7))
    assert run(spark, scratch) == ["k5", "k6", "k7"]
    add(now, line(6) , "wb")  # shorter than what was read
    assert run(spark, scratch) == ["k6"]
    os.remove(now + ".1")
    add(os.path.join(log, ".hidden"), line(9))
    add(os.path.join(log, "empty.json"), "")
    add(os.path.join(log, "twin.json"), line(6))  # the same first line as another file
    assert run(spark, scratch) == ["k6"]


def test_byte_ranges_part_a_log_at_any_byte(spark, scratch):
    log = os.path.join(scratch, "log")
    os.makedirs(log)
    add(os.path.join(log, "a.json"), "".join(line(k) for k in range(40)))
    add(os.path.join(log, "b.json"), "".join(line(k) for k in range(40, 50)))
    whole = G.list_logs(log)
    assert sorted(v["bytes"] for v in whole.values()) == sorted(os.path.getsize(os.path.join(log, n)) for n in ("a.json", "b.json"))
    for block in (1, 7, 97, 5_000):
        reader = G.GrowingLogReader({"path": log, "blockbytes": str(block), "order": "path"})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [json.loads(x)["session"] for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
        assert got == [f"k{k}" for k in range(50)]
    assert run(spark, scratch, "path", 200) == [f"k{k}" for k in range(50)]
    with pytest.raises(ValueError):
        G.stream_growing_events(spark, log, "size")


def test_a_range_follows_a_renamed_log(scratch):
    log = os.path.join(scratch, "log")
    os.makedirs(log)
    add(os.path.join(log, "a.json"), (line(1) + "é\xff\n" + line(2)).encode("latin-1"))
    reader = G.GrowingLogReader({"path": log})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(os.path.join(log, "a.json"), os.path.join(log, "b.json"))
    add(os.path.join(log, "a.json"), line(3))
    assert [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == [line(1).strip(), "��", line(2).strip()]
    os.remove(os.path.join(log, "b.json"))
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))


def sessions_of(spark, scratch, n):
    path = os.path.join(scratch, f"in{n}")
    os.makedirs(path)
    add(os.path.join(path, "log.json"), "".join(line(k) + line(k, "closed") for k in range(n)) + line("open"))
    return sessionize(read_events(spark, path), seq="arrival", chunk="split", keep_order_cols=True)


def test_queue_releases_exact_batches_and_repeats_a_retry(spark, scratch):
    found = sessions_of(spark, scratch, 20)
    want = {(r.session, r.seg): (r.batch_id, r.session_id) for r in with_batch_ids(found, emission_order(), batch_size=6).collect()}
    queue = BatchQueue(spark, os.path.join(scratch, "queue"), 6)
    rows = sorted(found.collect(), key=lambda r: (not r.closed, r.last_seq if r.closed else r.first_seq))
    got, at = {}, 0
    for push, n in ((1, 4), (3, 0), (5, 1), (7, 13), (8, 3)):
        part = spark.createDataFrame(rows[at:at + n], found.schema)
        at += n
        out = [{(r.session, r.seg): (r.batch_id, r.session_id) for r in queue.push(part, push, last=push == 8).collect()} for _ in range(2)]
        assert out[0] == out[1] and (push == 8 or len(out[0]) % 6 == 0)
        got |= out[0]
    assert got == want
    assert len(os.listdir(os.path.join(scratch, "queue"))) <= 3
    after = queue.push(spark.createDataFrame(rows[:6], found.schema), 9).collect()
    assert {r.batch_id for r in after} == {4} and min(r.session_id for r in after) == "SESS-09807"
    with pytest.raises(ValueError):
        BatchQueue(spark, scratch, 0)


def test_open_sessions_are_flushed_after_a_crash(spark, scratch):
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    add(os.path.join(feed, "a.json"), line(1) + line(1, "closed") + line(2))
    ckpt, got = os.path.join(scratch, "ckpt"), []

    def sink(found, batch):
        got.append((batch, sorted((r.seg, r.closed) for r in found.collect())))

    def broken(found, batch):
        if batch % 2 == 0:
            raise RuntimeError("lost")
        sink(found, batch)

    with pytest.raises(RuntimeError):
        stream_sessions(stream_events(spark, feed), ckpt, broken)
    stream_sessions(stream_events(spark, feed), ckpt, sink)  # no new file
    stream_sessions(stream_events(spark, feed), ckpt, sink)
    assert got == [(1, [(0, True)]), (2, [(0, False)])]


def test_old_states_are_deleted(spark, scratch):
    path = os.path.join(scratch, "in")
    os.makedirs(path)
    add(os.path.join(path, "a.json"), line(1))
    state = SessionState(spark, os.path.join(scratch, "state"))
    for k in range(4):
        session_batch(read_events(spark, path).drop("arrival"), k, state)
    assert sorted(os.listdir(os.path.join(scratch, "state"))) == ["version=5", "version=7"]
