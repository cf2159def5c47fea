"""Streaming twins: windows close with the watermark, late rows are dropped and counted."""

import datetime as dt
import tempfile
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from glucoframe.session import ensure_checkpoint_dir
from glucoframe.streaming import streams as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_late_rows_dropped_and_counted(spark):
    folder = tempfile.mkdtemp(prefix="stream-src-")
    day = dt.datetime(2024, 1, 1)
    first = [(i, day + dt.timedelta(minutes=10 * i), 1, "view", 60.0 + i, None) for i in range(300)]
    _write(spark, folder, first, "events")
    root = f"{ensure_checkpoint_dir(spark)}/streams/test-{uuid.uuid4().hex}"

    def run():
        s = T.stream_band_shares(T.event_stream(spark, folder))
        q = (s.writeStream.format("parquet").outputMode("append").option("path", f"{root}/data")
             .option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    q1 = run()
    out1 = {(r.start, r.n) for r in spark.read.parquet(f"{root}/data").collect()}
    # 300 readings every 10 minutes span Jan 1 00:00 .. Jan 3 01:50; days 1 and 2 are closed
    assert {n for _, n in out1} == {144}
    assert len(out1) == 2
    # a second file arrives with readings from the first day: behind the watermark
    late = [(1000 + i, day + dt.timedelta(minutes=5 + 10 * i), 1, "view", 50.0, None) for i in range(5)]
    _write(spark, folder, late, "events_late")
    q2 = run()
    out2 = {(r.start, r.n) for r in spark.read.parquet(f"{root}/data").collect()}
    assert out2 == out1                      # closed days are not reopened
    # the late rows are dropped and counted; Spark counts them at the state store,
    # after the map-side partial aggregation (here the 5 readings form 1 partial row)
    assert T.late_rows(q2) >= 1


def test_stream_encode_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="stream-src-")
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=7 * i), i % 3, "view", 30.0 + 3 * i, None) for i in range(100)]
    _write(spark, folder, rows, "events")
    out, _ = T.run_available_now(T.stream_encode(T.event_stream(spark, folder)), "enc-test")
    from glucoframe.functions.glucose import encode_value
    batch = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", encode_value("value").alias("token"))
    assert sorted((r.event_id, r.token) for r in out.collect()) == sorted(tuple(r) for r in batch.collect())


def _days(first, n, person, value=60.0, step=10):
    day = dt.datetime(2024, 1, 1) + dt.timedelta(days=first)
    return [(100_000 * person + 1000 * first + i, day + dt.timedelta(minutes=step * i), person, "view", value + i % 50, None) for i in range(n)]


def _dies_after_writing(monkeypatch):
    """The next query writes its first micro-batch and dies before it is committed."""
    plain = T.write_batch

    def deadly(path):
        write = plain(path)

        def run(rows, batch):
            write(rows, batch)
            raise RuntimeError("lost")
        return run
    monkeypatch.setattr(T, "write_batch", deadly)
    return lambda: monkeypatch.setattr(T, "write_batch", plain)


@pytest.mark.parametrize("sink", ["files", "batches"])
def test_a_stream_goes_on_where_it_ended(spark, tmp_path, monkeypatch, sink):
    folder, root = str(tmp_path), f"{ensure_checkpoint_dir(spark)}/streams/resume-{uuid.uuid4().hex}"
    stream = lambda: T.stream_band_shares(T.event_stream(spark, folder))
    _write(spark, folder, _days(0, 300, 1) + _days(0, 300, 2), "events")
    out, _ = T.run_available_now(stream(), "bands", root, sink)
    assert sorted((r.person, r.start.day, r.n) for r in out.collect()) == [(p, d, 144) for p in (1, 2) for d in (1, 2)]
    again, _ = T.run_available_now(stream(), "bands", root, sink)  # nothing new
    assert again.count() == 4
    _write(spark, folder, _days(2, 300, 1) + _days(3, 200, 3), "events_2")
    if sink == "batches":
        heal = _dies_after_writing(monkeypatch)
        with pytest.raises(StreamingQueryException):
            T.run_available_now(stream(), "bands", root, sink)
        heal()
    out, _ = T.run_available_now(stream(), "bands", root, sink)
    got = sorted((r.person, r.start.day, r.n) for r in out.collect())
    assert len(got) == len(set(got))
    # the watermark (Jan 5 02:00 less an hour) closes Jan 3 and 4; person 2's start of Jan 3 came before
    assert got == sorted([(p, d, 144) for p in (1, 2) for d in (1, 2)] + [(1, 3, 144 + 12), (2, 3, 12), (1, 4, 144), (3, 4, 144)])


def _sessions(rows, gap=30):
    out, by = [], {}
    for _, ts, person, _, value, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if value is None:
            continue
        open_ = by.get(person)
        if open_ and ts < open_[1] + dt.timedelta(minutes=gap):
            open_[1], open_[2] = ts, open_[2] + [value]
        else:
            by[person] = [ts, ts, [value]]
            out.append((person, by[person]))
    return sorted((p, s[0], s[1] + dt.timedelta(minutes=gap), len(s[2]), sum(v <= 70 for v in s[2])) for p, s in out)


def test_wear_sessions_survive_a_death_and_a_late_reading(spark, tmp_path, monkeypatch):
    folder, root = str(tmp_path), f"{ensure_checkpoint_dir(spark)}/streams/wear-{uuid.uuid4().hex}"
    stream = lambda: T.stream_wear_sessions(T.event_stream(spark, folder))
    at = lambda m, p, i, v=60.0: (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), p, "view", v, None)
    # out of order, ties, a gap of exactly 30 minutes, null values, two sessions that a reading in the second file joins
    first = [at(20, 1, 1), at(0, 1, 2, 80.0), at(20, 1, 3), at(50, 1, 4), at(200, 1, 5), at(240, 1, 6), at(205, 1, 7, None), at(210, 2, 8), at(0, 3, 9, None)]
    _write(spark, folder, first, "events")
    out, _ = T.run_available_now(stream(), "wear", root, "batches")
    done = lambda o: sorted((r.person, r.start, r.end, r.n, r.n_low) for r in o.collect())
    closed = dt.datetime(2024, 1, 1, 3, 0)  # 240 minutes less an hour
    assert done(out) == [s for s in _sessions(first) if s[2] <= closed] and len(done(out)) == 2
    second = [at(225, 1, 10), at(212, 2, 11, 90.0), at(600, 2, 12)]
    _write(spark, folder, second, "events_2")
    heal = _dies_after_writing(monkeypatch)
    with pytest.raises(StreamingQueryException):
        T.run_available_now(stream(), "wear", root, "batches")
    heal()
    out, _ = T.run_available_now(stream(), "wear", root, "batches")
    want = [s for s in _sessions(first + second) if s[2] <= dt.datetime(2024, 1, 1, 9, 0)]
    assert done(out) == want and (1, dt.datetime(2024, 1, 1, 3, 20), dt.datetime(2024, 1, 1, 4, 30), 3, 3) in want
    assert T.run_available_now(stream(), "wear", root, "batches")[0].count() == len(want)


def test_meal_join_state_is_keyed_by_block(spark, tmp_path):
    folder = str(tmp_path)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=7 * i), i % 2, "purchase" if i % 5 == 0 else "view", float(i), None) for i in range(400)]
    _write(spark, folder, rows, "events")
    s = lambda kind: T.event_stream(spark, folder).filter((F.col("event_type") == "purchase") == kind)
    for block in ("1 hour", "3 hours"):
        out, _ = T.run_available_now(T.stream_meal_features(s(True), s(False), block=block), "meals")
        want = sorted((m[0], r[0]) for m in rows if m[3] == "purchase" for r in rows if r[3] != "purchase" and r[2] == m[2]
                      and dt.timedelta(minutes=-20) <= r[1] - m[1] <= dt.timedelta(minutes=40))
        assert sorted((r.meal_id, r.reading_id) for r in out.collect()) == want
