"""Wear sessions keep the state of many persons under a bounded number of keys."""

import datetime as dt

from glucoframe.streaming import streams as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_state_keys_are_bounded_and_persons_stay_apart(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda p, m, v: (0, start + dt.timedelta(minutes=m), p, "view", v, None)
    # 0 and null share a bucket's records; neighbours beyond 2^53 are no longer apart as doubles
    persons = [None, *range(200), 2**53, 2**53 + 1, -5]
    rows = []
    for i, p in enumerate(persons):
        rows += [at(p, 10 + i % 7, 65.0), at(p, i % 7, 70.0), at(p, 45 + i % 7, 90.0), at(p, 20 + i % 7, None), at(p, 300, 60.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out, q = T.run_available_now(T.stream_wear_sessions(T.event_stream(spark, str(tmp_path)), buckets=4), "wear-buckets", sink="batches")
    end = lambda m: start + dt.timedelta(minutes=m)
    want = sorted([(str(p), end(i % 7), end(40 + i % 7), 2, 67.5, 2) for i, p in enumerate(persons)]
                  + [(str(p), end(45 + i % 7), end(75 + i % 7), 1, 90.0, 0) for i, p in enumerate(persons)])
    assert sorted((str(r.person), r.start, r.end, r.n, r.mean_value, r.n_low) for r in out.collect()) == want
    # one value and one timer (kept by key and by time) per bucket
    assert 0 < max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 4 * 3
