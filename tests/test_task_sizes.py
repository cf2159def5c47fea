"""Rows that multiply after a shuffle are dealt to tasks by their number, not by the bytes shuffled."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from glucoframe.sources import bindings as B


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """400 persons with five readings and a meal each, in four blocks of three hours, on one day."""
    path = str(tmp_path_factory.mktemp("events"))
    minute = F.col("id") % 6 * 95 + 310
    spark.range(2400).coalesce(1).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).alias("ts"),
        (F.col("id") / 6).cast("long").alias("user_id"), F.when(F.col("id") % 6 == 2, "purchase").otherwise("view").alias("event_type"),
        (F.col("id") % 97 + 60).cast("double").alias("value"), F.lit("").alias("props")).write.parquet(f"{path}/events.parquet")
    return path


def _by_partition(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("name", ["attention_received", "mean_in_segment_weights"])
def test_tasks_hold_a_bounded_number_of_events(spark, folder, monkeypatch, name):
    whole = sorted(map(tuple, E.queries()[name](spark, folder).collect()))
    monkeypatch.setattr(B, "EVENTS_PER_TASK", 100)
    df = E.queries()[name](spark, folder)
    assert sorted(map(tuple, df.collect())) == whole
    sizes = _by_partition(df)
    # 24 parts; three times the even share leaves room for the hash
    assert sum(sizes) == len(whole) and max(sizes) <= 3 * len(whole) / 24


def test_month_series_lie_in_bounded_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(B, "EVENTS_PER_TASK", 100)
    df = B.month_series(spark, folder)
    sizes = _by_partition(df)
    assert sum(sizes) == df.count() == 1600 and max(sizes) <= 3 * 1600 / 24
    assert df.select("sample_id", F.spark_partition_id()).distinct().count() == 400
