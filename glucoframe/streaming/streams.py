"""Structured Streaming twins of batch operators.

Streams read a file source (new parquet files of readings events), keep event
time as TIMESTAMP with a watermark, and write with append mode to parquet below a folder that the
caller names, with the checkpoint beside it: a query that is started again goes on where it ended
or died. State lies in RocksDB, never in driver memory. In append mode
a window is emitted once the watermark passes its end, so at any time the
sink holds exactly the closed windows; rows later than the watermark are
dropped by Spark and counted in the query progress (``late_rows``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glucoframe.functions.glucose import HIGH, LOW, encode_value, slot_of
from glucoframe.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of ``<sf_dir>/<name>*.parquet``; ts becomes an event-time TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("basePath", sf_dir)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(f"{sf_dir}/{name}*.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


#: state in RocksDB on the executor's disk and snapshots in the checkpoint, not on the JVM heap
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start here keep their state in RocksDB (a query's checkpoint remembers it)."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each micro-batch is one folder named by its id, and one that is
    delivered again (the query died before it was committed) replaces its folder as a whole."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def start(df: DataFrame, root: str, sink: str = "files") -> StreamingQuery:
    """Start (or go on with) the query whose checkpoint and output lie below ``root``: everything
    available, then end. ``sink``: "files" (Spark's own file sink, which logs what is committed)
    or "batches" (:func:`write_batch`); both leave every row once."""
    with rocksdb_state(df.sparkSession):
        w = df.writeStream.outputMode("append").option("checkpointLocation", f"{root}/chk").trigger(availableNow=True)
        if sink == "batches":
            return w.foreachBatch(write_batch(f"{root}/data")).start()
        return w.format("parquet").option("path", f"{root}/data").start()


def output(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """What the query below ``root`` has put out so far."""
    if not exists(spark, f"{root}/data"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{root}/data")
    return rows.select(*[f.name for f in schema.fields])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_available_now(df: DataFrame, name: str, root: str | None = None, sink: str = "files") -> tuple[DataFrame, StreamingQuery]:
    """Process everything available and return (batch view of the output, finished query).

    With ``root``, a folder that all executors share, the query can be called again and goes on
    where it ended, or died; without it a folder of this run is made in the checkpoint folder."""
    spark = df.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    q = start(df, root, sink)
    q.awaitTermination()
    return output(spark, root, df.schema), q


def late_rows(q: StreamingQuery) -> int:
    """Rows dropped as later than the watermark, summed over the query's progress.

    Spark counts them where they reach the stateful operator, i.e. after the
    map-side partial aggregation (several late readings of one group in one
    micro-batch count once)."""
    n = 0
    for p in q.recentProgress:
        for op in p.get("stateOperators", []):
            n += int(op.get("numRowsDroppedByWatermark", 0))
    return n


# ---- T1-T5 -----------------------------------------------------------------------------------
def stream_encode(stream: DataFrame) -> DataFrame:
    """Stateless encoding of a reading stream (E1 + E3 + E4)."""
    return stream.select("event_id", F.col("user_id").alias("person"), slot_of("ts").alias("slot"),
                         encode_value("value").alias("token"))


def stream_band_shares(stream: DataFrame, day: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Band counts per person and day (tumbling window), emitted when the day closes."""
    v = F.col("value")
    g = (stream.withWatermark("ts", watermark)
         .groupBy(F.col("user_id").alias("person"), F.window("ts", day).alias("w"))
         .agg(F.count_if(v < LOW).alias("n_low"), F.count_if((v >= LOW) & (v < HIGH)).alias("n_in_range"),
              F.count_if(v >= HIGH).alias("n_high"), F.count("*").alias("n")))
    return g.select("person", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                    "n_low", "n_in_range", "n_high", "n")


def stream_rolling_low(stream: DataFrame, window: str = "1 hour", slide: str = "30 minutes",
                       watermark: str = "1 hour") -> DataFrame:
    """Share of readings <= 70 per person in sliding windows (A2's share, rolling)."""
    g = (stream.withWatermark("ts", watermark)
         .groupBy(F.col("user_id").alias("person"), F.window("ts", window, slide).alias("w"))
         .agg(F.count("*").alias("n"), F.avg((F.col("value") <= LOW).cast("double")).alias("low_share")))
    return g.select("person", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low_share")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """T4: wear periods: readings closer than ``gap`` form one session (session window)."""
    g = (stream.withWatermark("ts", watermark)
         .groupBy(F.col("user_id").alias("person"), F.session_window("ts", gap).alias("s"))
         .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))
    return g.select("person", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "mean_value")


#: an open wear period in the state: its person (0 and ``nobody`` for null), times in microseconds
SESSION = np.dtype([("nobody", "?"), ("person", "i8"), ("first", "i8"), ("last", "i8"), ("n", "i8"), ("total", "f8"), ("low", "i8")])


class WearSessions(StatefulProcessor):
    """Open wear periods of the persons of one bucket, held as state until the watermark passes their end.

    Readings are folded into sessions a batch at a time; what is kept is one small record per open
    session, however many readings it has, all of a bucket packed into one state value: each call
    for state or timers costs milliseconds, so there are a few per bucket and none per person. An
    event-time timer at the bucket's next end emits what is due."""

    STATE = "sessions binary"
    OUT = "person long, start timestamp, end timestamp, n long, mean_value double, n_low long"

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.STATE)

    def _held(self) -> np.ndarray:
        value = self.open.get()
        return np.frombuffer(bytes(value[0]) if value else b"", SESSION)

    def _folded(self, parts: list[np.ndarray]) -> np.ndarray:
        """Sessions of a person that touch become one."""
        s = np.concatenate(parts)
        s = s[np.lexsort((s["first"], s["person"], s["nobody"]))]
        other = np.r_[True, (s["person"][1:] != s["person"][:-1]) | (s["nobody"][1:] != s["nobody"][:-1])]
        reach = pd.Series(s["last"]).groupby(np.cumsum(other)).cummax().to_numpy()
        at = np.flatnonzero(other | np.r_[True, s["first"][1:] >= reach[:-1] + self.gap_us])
        out = s[at]
        out["last"] = np.maximum.reduceat(s["last"], at)
        for k in ("n", "total", "low"):
            out[k] = np.add.reduceat(s[k], at)
        return out

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        sessions, touched = held, False
        for pdf in rows:
            # null readings are no wear
            pdf = pdf[pdf["value"].notna()]
            if len(pdf):
                new = np.zeros(len(pdf), SESSION)
                for k, c in (("nobody", "nobody"), ("person", "person"), ("first", "us"), ("last", "us"), ("total", "value")):
                    new[k] = pdf[c].to_numpy()
                new["n"], new["low"] = 1, new["total"] <= LOW
                sessions, touched = self._folded([sessions, new]), True
        if touched:
            self.open.update((sessions.tobytes(),))
            # one timer at a time: the next end
            before, due = self._next(held), self._next(sessions)
            if before != due:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due)
        return
        yield  # a generator without rows

    def _due(self, last):
        return -(-(last + self.gap_us) // 1000)  # milliseconds, not before the end

    def _next(self, sessions: np.ndarray) -> int | None:
        return int(self._due(sessions["last"].min())) if len(sessions) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        ended = self._due(held["last"]) <= timerValues.getCurrentWatermarkInMs()
        done, left = held[ended], held[~ended]
        if len(left):
            self.open.update((left.tobytes(),))
            self.handle.registerTimer(self._next(left))
        else:
            self.open.clear()
        if len(done):
            yield pd.DataFrame({"person": pd.array(done["person"], "Int64"), "start": pd.to_datetime(done["first"], unit="us"),
                                "end": pd.to_datetime(done["last"] + self.gap_us, unit="us"), "n": done["n"],
                                "mean_value": done["total"] / done["n"], "n_low": done["low"]}).assign(
                person=lambda d: d["person"].mask(done["nobody"]))

    def close(self) -> None:
        pass


def stream_wear_sessions(stream: DataFrame, gap_minutes: int = 30, watermark: str = "1 hour", buckets: int = 2048) -> DataFrame:
    """T4 with state of its own: wear periods with their number of low readings, each put out once,
    when the watermark passes its end. Null readings do not count as wear.

    State is keyed by ``buckets`` of persons (by hash), so a micro-batch makes a bounded number of
    state calls, however many persons it holds; a query keeps its number of buckets for life."""
    person = F.col("user_id")
    rows = (stream.withWatermark("ts", watermark)
            .select(F.pmod(F.xxhash64(person), F.lit(buckets)).cast("int").alias("bucket"), person.isNull().alias("nobody"),
                    F.coalesce(person, F.lit(0)).cast("long").alias("person"), "ts", F.unix_micros("ts").alias("us"), "value"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        WearSessions(gap_minutes * 60 * 1_000_000), WearSessions.OUT, "append", "EventTime")


def stream_meal_features(meals: DataFrame, readings: DataFrame, before: str = "20 minutes",
                         after: str = "40 minutes", watermark: str = "1 hour", block: str = "2 hours") -> DataFrame:
    """T5: readings of the same person from ``before`` a meal to ``after`` it
    (stream-stream interval join; the watermarks on both sides bound the join state).

    State is keyed by person and time block, so a very active person's state is spread over the
    partitions: a meal lies in one block, a reading is handed to every block (two at most, if a
    block is as long as ``before`` and ``after`` together) in which a meal could meet it.
    """
    span = F.expr(f"INTERVAL {block}")
    number = lambda ts: F.floor(F.unix_micros(ts) / F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + span))
    m = meals.select(F.col("event_id").alias("meal_id"), F.col("user_id").alias("m_person"),
                     F.col("ts").alias("m_ts"), number(F.col("ts")).alias("m_block")).withWatermark("m_ts", watermark)
    r = readings.select(F.col("event_id").alias("reading_id"), F.col("user_id").alias("r_person"),
                        F.col("ts").alias("r_ts"), "value",
                        F.explode(F.sequence(number(F.col("ts") - F.expr(f"INTERVAL {after}")),
                                             number(F.col("ts") + F.expr(f"INTERVAL {before}")))).alias("r_block")).withWatermark("r_ts", watermark)
    cond = ((F.col("m_person") == F.col("r_person")) & (F.col("m_block") == F.col("r_block"))
            & (F.col("r_ts") >= F.col("m_ts") - F.expr(f"INTERVAL {before}"))
            & (F.col("r_ts") <= F.col("m_ts") + F.expr(f"INTERVAL {after}")))
    j = m.join(r, cond, "inner")
    return j.select("meal_id", F.col("m_person").alias("person"), "reading_id", "value",
                    ((F.col("r_ts").cast("double") - F.col("m_ts").cast("double")) / 60.0).alias("offset_min"))
