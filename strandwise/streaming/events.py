"""Streaming forms of the event operators. Late events beyond the watermark are dropped;
state is bounded by it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def traffic_series(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Views, approximate visitors and seconds per tumbling window."""
    view = F.col("event_type") == "view"
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width))
    sums = rows.agg(F.count_if(view).alias("views"), F.approx_count_distinct("user_id").alias("visitors"), F.sum(F.when(view, F.floor("value").cast("long")).otherwise(0)).alias("seconds"))
    return sums.select(F.col("window.start").alias("bucket"), "views", "visitors", "seconds")


def rate_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", limit: int = 10) -> DataFrame:
    """Calls per subject and fixed window, and how many of them are admitted."""
    rows = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("calls"))
    return rows.select("user_id", F.col("window.start").alias("bucket"), "calls", F.least("calls", F.lit(limit)).alias("admitted"))


def distinct_points(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """One event per id within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable | None = None) -> None:
    """Works off what is there, then stops: to Parquet, or to ``each(batch, id)``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


ADMISSIONS = "user_id long, window_end timestamp, event_id long, ts timestamp, admitted boolean"
#: A call in Python: its subject, then its place in order. Nulls are 0 behind a 0, as pandas
#: would make fractions of ids beside nulls.
_CALL = ["has_user", "user_id", "at", "has_event", "event_id"]
_SUBJECT = 2
#: Groups that the subjects of a window are dealt into.
GROUPS = 16


def _admit(limit: int):
    """Calls of a group of subjects in one window: kept are each subject's ``limit`` earliest
    so far, as no later call can be one of them once they are ``limit``; one that falls behind
    is turned away at once, the kept ones are admitted when the watermark has passed the
    window."""

    def run(key, frames, state):
        end = int(key[1])
        kept = np.frombuffer(state.get[0] if state.exists else b"", "int64").reshape(-1, len(_CALL))

        def out(calls, admitted):
            if len(calls):
                yield pd.DataFrame(calls, columns=_CALL).assign(end=end, admitted=admitted)

        if state.hasTimedOut:
            state.remove()
            yield from out(kept, True)
            return
        for frame in frames:
            calls = np.concatenate([kept, frame[_CALL].to_numpy("int64")])
            calls = calls[np.lexsort(calls.T[::-1])]
            i = np.arange(len(calls))
            begins = np.ones(len(calls), bool)
            begins[1:] = (calls[1:, :_SUBJECT] != calls[:-1, :_SUBJECT]).any(axis=1)
            first = i - np.maximum.accumulate(np.where(begins, i, 0)) < limit
            kept, away = calls[first], calls[~first]
            yield from out(away, False)
        state.update((kept.tobytes(),))
        state.setTimeoutTimestamp(end)

    return run


def admissions(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", limit: int = 10, groups: int = GROUPS) -> DataFrame:
    """Every call, marked admitted or not: of a subject's calls in a fixed window the first
    ``limit`` are, by time and then id. Repeated calls (one ``event_id``) count once within
    the watermark. State per subject and window is ``limit`` calls, whatever their number;
    calls of windows that the watermark has not passed are pending.

    Python is called per window and group of subjects, not per subject. One group's state
    is ``limit`` calls (40 bytes each) of its subjects: more ``groups`` for more subjects.
    A checkpoint goes on with the ``groups`` it began with."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    # times as numbers, so that the session's time zone does not matter in Python
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group")
    has = lambda c: F.col(c).isNotNull().cast("long")
    known = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    end = F.unix_millis(F.window("ts", width)["end"]).alias("end")
    calls = once.select(group, end, has("user_id").alias("has_user"), known("user_id"), F.unix_micros("ts").alias("at"), has("event_id").alias("has_event"), known("event_id"), "ts")
    schema = ", ".join(f"{c} long" for c in [*_CALL, "end"]) + ", admitted boolean"
    marked = calls.groupBy("group", "end").applyInPandasWithState(_admit(limit), schema, "calls binary", "append", "EventTimeTimeout")
    user, event = F.when(F.col("has_user") == 1, F.col("user_id")), F.when(F.col("has_event") == 1, F.col("event_id"))
    return marked.select(user.alias("user_id"), F.timestamp_millis("end").alias("window_end"), event.alias("event_id"), F.timestamp_micros("at").alias("ts"), "admitted")


def admissions_of(calls: DataFrame, width: str = "1 hour", limit: int = 10) -> DataFrame:
    """The same of a finished table."""
    rows = calls.groupBy("event_id").agg(F.min(F.struct("ts", "user_id")).alias("c")).select("event_id", "c.ts", "c.user_id").withColumn("window_end", F.window("ts", width)["end"])
    place = F.row_number().over(Window.partitionBy("user_id", "window_end").orderBy("ts", "event_id"))
    return rows.select("user_id", "window_end", "event_id", "ts", (place <= limit).alias("admitted"))
