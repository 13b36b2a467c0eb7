"""Admission on a stream against the batch form."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from strandwise.streaming import events as S

DAY = dt.datetime(2024, 1, 1)


def test_admissions_with_late_and_repeated_files_and_a_restart(spark, tmp_path):
    random.seed(6)
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    every = [(i, DAY + dt.timedelta(minutes=3 * i + random.randint(-40, 40)), i % 3, "call", 0.0, "{}") for i in range(200)]
    batches = [every[i : i + 40] for i in range(0, 200, 40)]
    for k, batch in enumerate([*batches[:3], batches[1], *batches[3:], [(999, DAY + dt.timedelta(days=30), 9, "call", 0.0, "{}")]]):
        random.shuffle(batch)
        spark.createDataFrame(batch, S.EVENTS).coalesce(1).write.mode("append").parquet(source)
        # stops after each file and goes on from the checkpoint
        S.run_to_table(S.admissions(S.read_events(spark, source), late="8 hours", limit=4), out, at)
    got = spark.read.schema(S.ADMISSIONS).parquet(out)
    want = S.admissions_of(spark.createDataFrame(every, S.EVENTS), limit=4)
    key = lambda df: sorted((r.event_id, r.user_id, r.ts, r.window_end, r.admitted) for r in df.where(F.col("event_id") < 999).collect())
    assert key(got) == key(want)
    assert got.where("not admitted").count() > 20


def test_state_is_kept_by_groups_of_subjects(spark, tmp_path):
    """One row of state and one call of Python per window and group, not per subject."""
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    many = [(i, DAY + dt.timedelta(seconds=i % 3000), i % 701 if i % 701 else None, "call", 0.0, "{}") for i in range(2100)]
    many += [(None, DAY, 5, "call", 0.0, "{}"), (2**53 + 1, DAY + dt.timedelta(days=3), 1, "call", 0.0, "{}")]
    frame = spark.createDataFrame(many, S.EVENTS)
    frame.write.parquet(source)
    S.run_to_table(S.admissions(S.read_events(spark, source), limit=2), out, at)
    # as it was before the windows were passed
    state = spark.read.format("statestore").option("operatorId", 0).option("batchId", 0).load(at)
    assert 0 < state.count() <= 2 * S.GROUPS
    got = spark.read.schema(S.ADMISSIONS).parquet(out)
    want = S.admissions_of(frame, limit=2).where(F.col("ts") < F.lit(DAY + dt.timedelta(days=1)))
    rows = lambda df: sorted(df.select("user_id", "window_end", "event_id", "ts", "admitted").collect(), key=str)
    assert rows(got) == rows(want) and got.where("not admitted").count() > 600
