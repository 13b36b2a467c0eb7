"""Stored tables that change by buckets, and the refresh of a roll-up."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from strandwise.sources.stored import BUCKET, StoredTable, refresh

DDL = "k bigint, i bigint, v string, at bigint"


def files(table):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{table.path}/{BUCKET}=*/*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_change_their_buckets_once(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), "k", DDL, 8)
    table.create(spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("i"), F.lit("old").alias("v"), F.lit(1).cast("long").alias("at")))
    before, was = files(table), rows(table.read())
    batch = spark.createDataFrame([(7, 7, "new", 2), (7, 57, "old", 9), (7, 900, "added", 2)], DDL)
    assert table.upsert(batch, ["k", "i"], "at", 1)
    want = sorted([r for r in was if r[1] != 7] + [(7, 7, "new", 2), (7, 900, "added", 2)])
    assert rows(table.read()) == want  # an equal row keeps its stamp
    own = f"{BUCKET}={table.buckets_of(batch)[0]}"
    after = files(table)
    assert {f: m for f, m in before.items() if own not in f} == {f: m for f, m in after.items() if own not in f}
    assert not table.upsert(batch.withColumn("v", F.lit("again")), ["k", "i"], "at", 1)
    assert rows(table.read()) == want and files(table) == after
    # all rows of a set of keys, one of them with none after
    keys = spark.createDataFrame([(k,) for k in range(50) if k % 2], "k bigint")
    assert table.replace(keys, spark.createDataFrame([(1, 1, "only", 3)], DDL), 2)
    assert rows(table.read()) == sorted([r for r in want if r[0] % 2 == 0] + [(1, 1, "only", 3)])
    assert table.replace(spark.createDataFrame([(k,) for k in range(50)], "k bigint"), spark.createDataFrame([], DDL), 3)
    assert rows(table.read()) == [] if files(table) else True


def test_refresh_equals_the_full_rollup(spark, tmp_path):
    make = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    samples, rollup = StoredTable(spark, str(tmp_path / "s"), "k", DDL, 16), StoredTable(spark, str(tmp_path / "r"), "k", "k bigint, n bigint, top string", 16)
    samples.create(spark.range(400).select((F.col("id") % 100).alias("k"), F.col("id").alias("i"), F.lit("a").alias("v"), F.lit(1).cast("long").alias("at")))
    rollup.create(make(samples.read()))
    keys = spark.createDataFrame([(3,), (8,)], "k bigint")
    samples.replace(keys, spark.createDataFrame([(3, 1000, "z", 2)], DDL), 1)
    before = files(rollup)
    assert refresh(rollup, samples, keys, make, 1)
    assert rows(rollup.read()) == rows(make(samples.read()))
    assert samples.read(samples.buckets_of(keys)).count() < 100
    touched = {f"{BUCKET}={b}" for b in rollup.buckets_of(keys)}
    same = lambda found: {f: m for f, m in found.items() if not any(f"/{b}/" in f for b in touched)}
    assert same(files(rollup)) == same(before)
    assert not refresh(rollup, samples, keys, make, 1)
