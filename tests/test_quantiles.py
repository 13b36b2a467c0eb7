"""Quantiles by rank against plain percentiles."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwise.operators.quantiles import quantiles
from strandwise.operators.windows import robust_z

NAMED = {"a": ("x", 0.0), "b": ("x", 0.1), "c": ("x", 0.5), "d": ("x", 0.9), "e": ("x", 1.0), "f": ("y", 0.5), "g": ("y", 0.37)}


def skewed(spark):
    """One key with nearly all rows, a null key, small keys, ties, nulls and far values."""
    i = F.col("id")
    k = F.when(i % 97 == 0, F.lit(None)).when(i % 50 == 0, i % 7).otherwise(F.lit(100))
    x = F.when(i % 11 == 0, F.lit(None)).when(i % 5 == 0, 3.0).when(i % 1000 == 1, F.pow(F.lit(10.0), i % 300)).otherwise(-F.abs(F.hash("id")) / 7.0)
    return spark.range(0, 40000, 1, 8).select(k.cast("long").alias("k"), x.alias("x"), F.when(k != 3, i % 13).alias("y"))


def read(df):
    return {r["k"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("hot", [0, 500])
def test_by_rank_equals_percentile(spark, hot):
    df, size = skewed(spark), [F.count("*").alias("n"), F.max("x").alias("top")]
    got, want = read(quantiles(df, "k", NAMED, size, hot)), read(quantiles(df, "k", NAMED, size))
    assert got.keys() == want.keys() and None in got
    assert got[3]["f"] is None and got[3]["c"] is not None
    for k, row in want.items():
        for name, v in row.items():
            assert got[k][name] == v or math.isclose(got[k][name], v, rel_tol=1e-12), (k, name)


def test_a_hot_key_is_split(spark, monkeypatch):
    """All rows in one key: its values lie in several ranges, each a bounded part."""
    from strandwise.operators import quantiles as Q

    kept = {}

    def watch(df, name):
        kept[name] = real(df, name)
        return kept[name]

    real = Q.stage
    monkeypatch.setattr(Q, "stage", watch)
    # small tables would be put together again, so ranges are kept apart here
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20000, 1, 8).select(F.lit(1).alias("k"), F.col("id").alias("x"))
        assert quantiles(df, "k", {"m": ("x", 0.5)}, hot=1).collect()[0]["m"] == 9999.5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept["ranges"].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10000


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert quantiles(empty, "k", {"m": ("x", 0.5)}, hot=0).collect() == []
    nothing = spark.createDataFrame([("a", None), ("a", None), (None, 1.0)], "k string, x double")
    assert read(quantiles(nothing, "k", {"m": ("x", 0.5)}, hot=0)) == {"a": {"k": "a", "m": None}, None: {"k": None, "m": 1.0}}


def test_robust_z_of_a_hot_key(spark):
    rows = pd.DataFrame({"k": [1] * 50 + [2] * 3, "i": range(53), "v": [100.0 + i for i in range(49)] + [0.5] + [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(rows)
    want = sorted(tuple(r) for r in robust_z(df, "k", "v").collect())
    got = sorted(tuple(r) for r in robust_z(df, "k", "v", hot=0).collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and len(got) == 50
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, want, strict=True))
    assert [r[1] for r in got if r[4]] == [49]
