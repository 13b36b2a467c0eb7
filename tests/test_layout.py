"""Laid-out tables: same rows as a plain filter, from fewer files and rows scanned."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandwise.operators import predicates as P
from strandwise.operators.cohort import Clause, members
from strandwise.sources.layout import LaidOutTable

DDL = "kind string, x double, tag string, n bigint"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    i = F.col("id")
    kind = F.when(i % 101 == 0, F.lit(None)).when(i % 103 == 0, F.lit("")).when(i % 3 == 0, F.lit("a/b *{c} %20")).when(i % 7 == 0, F.lit("rare")).otherwise(F.lit("hot"))
    x = F.when(i % 211 != 0, F.abs(F.hash("id")) % 10007 / 4)
    rows = spark.range(0, 60000, 1, 8).select(kind.alias("kind"), x.alias("x"), F.md5(i.cast("string")).alias("tag"), i.alias("n"))
    table = LaidOutTable(spark, str(tmp_path_factory.mktemp("laid") / "t"), DDL, "kind", ["x"])
    table.write(rows, bloom={"tag": 6000}, rows_per_file=6000, row_group_bytes=64 << 10, parts=8)
    return rows, table


def ids(df):
    return sorted(r["n"] for r in df.collect())


def scanned(df):
    """Rows that left the scan, after files, row groups and pages were chosen."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize(
    "ask",
    [
        {"ranges": {"x": (100.0, 110.0)}},
        {"ranges": {"x": (None, 3.0)}, "by": ["rare", "hot"]},
        {"by": ["a/b *{c} %20"]},
        {"by": [""], "ranges": {"x": (0.0, 900.0)}},
        {"by": [None]},
        {"by": []},
        {"equal": {"kind": "rare", "x": 12.25}},
        {"equal": {"n": 77}},
        {"equal": {"x": None}},
        {"ranges": {"x": (9e9, None)}},
        {},
    ],
)
def test_same_rows(made, ask):
    rows, table = made
    want = rows
    for c, (low, high) in ask.get("ranges", {}).items():
        want = want.where(P.in_range(c, low, high))
    for c, v in ask.get("equal", {}).items():
        want = want.where(F.col(c) == F.lit(v))
    if "by" in ask:
        want = want.where(F.col("kind").isin([k for k in ask["by"] if k is not None]) if any(ask["by"]) or "" in ask["by"] else F.lit(False))
    assert ids(table.read(**ask)) == ids(want)


def test_fewer_files_and_row_groups(made):
    rows, table = made
    every = table.files().count()
    assert every >= 10
    near = {"ranges": {"x": (100.0, 110.0)}, "by": ["hot"]}
    assert table.files(**near).count() <= 2
    assert len(table.read(**near).inputFiles()) == table.files(**near).count()
    kept = table.files(**near).agg(F.sum("n_rows")).collect()[0][0]
    assert scanned(table.read(**near)) < kept  # row groups and pages too
    # no order on tags: only the Bloom filters can leave row groups out
    assert scanned(table.read(equal={"tag": "00000000000000000000000000000000"})) < 12000
    found = table.read(equal={"tag": rows.where("n = 500").collect()[0]["tag"]})
    assert ids(found) == [500] and scanned(found) < 20000


def test_names_are_cut_once_a_file(made):
    rows, table = made
    plan = table._ends()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    aggregate = next(i for i, line in enumerate(plan) if "Aggregate" in line)
    # neither the grouping key nor anything below it: rows have become files before
    assert not any("regexp_extract" in line for line in [plan[aggregate].split("]")[0], *plan[aggregate + 1 :]]), plan
    assert table._ends().agg(F.sum("n_rows")).collect()[0][0] == rows.count()


def test_rewritten(spark, tmp_path):
    table = LaidOutTable(spark, str(tmp_path / "t"), DDL, "kind", ["x"])
    table.write(spark.createDataFrame([("a", 1.0, "t", 1), ("b", 2.0, "t", 2)], DDL))
    table.write(spark.createDataFrame([("c", 5.0, "t", 3)], DDL))
    assert ids(table.read()) == [3] and ids(table.read(by=["a"])) == [] and ids(table.read(by=["c"])) == [3]
    table.write(spark.createDataFrame([], DDL))
    assert ids(table.read()) == [] and ids(table.read(ranges={"x": (0, 9)})) == []


def pushed(df):
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return next((line for line in plan.splitlines() if "PushedFilters" in line), "")


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("a", 1.0, "t", 1), (None, None, None, 2), ("b", 2.0, "u", 3)], DDL)
    df.write.parquet(path)
    df = spark.read.schema(DDL).parquet(path)
    tree = {"and": [{"kind": ["a", "b", None]}, {"field": "x", "min": 1, "max": 9}, {"not": {"tag": ["u"]}}]}
    found = P.filter_tree(df, tree)
    assert ids(found) == [1]
    for part in ("IsNotNull(kind)", "In(kind", "GreaterThanOrEqual(x,1.0)", "LessThanOrEqual(x,9.0)", "Not(EqualTo(tag,u))"):
        assert part in pushed(found), pushed(found)
    assert ids(P.filter_tree(df, {"not": {"kind": ["a"]}})) == [2, 3]
    assert ids(P.filter_tree(df, {"not": {"field": "x", "min": 1.5}})) == [1, 2]
    assert ids(P.filter_tree(df, {"not_kind": ["a", None]})) == [2, 3]
    assert ids(P.filter_tree(df, {"not": {"kind": [None]}})) == [1, 2, 3]
    assert "EqualTo(kind,a)" in pushed(members(df, [Clause("k", "include", "kind", ("a",))]))
    assert ids(members(df, [Clause("k", "exclude", "kind", ("a",))])) == [2, 3]
    binned = P.binned_range(df, "x", [0, 1.5, 3], 1, 1)
    assert ids(binned) == [1] and "LessThan(x,1.5)" in pushed(binned)
    coarse = df.where(P.quantised_range("x", 0.9, 1.1, 100.0))
    assert ids(coarse) == [1] and "GreaterThanOrEqual(x" in pushed(coarse)
    assert ids(df.where(P.quantised_range("x", 0.0, 100.0, 100.0))) == [1, 3]
    assert "EqualTo(kind,a)" in pushed(P.list_filter(df, {"kind": "a"}, {}, "x", ["x"], ["n"], "x"))
