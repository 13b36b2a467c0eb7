"""The stored inverted index against one built anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandwise.operators import text as J
from strandwise.operators.text_index import StoredIndex

DDL = "k long, title string, body string"


def fields():
    return {c: F.col(c) for c in ("title", "body")}


def rebuilt(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], DDL)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_a_rebuild(spark, tmp_path):
    path, docs, words = str(tmp_path / "index"), {}, "alpha beta gamma delta epsilon zeta".split()
    index = StoredIndex(spark, path, "k")
    assert index.bm25(["alpha"], {"body": 1.0}).count() == 0
    for batch in range(3):
        new = {k: (words[(k + batch) % 6], " ".join(words[(k * j + batch) % 6] for j in range(k % 5))) for k in range(batch * 10, batch * 10 + 25)}
        new[100 + batch] = (None, "") if batch % 2 else ("alpha alpha", None)
        index.put(rebuilt(spark, new), fields())
        docs |= new
        gone = [batch * 7, 100 + batch - 1, 999]
        index.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
        docs = {k: v for k, v in docs.items() if k not in gone}
        index = StoredIndex(spark, path, "k")  # taken up again from what is stored
        fresh = J.inverted_index(rebuilt(spark, docs), "k", fields())
        assert rows(index.postings().select("k", "field", "term", "tf", "length")) == rows(fresh.drop("opens"))
        want = J.bm25(fresh, "k", ["alpha", "zeta"], {"title": 2.0, "body": 1.0})
        assert rows(index.bm25(["alpha", "zeta"], {"title": 2.0, "body": 1.0})) == rows(want)
    assert len(index.segments) <= 3


def test_a_search_reads_the_parts_of_its_terms(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"), "k")
    docs = spark.range(4000).select(F.col("id").alias("k"), F.lit("").alias("title"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("v"), F.col("id") % 50)).alias("body"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.put(docs, fields())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = index.segments[0]["folder"]
    assert len(index._parts(folder, ["w17"])) == 1 < spark.read.parquet(f"{folder}/parts").count()
    plan = index.postings(["w17"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#").replace("(part#", "part#") and "PushedFilters: [In(term" in plan or "EqualTo(term,w17)" in plan
    assert [r.k for r in index.postings(["w17"]).collect()] == [17]
    assert len({f for r in index.postings(["w17"]).select(F.input_file_name().alias("f")).collect() for f in r}) == 1


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = StoredIndex(spark, path, "k")
    index.put(rebuilt(spark, {1: ("one", "two")}), fields())
    monkeypatch.setattr(StoredIndex, "_save", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.put(rebuilt(spark, {1: ("three", "four")}), fields())
    monkeypatch.undo()
    again = StoredIndex(spark, path, "k")
    assert {r.term for r in again.postings().collect()} == {"one", "two"}
    before = [s["folder"] for s in again.segments]
    again.put(rebuilt(spark, {1: ("five", "six")}), fields())
    again.vacuum(before)
    assert {r.term for r in StoredIndex(spark, path, "k").postings().collect()} == {"five", "six"}


def test_documents_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda text: (seen.add(1), text)[1])
    docs = spark.range(50).select(F.col("id").alias("k"), F.lit("alpha beta").alias("body"))
    StoredIndex(spark, str(tmp_path / "index"), "k").put(docs, {"body": told("body")})
    assert seen.value == 50
