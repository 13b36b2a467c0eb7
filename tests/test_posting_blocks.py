"""Postings in blocks against the rows of ``text.inverted_index``, and what an index leaves on disk."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.operators import posting_blocks as P
from strandwise.operators import text as J
from strandwise.operators.text_index import StoredIndex

WORDS = ["It's a CELL's 's 'sx a's's b's'c d's_e 's", "", " . ", "naïve ÉTÉ l'Été's «x» ½ x² ǅ İstanbul ΣΑΣ", "the the the of the", "a\tb\nc\0d", None, "x'S", "日本語 テスト 3", "'s", "s'"]


def columns():
    return {c: F.col(c) for c in ("title", "body")}


def rows(df):
    return sorted(df.collect(), key=str)


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 1 << 32, (1 << 64) - 1, 300, 5], np.uint64)
    coded = P.encode(values, np.array([0, 3, 7]))
    assert len(coded) == 3 and P.decode(coded).tolist() == values.tolist()
    assert P.decode(coded.slice(1, 1)).tolist() == values[3:7].tolist()
    assert P.decode(P.encode(values[:0], np.array([], int))).tolist() == []


@pytest.mark.parametrize("key_type,keys", [("bigint", [None, -(1 << 63), (1 << 63) - 1, 0, -5, 7, 3]), ("string", [None, "b", "a", "", "z", "ab", "c"]), ("int", [None, 4, -4, 0, 9, 2, 1])])
def test_blocks_hold_the_rows_of_the_inverted_index(spark, key_type, keys):
    docs = [(k if i < len(keys) else (i if key_type != "string" else f"k{i}"), WORDS[i % 11], WORDS[(i * 3 + i // 11) % 11]) for i, k in enumerate([*keys, *range(60)])]
    df = spark.createDataFrame(docs, f"k {key_type}, title string, body string").coalesce(1)
    want = rows(J.inverted_index(df, "k", columns()).where("opens >= 0").drop("opens"))
    blocks = P.gathered(P.pack_texts(df, "k", key_type, columns(), 7, 4), key_type, 4).drop("part")
    again = P.pack_rows(P.unpack(blocks, "k", key_type), "k", key_type, 3).unionByName(P.pack_blocks(blocks.where("n < 0"), 3))
    for made in (blocks, P.gathered(again, key_type, 3), P.gathered(P.pack_blocks(blocks, 5), key_type, 5)):
        got = P.unpack(made.where("opens = 0"), "k", key_type, ["field", "term", "tf", "length"])
        assert rows(got) == want
        heads = P.unpack(made.where("opens > 0"), "k", key_type, ["field", "length", "opens", "seq"])
        assert rows(heads.drop("seq")) == rows(J.inverted_index(df, "k", columns()).where("opens > 0").select("k", "field", "length", "opens"))
        assert {r.seq for r in heads.collect()} == {7}


def test_small_chunks_and_blocks_give_the_same(monkeypatch):
    texts = [" ".join(f"w{j % (i % 7 + 1)}" for j in range(i)) + " " for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(200, 0, -1), pa.int64()), "_0": pa.array(texts)})

    def unpacked():
        packed = P._pack_texts(["f"], 1, 4, True)([batch.slice(0, 90), batch.slice(90)])
        dealt = P._gather(P._deal(4)(packed))
        out = pa.Table.from_batches(P._unpack("k", True, pa.int64(), ["term", "tf", "length", "opens", "wide"])([b.drop_columns(["part"]) for b in dealt])).to_pylist()
        return sorted((str(r["term"]), r["k"], r["tf"], r["length"], r["opens"]) for r in out), {r["term"] for r in out if r["wide"]}

    plain, wide = unpacked()
    assert wide == {None}
    for name, value in (("TEXT", 500), ("HELD", 300), ("BLOCK", 8), ("SLICE", 50), ("UNPACKED", 10)):
        monkeypatch.setattr(P, name, value)
    again, wide = unpacked()
    assert again == plain and "w0" in wide


def test_wide_terms_are_found_in_all_their_parts(spark, tmp_path, monkeypatch):
    index = StoredIndex(spark, str(tmp_path / "index"), "k")
    docs = spark.range(12000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), "id")).alias("body")).coalesce(2)
    index.put(docs, {"body": F.col("body")})
    folder = index.segments[0]["folder"]
    assert len(index._parts(folder, ["the"])) > 1 == len(index._parts(folder, ["w17"]))
    assert index.postings(["the"]).select("k").distinct().count() == 12000
    assert spark.read.parquet(f"{folder}/postings").where("term = 'the'").agg(F.max("n")).first()[0] < 12000


def test_an_index_keeps_one_copy_in_few_rows(spark, tmp_path):
    """Segments that hold nothing any more go unread, merged ones at once; no shuffle or staged rows stay."""
    path = str(tmp_path / "index")
    index = StoredIndex(spark, path, "k", former=False)
    docs = spark.range(2000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("alpha beta"), F.concat(F.lit("v"), F.col("id") % 50)).alias("body"))
    index.put(docs.withColumn("body", F.reverse("body")), {"body": F.col("body")})
    index.put(docs.where("k % 3 = 0"), {"body": F.col("body")})
    index.put(docs.where("k % 3 > 0"), {"body": F.col("body")})
    assert os.listdir(f"{path}/segments") == [os.path.basename(s["folder"]) for s in index.segments]
    assert index.tombs == [] == [f for f in os.listdir(f"{path}/tombs")]
    assert index.segments[0]["rows"] == index.postings().count() == 6000
    assert spark.read.parquet(f"{index.segments[0]['folder']}/postings").count() < 600
    again = StoredIndex(spark, path, "k")
    assert {r.term for r in again.postings(["alpha", "ahpla", "v7"]).collect()} == {"alpha", "v7"}
    half = spark.range(0, 2000, 2).select(F.col("id").alias("k"), F.lit("gamma").alias("body"))
    again.put(half, {"body": F.col("body")})  # half of what the merge meets is hidden
    assert {(r.term, r.n) for r in again.postings(["alpha", "gamma"]).groupBy("term").agg(F.count("*").alias("n")).collect()} == {("alpha", 1000), ("gamma", 1000)}


def test_a_score_does_not_deal_rows_by_term(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"), "k")
    index.put(spark.range(50).select(F.col("id").alias("k"), F.lit("alpha beta").alias("body")), {"body": F.col("body")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = index.bm25(["alpha", "beta"], {"body": 1.0})
        assert scores.count() == 50
        assert "SortMergeJoin" not in scores._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
