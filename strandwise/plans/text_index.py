"""Queries over the stored index: built by batches, changed and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.staging import scratch
from strandwise.operators.text_index import StoredIndex

from .registry import Tables, query
from .text import _BM, _INDEX, TERMS, body, title


def stored(t: Tables) -> StoredIndex:
    """All documents, in three batches; the first holds former texts that the later ones
    replace, and documents that are deleted again."""
    fields = {"title": title(), "body": body()}
    index = StoredIndex(t.spark, scratch(t.spark, "text_index"), "doc_id", former=False)
    docs = t.documents.select("doc_id", "text")
    former = docs.withColumn("text", F.reverse("text"))
    index.put(former.unionByName(docs.withColumn("doc_id", -1 - F.col("doc_id"))), fields)
    index.put(docs.where("doc_id % 3 = 0"), fields)
    index.delete(docs.select((-1 - F.col("doc_id")).alias("doc_id")))
    index.put(docs.where("doc_id % 3 <> 0"), fields)
    return index


@query("stored_bm25", f"{_BM} SELECT doc_id, round(score, 4) AS score FROM bm")
def _(t):
    return stored(t).bm25(TERMS, {"title": 3.0, "body": 1.0}).withColumn("score", F.round("score", 4))


@query("stored_postings", f"WITH {_INDEX} SELECT doc_id, field, term, tf, length FROM i")
def _(t):
    return stored(t).postings()
