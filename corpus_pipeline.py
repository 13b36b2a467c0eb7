"""A corpus pipeline of five stages, each a table written and read again.

quality rules -> line dedup -> near duplicates -> mixing -> byte-level BPE. Every stage
works on all that the one before kept, and its decisions take effect. All stages but the
last return the columns of ``documents``.

Edge cases are those of the operators; in all stages columns that ``documents`` has
besides ``doc_id``, ``text`` and ``source`` are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe, jaccard_join, line_dedup, mixing, quality
from strandwise.llm.common import stage, table


def _tagged(docs: DataFrame) -> DataFrame:
    """With a mark that tells rows of one id apart by their text."""
    return docs.withColumn("_sw_tag", line_dedup.row_tag())


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Joins decisions (small rows: ``_sw_id`` and ``_sw_mark``) to whole documents; a
    null id is an id like others here."""
    own = F.col("doc_id").eqNullSafe(F.col("_sw_id")) & (F.col("_sw_tag") == F.col("_sw_mark"))
    return _tagged(docs).join(found.hint("shuffle_hash"), own, how)


def _row() -> list[Column]:
    """What names a row. Columns are made when a stage runs: the driver imports this
    module before there is a session."""
    return [F.col("doc_id").alias("_sw_id"), F.col("_sw_tag").alias("_sw_mark")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go. Every row, also one
    without an id, follows its own verdict."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    verdicts = quality.quality_rules(_tagged(docs), trusted, also=["_sw_tag"])
    return _with(docs, verdicts.where("kept").select(*_row()).distinct(), "left_semi").drop("_sw_tag")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; rows without an id stay whole."""
    gone = line_dedup.dropped_lines(docs).select(F.col("doc_id").alias("_sw_id"), F.col("tag").alias("_sw_mark"), F.col("gone").alias("_sw_gone"))
    kept = line_dedup.cut_lines(_with(docs, gone, "left"), "text", "_sw_gone", "_sw_left")
    new = {"text": F.col("_sw_left"), "n_chars": F.length("_sw_left")}
    return kept.select(*(new[c].cast(t).alias(c) if c in new else F.col(f"`{c}`") for c, t in docs.dtypes))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows
    without an id link with nothing and stay."""
    found = jaccard_join.near_duplicates(docs).where("doc_id = component_id")
    ids = found.select(F.col("doc_id").alias("_sw_id")).distinct()
    kept = docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_sw_id"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeated rows of one source each as often
    as the one that it takes most."""
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    copies = mixing.mix_documents(_tagged(docs), also=["_sw_tag"]).where("copies > 0").groupBy(*_row(), source.alias("_sw_source")).agg(F.max("copies").alias("_sw_copies"))
    own = F.col("doc_id").eqNullSafe(F.col("_sw_id")) & (F.col("_sw_tag") == F.col("_sw_mark")) & (source == F.col("_sw_source"))
    mixed = _tagged(docs).join(copies.hint("shuffle_hash"), own)
    return mixed.withColumn("_sw_copy", F.explode(F.sequence(F.lit(1), F.col("_sw_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix holds."""
    return bpe.token_digests(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The likelihood ratio and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
