"""An inverted index that is stored and kept in step with its documents (J2, J3).

Each batch of new or changed documents becomes a segment: its postings in blocks
(``posting_blocks``), dealt by term into parts and sorted by it, and a row per document and
field with the length. A change or deletion of a document leaves a tombstone, which hides what
older segments hold of it. Segments of about equal size, counted by what is not hidden, merge,
so a row is rewritten a logarithmic number of times; a merge drops what tombstones hide, and
moves blocks as they are where they hide nothing. A segment of which nothing is left goes
without being read.

A search reads the parts that its terms are dealt to; figures of the corpus come from
per-segment totals, less what is hidden.

The list of segments is written anew, under a new version, after the data that it names:
a job that dies leaves the last version in force. Old data is deleted only on ``vacuum``, or
at once, when a version without it is in force, where no ``former`` versions are asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.staging import _delete, shuffles_dropped
from strandwise.operators import posting_blocks as P
from strandwise.operators.text import B, K1

_SEGMENTS = "version long, seq long, docs long, rows long, folder string"
#: Of two neighbouring segments the newer merges into the older from this share of its rows on.
MERGE = 2


class StoredIndex:
    """The index in ``path``, a folder that driver and executors share. ``former``: data
    of former versions stays for those who still read them, until ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str = "bigint", former: bool = True):
        self.spark, self.path, self.key, self.key_type, self.former = spark, path.rstrip("/"), key, key_type, former
        self.version, self.segments, self.tombs, self.next = 0, [], [], 1
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            rows = spark.read.schema(f"{_SEGMENTS}, kind string, next long").json(f"{self.path}/manifest/*")
            rows = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("seq").collect()
            self.version, self.next = rows[0].version, rows[0].next
            self.segments = [r.asDict() for r in rows if r.kind == "segment"]
            self.tombs = [r.asDict() for r in rows if r.kind == "tombs"]
        self._saved = self._folders()

    # ------------------------------------------------------------ changes

    def put(self, docs: DataFrame, fields: Mapping[str, Column]) -> None:
        """Adds documents; those with a key that is there already replace it. Keys in
        ``docs`` are unique."""
        seq, parts = self._take(), self._dealt()
        new = self._write_segment(seq, P.pack_texts(docs, self.key, self.key_type, fields, seq, parts), parts)
        if self.segments:
            self._bury(docs.select(self.key), seq)
        self.segments.append(new)
        self._save()
        self._merge()

    def delete(self, keys: DataFrame) -> None:
        """Deletes the documents of these keys."""
        self._bury(keys.select(self.key), self._take())
        self._save()

    def _take(self) -> int:
        self.next += 1
        return self.next - 1

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def _bury(self, keys: DataFrame, seq: int) -> None:
        folder = self._new("tombs")
        with shuffles_dropped(self.spark):
            keys.distinct().withColumn("tomb", F.lit(seq).cast("long")).write.parquet(folder)
        self.tombs.append({"seq": seq, "docs": 0, "rows": 0, "folder": folder})

    def _dealt(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write_segment(self, seq: int, packed: DataFrame, parts: int) -> dict:
        """Postings by term, documents by key."""
        folder = self._new("segments")
        with shuffles_dropped(self.spark):
            P.gathered(packed, self.key_type, parts).write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/postings")
            kept = self._blocks(folder)
            spread = kept.where("wide and term is not null").select("part", "term").distinct()
            every = kept.select("part").distinct().withColumn("term", F.lit(None).cast("string"))
            every.unionByName(spread).withColumn("dealt", F.lit(parts)).coalesce(1).write.parquet(f"{folder}/parts")
            docs = P.unpack(kept.where("opens > 0"), self.key, self.key_type, ["seq", "field", "length", "opens", "tf"])
            docs.write.parquet(f"{folder}/docs")
            totals = self._docs(folder).groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum((F.col("opens") == 2).cast("long")).alias("docs"))
            totals.coalesce(1).write.parquet(f"{folder}/totals")
        figures = self._docs(folder).agg(F.count_if(F.col("opens") == 2), F.coalesce(F.sum("tf"), F.lit(0))).first()
        return {"seq": seq, "docs": figures[0], "rows": figures[1], "folder": folder}

    def _merge(self) -> None:
        """Merges newer segments into older ones; a version is saved for each step."""
        hidden = self._hidden_rows()
        left = lambda s: s["rows"] - hidden.get(s["folder"], 0)
        gone = [s for s in self.segments if not left(s)]
        if gone:
            self.segments = [s for s in self.segments if left(s)]
            self._save()
        while len(self.segments) > 1 and MERGE * left(self.segments[-1]) >= left(self.segments[-2]):
            new, old = self.segments.pop(), self.segments.pop()
            moved, parts = [], self._dealt()
            for s in (old, new):
                blocks = self._blocks(s["folder"]).drop("part")
                if hidden.get(s["folder"]):
                    moved.append(P.pack_rows(self._alive(P.unpack(blocks, self.key, self.key_type)), self.key, self.key_type, parts))
                else:
                    moved.append(P.pack_blocks(blocks, parts))
            self.segments.append(self._write_segment(new["seq"], reduce(DataFrame.unionByName, moved), parts))
            self._save()
        # what every segment has already dropped need not be kept
        if len(self.segments) == 1 and any(t["seq"] <= self.segments[0]["seq"] for t in self.tombs):
            self.tombs = [t for t in self.tombs if t["seq"] > self.segments[0]["seq"]]
            self._save()

    def _hidden_rows(self) -> dict[str, int]:
        """How many rows of a segment tombstones hide, by its folder."""
        if not self.tombs:
            return {}
        found = [self._docs(s["folder"]).withColumn("_folder", F.lit(s["folder"])) for s in self.segments]
        rows = self._hidden(reduce(DataFrame.unionByName, found), "left_semi").groupBy("_folder").agg(F.sum("tf").alias("n"))
        return {r["_folder"]: r["n"] for r in rows.collect()}

    def _folders(self) -> list[str]:
        return [s["folder"] for s in (*self.segments, *self.tombs)]

    def _save(self) -> None:
        self.version += 1
        rows = [(self.version, s["seq"], s["docs"], s["rows"], s["folder"], kind, self.next) for kind, of in (("segment", self.segments), ("tombs", self.tombs)) for s in of]
        rows = rows or [(self.version, 0, 0, 0, "", "none", self.next)]
        self.spark.createDataFrame(rows, f"{_SEGMENTS}, kind string, next long").coalesce(1).write.json(f"{self.path}/manifest/{self.version:012d}")
        if not self.former:
            self.vacuum(self._saved)
        self._saved = self._folders()

    def vacuum(self, before: Sequence[str] = ()) -> None:
        """Deletes the given folders of former versions, once no reader uses them."""
        for folder in set(before) - set(self._folders()):
            _delete(self.spark, folder)

    # ------------------------------------------------------------ reading

    def _blocks(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{P.block_schema(self.key_type)}, part int").parquet(f"{folder}/postings")

    def _docs(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"`{self.key}` {self.key_type}, seq long, field string, length int, opens int, tf long").parquet(f"{folder}/docs")

    def _totals(self, folder: str) -> DataFrame:
        return self.spark.read.schema("field string, n long, length long, docs long").parquet(f"{folder}/totals")

    def _hidden(self, rows: DataFrame, how: str) -> DataFrame:
        tombs = [self.spark.read.schema(f"`{self.key}` {self.key_type}, tomb long").parquet(t["folder"]) for t in self.tombs]
        last = reduce(DataFrame.unionByName, tombs).groupBy(F.col(self.key).alias("_dead")).agg(F.max("tomb").alias("_tomb"))
        return rows.join(last, F.col(self.key).eqNullSafe(F.col("_dead")) & (F.col("_tomb") > F.col("seq")), how)

    def _alive(self, rows: DataFrame) -> DataFrame:
        return self._hidden(rows, "left_anti") if self.tombs else rows

    def _parts(self, folder: str, terms: Sequence[str]) -> list[int]:
        """Parts that may hold one of the terms: where they are dealt to, and where wide ones are."""
        parts = self.spark.read.schema("part int, term string, dealt int").parquet(f"{folder}/parts")
        rows = parts.where(F.col("term").isNull() | F.col("term").isin(list(terms))).collect()
        own = {P.part_of(t, r.dealt) for r in rows[:1] for t in terms}
        return sorted({r.part for r in rows if r.term is not None or r.part in own})

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Live ``key, field, term, tf, length``, of some terms or of all."""
        found, names = [], ["field", "term", "tf", "length"]
        for s in self.segments:
            blocks = self._blocks(s["folder"]).where("opens = 0")
            if terms is not None:
                blocks = blocks.where(F.col("part").isin(self._parts(s["folder"], terms)) & F.col("term").isin(list(terms)))
            found.append(P.unpack(blocks, self.key, self.key_type, [*names, "seq"] if self.tombs else names))
        if not found:
            return self.spark.createDataFrame([], f"`{self.key}` {self.key_type}, field string, term string, tf long, length int")
        return self._alive(reduce(DataFrame.unionByName, found)).select(self.key, *names)

    def figures(self) -> DataFrame:
        """``field, mean`` length and ``n`` documents of the corpus, one row per field."""
        totals = reduce(DataFrame.unionByName, [self._totals(s["folder"]) for s in self.segments])
        if self.tombs:
            docs = self._hidden(reduce(DataFrame.unionByName, [self._docs(s["folder"]) for s in self.segments]), "left_semi")
            gone = docs.groupBy("field").agg(-F.count("*"), -F.sum("length"), -F.sum((F.col("opens") == 2).cast("long")))
            totals = totals.unionByName(gone.toDF(*totals.columns))
        by_field = totals.groupBy("field").agg(F.sum("n").alias("_n"), F.sum("length").alias("_length"), F.sum("docs").alias("_docs"))
        every = by_field.agg(F.sum("_docs").alias("n"))
        return by_field.where("_n > 0").select("field", (F.col("_length") / F.col("_n")).alias("mean")).join(F.broadcast(every), F.lit(True))

    def bm25(self, terms: Sequence[str], weights: Mapping[str, float], k1: float = K1, b: float = B) -> DataFrame:
        """``key, score`` as ``text.bm25`` gives it for an index built anew."""
        hit = self.postings(sorted(set(terms)))
        if not self.segments:
            return hit.select(self.key, F.lit(0.0).alias("score"))
        df = hit.groupBy("term").agg(F.countDistinct(self.key).alias("df"))
        # a row for each term asked and for each field: no term's rows go to one task
        rows = hit.join(F.broadcast(df), "term").join(F.broadcast(self.figures()), "field")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        weight = F.coalesce(F.element_at(F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w))))), F.col("field")), F.lit(0.0))
        return rows.groupBy(self.key).agg(F.sum(F.round(weight * idf * norm, 6).cast("decimal(18,6)")).cast("double").alias("score"))
