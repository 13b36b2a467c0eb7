"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys with the number of documents that hold each and the
largest of their ids. Documents come in batches. Each batch is merge-anti-joined with
the runs: keys that no run holds are new, and become the batch's own run; keys that a
run holds already only add to its counts. When a level has ``fan_in`` runs they are
compacted into one of the next level. At the end the runs and the additions of a key
give the exact count.

All of it is DataFrame operations. The texts are read twice, once for the hashes and
once to drop lines; only hashes are dealt by key, summed before the shuffle. The keys to
drop go back to the lines by ``join_counted``, so that a line in a third of all documents
stays where it is. Lines to drop meet their row by id and text.

Edge cases: a null or empty text is one empty line; a line counts once per document; a
tie cannot occur, as ids differ; repeated rows with one id count as one document (also
with different texts, each of which loses its own lines) and all its rows keep the line
where that id is the largest; a null id is kept whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_counted, stage, text_of

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_IN = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["key_a", "key_b"]
_RUN = "key_a long, key_b long, n_docs long, n_rows long, last_doc long"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


def row_tag(text: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text_of(text))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, tag, line, key_a, key_b`` of each line that is long enough; the key is a
    128-bit hash."""
    lines = docs.select("doc_id", row_tag().alias("tag"), F.posexplode(lines_of(text_of())).alias("line", "raw"))
    # the trimmed key is never longer than the line
    keys = lines.where(F.length("raw") >= min_chars).select("doc_id", "tag", "line", line_key(F.col("raw")).alias("key"))
    keys = keys.where(F.length("key") >= min_chars)
    return keys.select("doc_id", "tag", "line", F.xxhash64("key").alias("key_a"), F.xxhash64(F.lit("line"), F.reverse("key")).alias("key_b"))


class LineRuns:
    """Levelled runs in the shared folder. ``manifest`` names their tables, and ``open``
    takes them up again in a later session, so that a new batch meets all earlier ones."""

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []
        self.additions: list[DataFrame] = []
        self.replaced: list[DataFrame] = []

    def release(self) -> None:
        """Deletes runs that compactions have replaced. To be called once a new manifest is
        saved: until then the last saved one names them, and a job that dies is taken up
        again from it."""
        discard(*self.replaced)
        self.replaced = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def manifest(self) -> dict:
        path = lambda df: df._strandwise_path
        return {"fan_in": self.fan_in, "levels": [[path(run) for run in level] for level in self.levels], "additions": [path(x) for x in self.additions]}

    @classmethod
    def open(cls, spark: SparkSession, manifest: dict) -> LineRuns:
        def read(path: str) -> DataFrame:
            df = spark.read.schema(_RUN).parquet(path)
            df._strandwise_path = path
            return df

        out = cls(manifest["fan_in"])
        out.levels = [[read(p) for p in level] for level in manifest["levels"]]
        out.additions = [read(p) for p in manifest["additions"]]
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch``: ``key_a, key_b, n_docs, n_rows, last_doc``, one row per key."""
        runs = self.runs()
        fresh = batch
        if runs:
            batch = stage(batch, "batch")
            # what the runs know already only adds to their counts
            known = [batch.join(run.select(_KEY).hint("merge"), _KEY, "left_semi") for run in runs]
            self.additions.append(stage(reduce(DataFrame.unionByName, known), "additions"))
            fresh = reduce(lambda left, run: left.join(run.select(_KEY).hint("merge"), _KEY, "left_anti"), runs, batch)
        self._put(stage(fresh.repartition(*_KEY).sortWithinPartitions(*_KEY), "run"), 0)
        if runs:
            discard(batch)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._put(stage(reduce(DataFrame.unionByName, old).repartition(*_KEY).sortWithinPartitions(*_KEY), "run"), level + 1)
            self.replaced += old

    def counts(self) -> DataFrame:
        """Every key with its documents, its rows and its largest document id."""
        parts = reduce(DataFrame.unionByName, self.runs() + self.additions)
        return parts.groupBy(_KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.max("last_doc").alias("last_doc"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``doc_id, tag`` and the sorted array ``gone`` of its line numbers (from 0) to drop.

    ``runs``: earlier runs that the batches of ``docs`` are added to; documents must not
    be added twice; the caller saves their new manifest and then calls ``release``.
    """
    of_batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keys = stage(line_keys(docs.where("doc_id is not null"), min_chars).withColumn("batch", of_batch), "lines")
    own = runs is None
    runs = LineRuns() if own else runs
    for b in range(batches):
        mine = keys.where(F.col("batch") == b)
        runs.add(mine.groupBy(_KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.max("doc_id").alias("last_doc")))
        if own:
            runs.release()
    often = stage(runs.counts().where(F.col("n_docs") >= min_docs).drop("n_docs"), "often")
    hits = join_counted(keys.drop("batch"), often, _KEY, "n_rows", keys.count()).where("doc_id != last_doc")
    return hits.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def cut_lines(rows: DataFrame, text: str, gone: str, out: str) -> DataFrame:
    """Adds ``out``: the text without the lines of ``gone`` (sorted numbers, or null),
    cut out range by range. Lines and range ends are columns of their own, so that they
    are worked out once per row."""
    some = F.col(gone).isNotNull()
    rows = rows.withColumn("_sw_lines", F.when(some, lines_of(F.col(text))))
    rows = rows.withColumn("_sw_edges", F.when(some, F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size("_sw_lines")))))

    def between(k: Column) -> Column:
        before, after = F.element_at("_sw_edges", k), F.element_at("_sw_edges", k + 1)
        return F.slice("_sw_lines", before + 2, after - before - 1)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size("_sw_edges") - 1), between)), "\n")
    return rows.withColumn(out, F.when(some, left).otherwise(F.col(text))).drop("_sw_lines", "_sw_edges")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept`` (the text left)."""
    gone = dropped_lines(docs, min_chars, min_docs, batches)
    rows = docs.select("doc_id", row_tag().alias("tag"), text_of().alias("text")).join(gone.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    rows = cut_lines(rows, "text", "gone", "kept")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "kept")
