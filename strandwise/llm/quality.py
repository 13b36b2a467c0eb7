"""Quality rules: counts per document, and a hashed n-gram likelihood ratio.

Words and neighbouring pairs of words are hashed into ``BUCKETS`` buckets. Two
multinomials are counted over them: one over the trusted documents, one over the whole
raw corpus. A document's score is the mean, over its n-grams, of the log ratio of the
two; it is kept when the score reaches a fixed threshold. Weights are whole millionths,
so sums do not depend on the order of work.

Words are hashed once; pairs are hashes of these hashes, and windows of three mix a pair
with the next word. Windows with equal hashes are then compared word by word, so counts of
repeats are exact.

DataFrame functions only. The corpus is scanned twice: once for the bucket counts, summed
before the shuffle (at most ``BUCKETS`` rows per task), and once for counts and score,
row by row without a shuffle. Functions of array elements are not compiled, so each does
little, and what is needed only for repeats is done only for them. Trusted documents are a
bounded sample of the labelled rows (``TRUSTED``), so that they can be broadcast; bucket
counts cover every document.

Edge cases: a null text has no words (all counts 0, base_failed, score 0); repeated rows
are scored alike; without trusted documents every score is 0 and only the base rules
decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, words_of

#: A power of two.
BUCKETS = 1 << 15
#: Trusted documents taken at most, by smallest hash of their id.
TRUSTED = 20_000
#: Added to each bucket's count.
PRIOR = 1.0
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.2
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(hashed: Column) -> Column:
    """Hash of each word's hash and the next one's, for all words but the last."""
    n = F.greatest(F.size(hashed) - 1, F.lit(0))
    return F.zip_with(F.slice(hashed, 1, n), F.slice(hashed, 2, n), lambda a, b: F.xxhash64(a, b))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of documents labelled good, ``most`` at most: the bound of the sample."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: ``weights``, an array of ``BUCKETS`` log ratios in millionths."""
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("trusted_id")))
    rows = docs.select("doc_id", hashes_of(words_of(text_of())).alias("hashed")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = rows.select(F.col("trusted_id").isNotNull().alias("trusted"), "hashed", pair_hashes(F.col("hashed")).alias("pairs"))
    grams = rows.select("trusted", F.explode(F.concat("hashed", "pairs")).alias("gram"))
    counts = grams.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("trusted").alias("good"))
    none = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    whole = counts.unionByName(none).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    # one row, so that counts and their sums come from one scan
    gathered = whole.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("counts"), F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"))

    def weight(of: Column) -> Column:
        ratio = F.log((of["good"] + PRIOR) / (F.col("good_all") + PRIOR * BUCKETS)) - F.log((of["raw"] + PRIOR) / (F.col("raw_all") + PRIOR * BUCKETS))
        return F.when(F.col("good_all") > 0, F.round(ratio * 1_000_000)).otherwise(0).cast("int")

    return gathered.select(F.transform("counts", weight).alias("weights"))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(F.size(lines).alias("all"), F.size(F.array_distinct(lines)).alias("different"))


def counts(docs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the hashes
    of words and of pairs as ``hashed`` and ``pairs``, and the columns named by ``also``."""
    text = text_of()
    rows = docs.select(
        "doc_id",
        *also,
        words_of(text).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(text).alias("lines"),
    )
    rows = rows.withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long")).withColumn("hashed", hashes_of(F.col("words")))
    # A window of three words is the high bits of its hash, with its place in the low
    # bits: sorting brings windows with equal hashes together.
    place_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("words").cast("long")))) - 1
    rows = rows.withColumn("mask", F.coalesce(place_bits, F.lit(0).cast("long"))).withColumn("high", F.bitwise_not(F.col("mask")))
    rows = rows.withColumn("pairs", pair_hashes(F.col("hashed")))
    windows = F.greatest(F.size("words") - 2, F.lit(0))
    mixed = F.zip_with(F.slice("pairs", 1, windows), F.slice("hashed", 3, windows), lambda pair, third: pair.bitwiseXOR(third))
    rows = rows.withColumn("packed", F.sort_array(F.transform(mixed, lambda x, i: x.bitwiseAND(F.col("high")).bitwiseOR(i.cast("long")))))
    # windows like the next one; if there are any, also those like the one before
    alike = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.col("high")) == 0
    rows = rows.withColumn("before", F.filter("packed", lambda x, k: alike(x, F.get("packed", k + 1))))
    after = F.filter("packed", lambda x, k: alike(x, F.get("packed", k - 1)))
    rows = rows.withColumn("maybe", F.when(F.size("before") > 0, F.array_union("before", after)).otherwise(F.col("before")))

    def spelled(x: Column) -> Column:
        i = x.bitwiseAND(F.col("mask")).cast("int")
        return F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("window"), i.cast("long").alias("at"))

    rows = rows.withColumn("spelled", F.sort_array(F.transform("maybe", spelled)))
    same = lambda x, y: F.coalesce(x["window"] == y["window"], F.lit(False))
    twice = F.filter("spelled", lambda x, k: same(x, F.get("spelled", k + 1)) | same(x, F.get("spelled", k - 1)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # each start covers three words, less what the next start covers again
    covered = F.aggregate(
        F.zip_with(F.col("starts"), F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return rows.select(
        "doc_id",
        *also,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.different")).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        "hashed",
        "pairs",
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, also: Sequence[str] = ()) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``score`` (mean log ratio per
    n-gram), ``kept``, and the columns named by ``also``."""
    # BUCKETS numbers, as one literal: a column of them would be copied into every row
    weights = bucket_weights(docs, trusted).first()["weights"]
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    rows = counts(docs, also)
    add = lambda acc, h: acc + F.get(table, _bucket(h))
    total = F.aggregate("pairs", F.aggregate("hashed", F.lit(0).cast("long"), add), add)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    score = total / (F.greatest(2 * n - 1, F.lit(1)) * 1_000_000.0)
    scored = rows.withColumn("score", F.coalesce(score, F.lit(0.0)))
    verdicts = scored.select(
        "doc_id", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept")
    )
    # small rows, written once: a filter on them must not be pushed into the expressions above
    return stage(verdicts, "verdicts")
