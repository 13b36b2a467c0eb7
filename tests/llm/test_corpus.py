"""The corpus operators against plain versions, and on odd input."""

from __future__ import annotations

import base64
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.llm import ann, bpe, common, jaccard_join, language_model, line_dedup, mixing, quality, queries, secrets, suffix_dedup, toxicity
from strandwise.llm.components import components
from strandwise.llm.levels import LevelFamily

from . import brute

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those that operators make."""
    frame = spark.createDataFrame(rows, DDL)
    clash = "n n_words size kept spans gone block words text_ bucket order copies lang label h".split()
    return frame.withColumns({c: F.lit("x") for c in clash}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(80)] + [(None, 1, 1), (7, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_suffix_dedup(docs, rows, empty):
    got = by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_shorter_strings(docs, rows):
    got = by_id(suffix_dedup.suffix_dedup(docs, length=40, gram=12), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows, 40)


def test_suffix_dedup_passage_in_many_contexts(spark):
    """No key gathers the contexts of a passage, and every string is still judged."""
    random.seed(5)
    letters = "abcdefghijklmnop "
    noise = lambda n: "".join(random.choice(letters) for _ in range(n))
    passage = noise(230)
    rows = [(i, noise(random.randint(0, 150)) + passage + noise(random.randint(0, 150)), "s") for i in range(400)]
    part = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "tag": pa.array([0] * len(rows), pa.int32()), "text": [r[1] for r in rows]})]
    dealt = pa.Table.from_batches(suffix_dedup._anchors(100, 28)(iter(part))).to_pandas()
    assert dealt.groupby("h").size().max() <= 100  # places of one document at most
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DDL).repartition(6))
    assert by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_suffix_dedup_repeated_rows(spark, rows):
    """Rows with one doc_id keep their text; each loses what repeats in its own text."""
    want = brute.repeats(rows)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for parts in (1, 7):
        found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows + rows, DDL).repartition(parts)).collect()
        assert len(found) == 2 * len(rows) and all(tuple(r[k] for k in names) == want[r.doc_id] for r in found)
    random.seed(6)
    a, b = ("".join(random.choice("abcdefgh") for _ in range(150)) for _ in range(2))
    texts = [(1, a + b, "s"), (1, a + b[:-1], "s"), (1, b + a, "s"), (1, "x" + a, "s")]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(texts, DDL), with_text=True).collect()
    # strings of b start earliest in the third text, those of a in the first three
    kept = {bytes(r.kept).decode() for r in found}
    assert {r.n_removed for r in found if r.n_bytes == 151} == {150}
    assert kept == {a, "x", b}


def test_suffix_dedup_segments(monkeypatch):
    """A text beyond one segment has the same runs as in one piece."""
    random.seed(2)
    data = np.array([random.choice(b"abcd") for _ in range(5000)], np.uint8)
    offsets = np.array([0, len(data)])
    whole = {(int(s) + k, int(h)) for h, _, _, s, n in zip(*suffix_dedup.runs_of(data, offsets, 50, 10)) for k in range(int(n))}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = set()
    for at, stop, inner in suffix_dedup._segments(offsets, 50):
        for h, _, _, s, n in zip(*suffix_dedup.runs_of(data[at:stop], inner, 50, 10)):
            parts |= {(at + int(s) + k, int(h)) for k in range(int(n))}
    assert parts == whole


def test_levels_merge_geometrically():
    family = LevelFamily(lambda r: np.argsort(r["k"]))
    for i in range(64):
        family.add({"k": np.sort(np.random.default_rng(i).integers(0, 10**6, 100))})
    assert len(family.levels) <= 7
    assert sum(len(x["k"]) for x in family.levels) == 6400
    assert all((np.diff(x["k"]) >= 0).all() for x in family.levels)


def test_secret_base_spans(docs, rows, empty):
    found = secrets.secrets(docs)
    kind = lambda k: F.size(F.filter("base", queries._is_kind(k)))
    got = by_id(found.select("doc_id", kind(0).alias("a"), kind(1).alias("b"), kind(2).alias("c"), F.sha2(secrets.span_text(F.col("base")), 256).alias("s")), "a", "b", "c", "s")
    assert got == {d: brute.secrets(t) for d, t, _ in rows}
    spans = by_id(found, "base", "spans")
    assert all(set(b) <= set(s) for b, s in spans.values())
    assert secrets.secrets(empty).count() == 0


def test_randomness_battery(spark):
    random.seed(4)
    hexes = ["".join(random.choice("0123456789abcdef") for _ in range(48)) for _ in range(300)]
    plain = ["0123456789abcdef" * 3, "deadbeef" * 6, "a1" * 24]
    rows = spark.createDataFrame([(x,) for x in hexes + plain], "t string")
    size = secrets._alphabet(F.col("t"))
    got = {r.t: r.p for r in rows.withColumn("size", size).withColumn("codes", secrets._codes(F.col("t"), F.col("size"))).select("t", secrets.randomness_p(F.col("codes"), F.col("size")).alias("p")).collect()}
    assert sum(got[x] < 0.05 for x in hexes) < 40
    assert all(got[x] < 0.01 for x in plain)


def test_randomness_battery_against_a_plain_version(spark):
    random.seed(12)
    rows = []
    for size, letters in brute.ALPHABETS.items():
        for n in (8, 11, 16, 31, 64, 200):
            rows += [("".join(random.choice(letters) for _ in range(n)), size), ("".join(random.choice(letters[:7]) for _ in range(n)), size), (letters[3] * n, size)]
    frame = spark.createDataFrame(rows, "t string, size int")
    got = frame.select("t", "size", secrets.randomness_p(secrets._codes(F.col("t"), F.col("size")), F.col("size")).alias("p")).collect()
    assert all(r.p == pytest.approx(brute.randomness(r.t, r.size), abs=2e-6) for r in got)


def _planted():
    """Documents of prose, each with one token; (doc_id, text), and the secrets' places."""
    random.seed(14)
    alphabets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": brute.ALPHABETS[64], "url": brute.ALPHABETS[64][:-2] + "-_"}
    secret = {}
    for kind, letters in alphabets.items():
        for n in (16, 20, 24, 28, 40, 64, 100, 200):
            secret |= {len(secret): (kind, n, "".join(random.choice(letters) for _ in range(n))) for _ in range(1)}
            for _ in range(5):
                secret[len(secret)] = (kind, n, "".join(random.choice(letters) for _ in range(n)))
    piece = ["user", "Config", "handler", "Value", "index", "Token", "parse", "Table", "count", "Stream", "buffer", "Node"]
    word = lambda k: [random.choice(piece) for _ in range(k)]
    other = []
    for i in range(60):
        other += [
            "%08x-%04x-4%03x-a%03x-%012x" % tuple(random.getrandbits(b) for b in (32, 16, 12, 12, 48)),
            "/usr/lib/" + "/".join(word(4)) + str(i), "https://www.example.org/" + "/".join(word(3)) + f"/{i}", "_".join(word(3)) + str(i), "".join(x.capitalize() for x in word(4)) + "2",
            f"2024-01-{i % 28 + 1:02d}T10-{i:02d}-00", str(random.getrandbits(60)), "abc" * 8 + "1", "".join(word(5)), "deadbeef" * 4,
        ]
    prose = lambda: " ".join("".join(random.choice(["er", "an", "th", "in", "re", "on"]) for _ in range(random.randint(1, 6))) for _ in range(60))
    docs = [(i, f"{prose()} {t} {prose()}") for i, (_, _, t) in secret.items()] + [(10_000 + i, f"{prose()} {t} {prose()}") for i, t in enumerate(other)]
    return docs, secret


def test_planted_secrets_and_what_only_looks_like_one(spark):
    docs, secret = _planted()
    got = {r.doc_id: [x for x in r.spans if x.kind in (2, 3)] for r in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    hit = {i: any(text[i][x.start : x.stop] == t for x in got[i]) for i, (_, _, t) in secret.items()}
    long = [hit[i] for i, (_, n, _) in secret.items() if n >= 24]
    short = [hit[i] for i, (_, n, _) in secret.items() if n < 24]
    false = sum(len([x for x in spans if x.kind == 3]) for i, spans in got.items() if i >= 10_000)
    added = sum(len([x for x in spans if x.kind == 3]) for spans in got.values())
    assert np.mean(long) >= 0.9 and np.mean(short) >= 0.6
    assert false <= 0.1 * added


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(3000))
    spans = secrets.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base
    assert [(x.start, x.stop) for x in spans] == [(15 * i, 15 * i + 14) for i in range(3000)]
    assert "match" not in str(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).schema)


def test_added_spans_find_tokens(spark):
    random.seed(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "see " + "".join(random.choice(letters) for _ in range(40)) + " end") for i in range(100)] + [(1000 + i, "word" + "xy1" * 12 + f" {i}") for i in range(100)]
    got = by_id(secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")), "spans")
    assert sum(bool(got[i][0]) for i in range(100)) >= 80
    assert sum(bool(got[1000 + i][0]) for i in range(100)) <= 5


def test_combined_p_is_uniform(spark):
    random.seed(9)
    rows = [("".join(random.choice("0123456789abcdef") for _ in range(160)),) for _ in range(600)]
    p = secrets.randomness_p(secrets._codes(F.col("t"), F.lit(16)), F.lit(16))
    got = np.array([r.p for r in spark.createDataFrame(rows, "t string").select(p.alias("p")).collect()])
    assert (got > 0.999).mean() < 0.05 and abs((got > 0.5).mean() - 0.5) < 0.12


def test_cut_keeps_false_discoveries_within_the_rate():
    rng = np.random.default_rng(1)
    bins = lambda p: np.bincount(np.minimum((p * 20).astype(int), 19), minlength=20).astype(float)
    plain, uniform = rng.random(2000) ** 6, rng.random(1000)
    # only tokens that are not random: nothing passes, though some lie above one half
    assert secrets.cut_of(bins(rng.random(1000) ** 6), bins(plain), 0.01) is None
    other = rng.random(1000) ** 6
    cut = secrets.cut_of(bins(np.concatenate((uniform, other))), bins(plain), 0.2)
    assert cut is not None and (other >= cut).sum() <= 0.25 * ((other >= cut).sum() + (uniform >= cut).sum())
    # a lone token meets the cut that letter tokens set
    assert secrets.cut_of(bins(np.array([0.97])), bins(plain**3), 0.1) < 0.5


def test_lone_and_short_secrets(spark):
    random.seed(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n: "".join(random.choice(letters) for _ in range(n))
    for n in (70, 20):
        found = secrets.secrets(spark.createDataFrame([(1, f"see {token(n)} end")], "doc_id long, text string")).first().spans
        assert len(found) == 1


def test_quality_counts(docs, rows, labels, empty):
    out = quality.quality_rules(docs, quality.trusted_ids(labels))
    got = by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality(t) for d, t, _ in rows}
    assert not any(k and f for f, k in by_id(out, "base_failed", "kept").values())
    assert quality.quality_rules(empty, quality.trusted_ids(labels)).count() == 0
    none = labels.where("false")
    assert by_id(quality.quality_rules(docs, quality.trusted_ids(none)), "kept") == {d: (not brute.quality(t)[5],) for d, t, _ in rows}


def test_quality_score(spark, docs, rows, labels):
    """The score from weights, n-gram by n-gram."""
    trusted = quality.trusted_ids(labels)
    weights = quality.bucket_weights(docs, trusted).first().weights
    assert len(weights) == quality.BUCKETS
    score = by_id(quality.quality_rules(docs, trusted), "score")
    words = {d: brute.WORD.findall(t or "") for d, t, _ in rows}
    grams = [(d, w, None) for d, ws in words.items() for w in ws] + [(d, a, b) for d, ws in words.items() for a, b in zip(ws, ws[1:])]
    own = F.xxhash64("a")
    bucket = quality._bucket(F.when(F.col("b").isNull(), own).otherwise(F.xxhash64(own, F.xxhash64("b"))))
    found = spark.createDataFrame(grams, "d long, a string, b string").select("d", bucket.alias("bucket")).toPandas()
    # weights from plain counts
    good = set(r.doc_id for r in trusted.collect())
    every, known = np.bincount(found.bucket, minlength=quality.BUCKETS), np.bincount(found.bucket[found.d.isin(good)], minlength=quality.BUCKETS)
    want = np.log((known + 1) / (known.sum() + quality.BUCKETS)) - np.log((every + 1) / (every.sum() + quality.BUCKETS))
    assert np.abs(np.array(weights) - want * 1e6).max() <= 1
    means = found.assign(w=np.array(weights)[found.bucket] / 1e6).groupby("d").w.mean()
    kept = by_id(quality.quality_rules(docs, trusted), "kept")
    for d, t, _ in rows:
        mean = means.get(d, 0.0)
        assert score[d][0] == pytest.approx(mean, abs=1e-9)
        assert kept[d][0] == (not brute.quality(t)[5] and mean >= quality.THRESHOLD)


def test_repeats_when_window_hashes_meet(spark, monkeypatch):
    """Different windows with one hash, mixed among equal ones, change no count."""
    monkeypatch.setattr(quality, "hashes_of", lambda words: F.transform(words, lambda w: F.lit(1).cast("long")))
    text = "a b c d e f g a b c x y z q r s x y z"
    frame = spark.createDataFrame([(1, text, "s")], DDL)
    assert quality.counts(frame).first().n_repeat_words == brute.quality(text)[4] == 12


def test_quality_weights_read_the_corpus_once(docs, labels):
    """Counts and their sums come from one pass over the n-grams, which holds its arrays once."""
    weights = quality.bucket_weights(docs, quality.trusted_ids(labels))
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bGenerate explode", plan)) == 1
    assert len(re.findall(r"\btransform\(filter\(split", plan)) == 1


def test_quality_counts_of_few_words_and_overlapping_repeats(spark):
    random.seed(3)
    texts = [None, "", " ", "a", "a a", "a a a", "a a a a", "a b a b a b", " a\tb \x0b c\x0c\r\nd ", "é ü\xa0x é ü\xa0x é", "a b c x a b c"]
    texts += [" ".join(random.choice("abc") for _ in range(n)) for n in range(3, 60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(quality.counts(frame), *names) == {d: brute.quality(t)[:5] for d, t in enumerate(texts)}


def test_quality_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_rules(docs, quality.trusted_ids(labels)).where("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.s for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_near_duplicates(docs, rows, empty):
    got = by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id")
    assert got == brute.components(rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_near_duplicates_with_repeated_ids(spark, rows):
    """Rows of one id with other texts: one of them stands for the id in every run."""
    a, b = rows[0][1] + " tail one", rows[4][1] + " tail two"
    frame = spark.createDataFrame([*rows[:12], *rows[:12], (500, a, "s"), (500, b, "s"), (501, a, "s"), (502, b, "s")], DDL)
    got = [sorted(map(tuple, jaccard_join.near_duplicates(frame.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 28
    component = {r[0]: r[3] for r in got[0]}
    assert component[501] != component[502] and component[500] in (component[501], component[502])


def test_bands_lose_no_link():
    """Sizes at the edge of what may link stay within reach of each other."""
    import math

    for n in range(1, 3000):
        m = 100 * n // 80  # the largest partner
        step = math.log(1.25)
        assert math.floor(math.log(m) / step) <= math.floor((math.log(n) + step + 1e-9) / step)
        assert math.floor((math.log(m) - step - 1e-9) / step) <= math.floor(math.log(n) / step)


def test_near_duplicates_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (300,))
    monkeypatch.setattr(common, "HOT", 40)
    monkeypatch.setattr(jaccard_join, "MERGE_MOST", 10)
    got = by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id")
    assert got == brute.components(rows)


def test_whole_sets_are_shuffled_once_a_step(docs, rows, monkeypatch):
    """No broadcast stands in for a shuffle: whole sets move once to their ids and once to
    their blocks at every size, and what no later job reads is deleted."""
    spark, exchanges, staged = docs.sparkSession, {}, {}

    def stage(df, name):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        staged[name] = common.stage(df, name)
        return staged[name]

    monkeypatch.setattr(jaccard_join, "stage", stage)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute.components(rows)
    assert exchanges["sets"] == 2 and exchanges["found"] == 2
    left = {n for n, df in staged.items() if os.path.exists(df._strandwise_path.removeprefix("file:"))}
    assert not left & {"representatives", "kept", "sets", "met", "blocks"}


def test_blocks_leave_out_sets_that_meet_no_other(spark):
    """A block of one set that asks for itself is none; all others are kept, and cut."""
    members = spark.createDataFrame([(1, 3, 20, False), (2, 3, 20, True), (3, 3, 20, False), (3, 3, 30, False), (4, 3, 20, False)], "family long, band int, size int, settled boolean")
    asking = spark.createDataFrame([(1, 3, 20), (2, 3, 20), (3, 3, 20), (3, 3, 30), (3, 4, 30), (4, 3, 20), (4, 3, 90)], "family long, band int, size int")
    got = {tuple(r) for r in jaccard_join.blocks_of(members, asking, 25).collect()}
    assert got == {(2, 3, 1, 1), (3, 3, 2, 2), (4, 3, 1, 5)}


def test_divide_skip_against_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50))) for _ in range(120)]
    index = jaccard_join.InvertedLists(sets)
    for percent in (50, 80):
        for s in sets:
            want = [i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))]
            assert sorted(jaccard_join.divide_skip(index, s, percent).tolist()) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (300, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_line_dedup(docs, rows, empty):
    got = by_id(line_dedup.line_dedup(docs), "n_lines", "n_dropped", "kept")
    assert got == brute.lines(rows)
    assert by_id(line_dedup.line_dedup(docs, batches=7), "kept") == {d: (k,) for d, (_, _, k) in brute.lines(rows).items()}
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_with_repeated_ids(spark, monkeypatch):
    """Each row loses its own lines, whatever other rows its id has."""
    shared, lone = "this line is shared by a good many documents of the corpus", "this line stands once in the whole corpus and must stay there"
    rows = [(1, f"{shared}\nalpha"), (1, f"{lone}\nzeta"), (1, f"{lone}\nzeta"), (9, shared), (9, f"x\n{shared}"), *((i, f"{shared} \ny{i}") for i in range(2, 7))]
    for hot in (common.HOT, 2):
        monkeypatch.setattr(common, "HOT", hot)
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted([(1, 2, 1, "alpha"), (1, 2, 0, f"{lone}\nzeta"), (1, 2, 0, f"{lone}\nzeta"), (9, 1, 0, shared), (9, 2, 0, f"x\n{shared}"), *((i, 2, 1, f"y{i}") for i in range(2, 7))])


def test_line_runs_outlive_a_call(spark, rows):
    """A later batch meets the runs of an earlier session."""
    frame = spark.createDataFrame(rows, DDL)
    first, second = frame.where("doc_id % 2 = 0"), frame.where("doc_id % 2 = 1")
    runs = line_dedup.LineRuns()
    line_dedup.dropped_lines(first, runs=runs)
    runs = line_dedup.LineRuns.open(spark, runs.manifest())
    gone = {r.doc_id: list(r.gone) for r in line_dedup.dropped_lines(second, runs=runs).collect()}
    want = {r.doc_id: list(r.gone) for r in line_dedup.dropped_lines(frame).collect()}
    assert gone == {d: g for d, g in want.items() if d % 2}


def test_replaced_line_runs_stay_until_released(spark):
    """What the last saved manifest names is there until the caller has saved a new one."""
    frame = lambda i: spark.createDataFrame([(100 * i + k, "\n".join(f"line {i} {k} {j} of some forty characters or more" for j in range(3)), "s") for k in range(4)], DDL)
    runs = line_dedup.LineRuns(fan_in=2)
    line_dedup.dropped_lines(frame(0), batches=2, runs=runs)
    saved = runs.manifest()
    line_dedup.dropped_lines(frame(1), batches=2, runs=runs)  # compacts; then the job dies
    again = line_dedup.LineRuns.open(spark, saved)
    assert runs.replaced and again.counts().count() == 12
    assert runs.counts().count() == 24
    runs.release()
    assert not runs.replaced and runs.counts().count() == 24


def test_join_counted_keeps_every_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k long, v long")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("k != 4")
    for hot in (10_000, 5, 1):
        monkeypatch.setattr(common, "HOT", hot)
        got = sorted((r.k, r.v, r.top) for r in common.join_counted(rows, keys, ["k"], "n", 300).collect())
        assert got == sorted((r.k, r.v, r.top) for r in rows.join(keys, "k").collect()) and len(got) < 300


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((400, 32)).astype(np.float32)
    vectors[50:90] = vectors[50]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [float("inf")] * 32), (905, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    exact = vectors.astype(np.float64)
    for block, chunk in ((8192, 4096), (64, 7)):
        got = {}
        for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, block=block, chunk=chunk).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert sorted(got) == list(range(0, 400, 20))
        hits = 0
        for q, found in got.items():
            score = (exact * exact[q]).sum(axis=1)
            score[q] = -np.inf
            best = np.lexsort((np.arange(400), -score))[:20]
            assert [f[0] for f in sorted(found)] == list(range(1, 21))
            assert all(s == score[v] for _, v, s in found)
            hits += len({f[1] for f in found} & set(best.tolist()))
        assert hits / (20 * len(got)) >= 0.95
    assert ann.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(frame.where("vec_id < 5"), F.lit(True)).count() == 20


def test_nearest_with_repeated_ids(spark):
    """Of rows with one id the smallest vector stands, in every run."""
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(3, [-50.0, 0.0]), (4, [500.0, 0.0]), (0, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [sorted(map(tuple, ann.nearest(frame.repartition(n), F.col("vec_id") == 0, k=28).collect())) for n in (1, 6)]
    assert got[0] == got[1]
    # 28 of the 29 others: the one that is missing is 3, whose smallest vector is far away
    assert {v: s for _, _, v, s in got[0]} == {i: i + 2.0 for i in range(1, 30) if i != 3}


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_nearest_on_given_tables(spark, scale):
    """Recall against brute force, and how much the codes leave to compare."""
    frame = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    table = frame.toPandas()
    exact = np.array(table.embedding.tolist(), dtype=np.float64)
    ids = table.vec_id.to_numpy()
    query = F.col("vec_id") % 20 == 0
    found = ann.nearest(frame, query).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = exact @ exact[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(found.vec_id[found.query_id == q]))
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.95
    asked = ann.looked_at(frame, query)[1].agg(F.sum(F.size("ids"))).first()[0]
    assert asked < 0.2 * len(ids) * (ids % 20 == 0).sum()


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(6)
    for dim in (64, 40):
        vectors, asked = rng.standard_normal((500, dim)), rng.standard_normal((50, dim))
        centre, rotate = vectors.mean(axis=0), ann.rotations(dim)
        codes = ann.Codes.of(vectors, centre, rotate)
        assert codes.words.shape == (500, ann.ROTATIONS) and np.allclose(rotate @ rotate.T, np.eye(dim))
        for level in (0, 1):
            errors = []
            for q in asked:
                estimate, width = ann.Query(q, centre, rotate).bounds(codes, level, 1.0)
                errors.append((estimate - vectors @ q) / width)
            # about one standard deviation, and within the bounds as often as these promise
            assert 0.85 < np.std(errors) < 1.15 and (np.abs(errors) <= ann.EPSILON).mean() > 0.94


def test_language_model_base(docs, rows, empty):
    out = language_model.language_model_scores(docs, block_bytes=20_000)
    got = by_id(out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for d, want in brute.unigrams(rows).items():
        assert got[d][:4] == want[:4]
        assert got[d][4] == pytest.approx(want[4], rel=1e-9)
    assert language_model.language_model_scores(empty).count() == 0


def test_language_model_beats_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_model.language_model_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.3


def test_language_model_against_a_plain_version(docs, rows):
    """Scores token by token, and every factor sums to one."""
    L = language_model
    learned = L.learn(docs, block_bytes=50_000)
    model = learned.model
    score = by_id(L.language_model_scores(docs, block_bytes=50_000), "score")
    held = {d: brute.unigrams([(d, t)])[d][0] for d, t, _ in rows}
    counts = Counter(w for d, t, _ in rows if not held[d] for w in [*brute.WORD.findall((t or "").translate(brute.AZ)), None])

    def places(words):
        """Class, part and bucket of each token of a document."""
        text = " ".join(w for w in words if w is not None).encode()
        tokens = L.tokens_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return model.classes.of(tokens), L.part_of(tokens.word), tokens

    sizes, distinct = np.zeros((L.CLASSES, L.PARTS)), np.zeros((L.CLASSES, L.PARTS))
    for w, n in counts.items():
        own, part, _ = places([w, None] if w is not None else [None])
        sizes[own[0], part[0]] += n
        distinct[own[0], part[0]] += 1
    assert np.allclose(10.0**model.inside, sizes + distinct + 1)
    # the tokens of a part and one unknown token; the parts of a class; all classes
    assert np.allclose((sizes + distinct + 1) / 10.0**model.inside, 1) and np.allclose((10.0**model.parts).sum(axis=2), 1, atol=1e-4)
    for d, t, _ in rows[::7]:
        words = [*brute.WORD.findall((t or "").translate(brute.AZ)), None]
        own, part, tokens = places(words)
        assert len(own) == len(words)
        total = 0.0
        for i, w in enumerate(words):
            past = [own[i - k] if i >= k else L.CLASSES for k in (1, 2, 3, 4)]
            logit = model.pair[past[0] * L.SIDES + past[1]].astype(float) + model.skip[past[2] * L.SIDES + past[3]] + model.bias
            p = np.exp(logit) / np.exp(logit).sum()
            row = int(model.classes.history(tokens, own)[2][i])
            total += math.log10(p[own[i]]) + model.parts[row, own[i], part[i]] + math.log10(counts[w] + 1) - model.inside[own[i], part[i]]
        assert score[d][0] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_more_rounds_fit_better(docs):
    """The gradient raises the likelihood of the classes of training text, less the prior's share."""
    L = language_model
    texts = docs.select("doc_id", "text")
    fit = [L.learn(docs, rounds=n).model for n in (1, 6)]
    rows = [r.text or "" for r in texts.where(~L.held_out()).collect()]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    tokens = L.tokens_of(data, np.concatenate(([0], np.cumsum([len(t.encode()) for t in rows]))))
    likelihood = []
    for model in fit:
        own = model.classes.of(tokens)
        pair, skip, _ = model.classes.history(tokens, own)
        found = L.log_softmax(model.pair, model.skip, model.bias, (pair, skip))[np.arange(len(own)), own].sum(dtype=float)
        likelihood.append(found - L.RIDGE / 2 * ((model.pair.astype(float) ** 2).sum() + (model.skip.astype(float) ** 2).sum()))
    assert likelihood[1] > likelihood[0]


def test_history_stays_inside_documents():
    texts = ["a b c", "", "d", "e f g h i j"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    tokens = language_model.tokens_of(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    values = np.arange(len(tokens.word))
    for far in (1, 2, 3, 4):
        assert tokens.before(values, far, -1).tolist() == [i - far if i - far >= tokens.first[tokens.doc[i]] else -1 for i in range(len(values))]


def test_mixing(docs, rows, empty):
    out = mixing.mix_documents(docs)
    first = by_id(out, "source", "size", "source_size", "target", "taken", "copies")
    assert first == by_id(mixing.mix_documents(docs.repartition(5)), "source", "size", "source_size", "target", "taken", "copies")
    assert len(first) == len(rows)
    sources = {}
    for d, (s, size, source_size, target, taken, _) in first.items():
        assert size == len(brute.WORD.findall(dict((r[0], r[1]) for r in rows)[d] or "")) and 0 <= taken <= 2 * size
        sources.setdefault(s, [source_size, target, 0, 0])
        sources[s][2] += taken
        sources[s][3] = max(sources[s][3], size)
    total = sum(s[0] for s in sources.values())
    assert sum(s[1] for s in sources.values()) == pytest.approx(1.5 * total)
    weights = {s: w for s, w in zip(sorted(sources, key=lambda x: (x is None, x or "")), [5, 2, 1] * 9)}
    levels = {round(t / weights[s], 6) for s, (n, t, _, _) in sources.items() if t < 2 * n - 1e-9}
    assert len(levels) == 1  # sources below their cap share one level
    assert all(abs(taken - target) <= largest for _, target, taken, largest in sources.values())
    assert mixing.mix_documents(empty).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(tiktoken_encoding, rows):
    own = bpe.encoder(*bpe.default_vocabulary())
    random.seed(1)
    odd = "ab c  \n\t\x1c\x85\xa0　é'sdltrv0１²ⅷ你ß\U0001f600.,-​ \x0b\x1f"
    texts = [t or "" for _, t, _ in rows] + ["".join(random.choice(odd) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(random.choice("aeinrst hTHE") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    for text in texts:
        ids = tiktoken_encoding.encode_ordinary(text)
        assert own.encode(text) == ids
        assert own.digest(text) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))


def test_bpe_round_trip(docs, rows, empty):
    path, pattern = bpe.default_vocabulary()
    ids = bpe.token_ids(docs, path, pattern)
    assert by_id(bpe.decode_ids(ids, path, pattern), "bytes") == {d: ((t or "").encode(),) for d, t, _ in rows}
    digests = by_id(bpe.token_digests(docs, path, pattern), "n_tokens", "decoded_sha256")
    assert digests == {r["doc_id"]: (len(r["ids"]), brute.sha(dict((a, b) for a, b, _ in rows)[r["doc_id"]] or "")) for r in ids.collect()}
    assert bpe.token_digests(empty, path, pattern).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    model = toxicity.fit(docs, seen)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    r = out.agg(F.avg(((F.col("toxic") == (F.col("y") == 1))).cast("int")), F.avg(F.when(F.col("y") == 0, F.col("toxic").cast("int"))), F.avg(F.when(F.col("y") == 1, F.col("toxic").cast("int")))).first()
    # about 200 toxic rows to learn from
    assert r[0] > 0.95 and r[1] < 0.01 and r[2] > 0.6


def test_toxicity_against_a_plain_version(docs, rows, labels):
    """Severity, grade and call of every document from its set of words and pieces."""
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert weight

    def bucket(piece: bytes, word: bool) -> int:
        data = np.frombuffer(piece, np.uint8)
        hashed = toxicity.Hasher(data).ranges(np.array([0]), np.array([len(data)]))[0]
        return (int(hashed) * (3 if word else 1) % 2**64 >> 40) % toxicity.BUCKETS

    got = by_id(toxicity.score(docs, model), "severity", "p_toxic", "grade", "toxic")
    for d, t, _ in rows:
        data = (t or "").encode()
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
        words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
        found = {bucket(w, True) for w in words} | {bucket(w[i : i + toxicity.PIECE], False) for w in words for i in range(len(w) - toxicity.PIECE + 1)}
        s = sum(weight.get(f, 0.0) for f in found)
        over = [1 / (1 + math.exp(min(50, max(-50, cut - s)))) for cut in model.thresholds]
        shares = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
        assert got[d][0] == pytest.approx(sum(over), abs=1e-9) and got[d][1] == pytest.approx(over[0], abs=1e-9)
        assert got[d][2] == int(np.argmax(shares)) and got[d][3] == (over[0] >= 0.5)


def test_ordinal_fit_ends_where_the_likelihood_is_flat():
    """Against the plain likelihood: no small step from the fit raises it."""
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 200)
    rows = [np.flatnonzero(rng.random(5) < (0.2 + 0.2 * g)) for g in grades]
    ridge = 1e-2
    weights, cuts = toxicity.fit_ordinal(rows, grades, 5, rounds=1500, ridge=ridge)

    def likelihood(w, c):
        total = 0.0
        for r, g in zip(rows, grades):
            over = [1.0, *(1 / (1 + math.exp(-(w[r].sum() - k))) for k in c), 0.0]
            total += math.log(over[g] - over[g + 1])
        return total / len(rows) - ridge * (w @ w) / 2

    best = likelihood(weights, cuts)
    for i in range(5):
        for step in (-0.05, 0.05):
            assert likelihood(weights + step * np.eye(5)[i], cuts) < best + 1e-6
    for i in range(2):
        for step in (-0.05, 0.05):
            assert likelihood(weights, cuts + step * np.eye(2)[i]) < best + 1e-6


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 600)
    rows = [np.flatnonzero(rng.random(6) < (0.1 + 0.25 * g)) for g in grades]
    weights, cuts = toxicity.fit_ordinal(rows, grades, 6)
    assert (np.diff(cuts) > 0).all() and (weights > 0).all()
    score = np.array([weights[r].sum() for r in rows])
    expected = (1 / (1 + np.exp(-(score[:, None] - cuts)))).sum(axis=1)
    means = [expected[grades == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_toxicity_on_odd_input(docs, rows, labels, empty):
    assert toxicity.toxicity(docs, labels).count() == len(rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    clean = labels.where("toxic = 0")
    assert toxicity.toxicity(docs, clean).where("toxic").count() == 0


def test_repeated_rows_and_null_ids(spark, rows, labels):
    """Repeated rows give repeated results, and rows without an id a result of their own."""
    one, other = rows[:6], [(None, rows[0][1], "s1"), (None, None, None)]
    once, twice = (spark.createDataFrame(x, DDL) for x in ([*one, *other], [*one, *one, *other]))
    trusted = quality.trusted_ids(labels)
    values = lambda frame, *c: sorted([tuple(r[k] for k in c) for r in frame.collect()], key=str)
    doubled = lambda found: sorted([x for x in found for _ in range(1 if x[0] is None else 2)], key=str)

    def suffixes(x):
        return values(suffix_dedup.suffix_dedup(x), "doc_id", "n_bytes", "n_removed", "kept_sha256")

    assert suffixes(twice) == doubled(suffixes(once))
    found = [values(secrets.secrets(x), "doc_id", "base") for x in (once, twice)]
    assert found[1] == doubled(found[0])
    names = ("doc_id", "n_words", "n_repeat_words", "base_failed")
    assert values(quality.quality_rules(twice, trusted), *names) == doubled(values(quality.quality_rules(once, trusted), *names))
    names = ("doc_id", "n_shingles", "component_id")
    assert values(jaccard_join.near_duplicates(twice), *names) == doubled(values(jaccard_join.near_duplicates(once), *names))
    names = ("doc_id", "n_lines", "n_dropped", "kept")
    assert values(line_dedup.line_dedup(twice), *names) == doubled(values(line_dedup.line_dedup(once), *names))
    names = ("doc_id", "held_out", "n_tokens", "n_known")
    assert values(language_model.language_model_scores(twice), *names) == doubled(values(language_model.language_model_scores(once), *names))
    assert values(mixing.mix_documents(twice), "doc_id", "size") == doubled(values(mixing.mix_documents(once), "doc_id", "size"))
    names = ("doc_id", "n_tokens", "ids_sha256")
    digests = [values(bpe.token_digests(x, *bpe.default_vocabulary()), *names) for x in (once, twice)]
    assert digests[1] == doubled(digests[0])
    model = toxicity.fit(once, labels)
    assert values(toxicity.score(twice, model), "doc_id", "severity") == doubled(values(toxicity.score(once, model), "doc_id", "severity"))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("extra", F.lit("kept"))
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    first = {r.doc_id: r.text for r in kept.collect()}
    assert first and all(text[d] == t and not brute.quality(t)[5] for d, t in first.items())
    second = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, kept, SMALL).collect()}
    assert second == {d: (t, len(t)) for d, (_, _, t) in brute.lines(list(first.items())).items()}
    third_frame = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([(d, t, "en", f"s{d % 3}", n, "kept") for d, (t, n) in second.items()], docs.schema), SMALL)
    third = {r.doc_id for r in third_frame.collect()}
    assert third == {d for d, (_, c) in brute.components([(d, t) for d, (t, _) in second.items()]).items() if c == d}
    mixed = corpus_pipeline.mixing_stage(spark, third_frame, SMALL)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    plan = by_id(mixing.mix_documents(third_frame), "copies")
    assert copies == {d: c for d, (c,) in plan.items() if c}
    assert corpus_pipeline.token_stage(spark, mixed, SMALL).count() == mixed.count()


def test_pipeline_keeps_rows_without_an_id(spark):
    """Clean rows without an id pass every stage; repeated ids follow their own texts."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = docs.join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi").where("n_chars > 900").orderBy("doc_id").limit(3)
    lone = good.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("Lone start here. "), "text"))
    twin = good.limit(1).withColumn("text", F.lit("too short"))
    kept = corpus_pipeline.quality_stage(spark, docs.unionByName(lone).unionByName(twin), SMALL)
    assert kept.where("doc_id is null").count() == 1 and kept.where("text = 'too short'").count() == 0
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() == 3
    lines = corpus_pipeline.line_stage(spark, kept, SMALL)
    near = corpus_pipeline.near_duplicate_stage(spark, lines, SMALL)
    assert lines.where("doc_id is null").count() == 1 and near.where("doc_id is null").count() == 1
    mixed = corpus_pipeline.mixing_stage(spark, near.where("doc_id is null"), SMALL)
    assert mixed.count() in (1, 2) and corpus_pipeline.token_stage(spark, mixed, SMALL).count() == mixed.count()


def test_pipeline_on_no_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SMALL)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    from tests.compare import connect, same

    same(queries.QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).sql(queries.ORACLE_SQL[name]).df())
