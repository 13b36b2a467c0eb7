"""License scans against a plain version, with and without edits."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strandwise.llm import licenses, queries

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
SMALL = "/root/testdata/sf0.001"


def plain(text):
    """Base places by words; labels by each whole pattern over the whole text."""
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(label, i) for label, phrase in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = f" {' '.join(words)} ".encode().decode("latin-1")
    labels = {label for label, _ in places}
    for label, marked in licenses.BASE + licenses.NOTICES:
        if licenses.notice(label, marked).pattern.search(joined):
            labels.add(label)
    at = [i for _, i in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places})), ",".join(sorted(labels))


def edited(phrase, edits):
    out = list(phrase)
    for _ in range(edits):
        i, kind = random.randrange(len(out)), random.randrange(3)
        if kind == 0:
            out[i] = random.choice("abcxyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, random.choice("abcxyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    noise = lambda: " ".join(random.choice(["lorem", "Dolor", "mit", "under", "the", "license", "é", "2", "cc", "by"]) for _ in range(random.randint(0, 12)))
    phrases = [p.replace("|", "") for _, p in licenses.BASE + licenses.NOTICES]
    out = [(i, f"{noise()}\n{edited(random.choice(phrases), random.randint(0, 4))}. {noise()}") for i in range(150)]
    out += [(200, None), (201, ""), (202, " \n\t-!"), (203, "Under the\nMIT-License, under the mit license; under THE mit license"), (204, "sunder the mit license"), (205, "CC BY-NC 4.0 cc by nc"), (206, "under the mpl license"), (207, "Apache License, Version 1.1"), (208, "Released under the MIT Licence"), (None, "cc by nc"), (203, "cc by nc")]
    return out


def test_against_a_plain_version(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("labels", "score", "spans", "n_words")}).repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_scan(frame).collect())
    assert [str(x) for x in got] == [str(x) for x in sorted((str(d), *plain(t)) for d, t in rows)]


def test_spans_and_scores(spark):
    rows = [(1, "x. Released under the MIT Licence, y"), (2, "under the mit license"), (3, "nothing here"), (4, "w " * 300_000 + "under the mit license " * 2)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[1].spans] == [("mit", 2, 4, 1)] and 0.9 < got[1].score < 1 and not got[1].n_base
    assert [tuple(s) for s in got[2].spans] == [("mit", 0, 4, 0)] and got[2].score == 1
    assert got[3].score == 0 and got[3].labels == "" and got[3].first_word is None
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].last_word) == (300_008, 2, 300_000, 300_004)
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_given_table(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    got = queries.op13_license_scan(spark, SMALL).collect()
    assert len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        want = plain(texts[r.doc_id][:3000])  # whole patterns over long texts take hours
        if len(texts[r.doc_id]) <= 3000:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want
