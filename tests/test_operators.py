"""Fixed vectors, invariants and brute force for what SQL does not pin down."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions.hashing import fnv1a32, hash32, mix32
from strandwise.functions.ordered import ordered
from strandwise.operators import aggregates as D
from strandwise.operators import cohort as C
from strandwise.operators import derived as N
from strandwise.operators import events as O
from strandwise.operators import facets as E
from strandwise.operators import facts as K
from strandwise.operators import joins as Joins
from strandwise.operators import sampling as M
from strandwise.operators import text as J
from strandwise.sources import tables as Sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("", 0x811C9DC5), ("a", 0xE40C292C), ("7|GSM100", 3090295242)])
def test_fnv_vectors(spark, text, want):
    assert one(spark, fnv1a32(F.lit(text))) == want
    assert M.fnv1a(text) == want


def test_stream_vectors():
    assert [int(u * 2**32) for u, _ in zip(M._stream(1), range(3))] == [2693262067, 11749833, 2265367787]
    assert M.positions_of(20, 5, M.fnv1a("7|GSM100")) == [0, 4, 14, 15, 16]


def test_mixer_against_integers(spark):
    def mix(x):
        x &= 0xFFFFFFFF
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        return x ^ (x >> 16)

    rows = spark.range(-3, 500).select("id", mix32(F.col("id")).alias("m"), hash32(9, F.col("id"), F.col("id") + 1).alias("h")).collect()
    assert all(r.m == mix(r.id) and r.h == mix(mix(9 ^ (r.id & 0xFFFFFFFFFFFFFFFF)) ^ (r.id + 1)) for r in rows if r.id >= 0)


def test_allocation(spark):
    random.seed(5)
    sizes = [(f"g{i}", random.randint(1, 300)) for i in range(60)]
    for cap, floor in ((500, 1), (500, 12), (10**6, 1), (1, 1)):
        frame = spark.createDataFrame(sizes, "k string, n long")
        got = {r.k: r.keep for r in M.allocate(frame, "k", "n", cap, "s", floor).collect()}
        shuffled = {r.k: r.keep for r in M.allocate(frame.orderBy(F.rand(3)), "k", "n", cap, "s", floor).collect()}
        assert got == shuffled
        total = sum(n for _, n in sizes)
        kept = sum(got.values())
        assert kept == total if total <= cap else kept <= cap
        assert all(got[k] <= n for k, n in sizes)
        if total > cap and floor > 1:
            live = [k for k in got if got[k] > 0]
            assert len(live) == 1 or all(got[k] >= floor for k in live)


def test_what_if_against_brute_force(spark):
    random.seed(7)
    rows = [(i, i % 9, random.choice(["a", "b", None]), random.choice(["x", "y", None]), random.randint(1, 9)) for i in range(300)]
    clauses = [C.Clause("p", "include", "p", ("a",)), C.Clause("q", "exclude", "q", ("y",)), C.Clause("r", "require", "q", ())]
    tests = {"p": lambda r: r[2] == "a", "q": lambda r: r[3] != "y", "r": lambda r: r[3] is not None}
    frame = spark.createDataFrame(rows, "id long, g long, p string, q string, w long")
    got = {r.clause: (r.samples, r.weight) for r in C.what_if(frame, clauses, "g", "w", 6).collect()}
    for drop in ("(all)", *tests):
        kept = [r for r in rows if all(t(r) for n, t in tests.items() if n != drop)]
        big = [r for r in kept if sum(k[1] == r[1] for k in kept) >= 6]
        assert got[drop] == (len(big), sum(r[4] for r in big))
    assert all(got[n][0] >= 0 for n in got)


def test_facet_known_and_unknown_reconcile(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    rows = E.facet_unknown(frame, "v").collect()
    assert {(r.value, r.n) for r in rows} == {("a", 2), ("b", 1)}
    assert all(r.known + r.unknown == 4 for r in rows)


@pytest.mark.parametrize(
    ("days", "hour", "minute", "want"), [(15, 10, 30, False), (15, 10, 0, True), (90, 10, 0, False), (90, 12, 0, True), (400, 12, 0, False)]
)
def test_thinning_vectors(spark, days, hour, minute, want):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = F.make_timestamp(F.lit(2026), F.lit(1), F.lit(1), F.lit(hour), F.lit(minute), F.lit(0)) - F.make_dt_interval(F.lit(days))
    assert one(spark, O.keep_point(at, now)) is want


def test_ages(spark):
    read = lambda v, k="age", human=False: one(spark, K.parse_age(F.lit(v), F.lit(k), F.lit(human)))
    assert (read("8-12 weeks").num, read("8-12 weeks").unit) == (10.0, "weeks")
    assert read("36", human=True).confidence == 0.75
    assert read("36").unit is None
    assert read("12-8 weeks") is None
    assert read("P7").unit == "postnatal days"
    assert read("3", "age (months)").unit == "months"
    assert [(read(v).num, read(v).unit) for v in ("36 y.o.", "36 years old", "about 2 mos (fetal)")] == [(36.0, "years"), (36.0, "years"), (2.0, "months")]
    assert read("1 years").norm == "1 year" and read("2-4 wk").norm == "2-4 weeks"


def test_tokenize(spark):
    assert one(spark, J.tokenize(F.lit("The T cell-type of a patient's B data, T cells"))) == ["t", "cell", "type", "patient", "cells"]


def test_empty_and_null_frames(spark):
    empty = spark.createDataFrame([], "p string, q string, g long, w long")
    assert C.resolve_cohort(empty, [C.Clause("p", "include", "p", ("a",))], "g", "w").first().samples == 0
    assert E.facets(empty, {"p": F.col("p") == "a"}, ["p", "q"]).count() == 0
    assert M.allocate(empty.groupBy("g").agg(F.count("*").alias("n")), "g", "n", 10, "s").count() == 0


def test_ordered_against_a_loop(spark):
    random.seed(3)
    rows = [(i, random.choice([None, *range(9)])) for i in range(400)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r.k: (r.place, r.total, r.top) for r in ordered(frame, [F.desc("k")], "place", [("v", "sum", "total"), ("v", "max", "top")]).collect()}
    total, top = None, None
    for place, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        if v is not None:
            total, top = (total or 0) + v, v if top is None else max(top, v)
        assert got[k] == (place, total, top)
    assert ordered(frame.where("false"), [F.col("k")]).count() == 0


def test_closure_is_whole(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(9)]
    got = {(r.term, r.ancestor): r.distance for r in N.closure(spark.createDataFrame(chain, "term string, parent string")).collect()}
    assert got == {(f"t{i}", f"t{j}"): j - i for i in range(10) for j in range(i, 10)}
    with pytest.raises(ValueError):
        N.closure(spark.createDataFrame(chain, "term string, parent string"), most=3)
    circle = {(r.term, r.ancestor): r.distance for r in N.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "term string, parent string")).collect()}
    assert circle == {("a", "a"): 0, ("b", "b"): 0, ("a", "b"): 1, ("b", "a"): 1}


def test_narrowest_interval_against_a_loop(spark):
    random.seed(4)
    bands = [(i, float(low := random.randint(0, 90)), None if i % 9 == 0 else float(low + random.randint(1, 40))) for i in range(30)]
    points = [(i, random.uniform(-5, 140)) for i in range(300)]
    frame = spark.createDataFrame(bands, "id int, low double, high double")
    got = {r.k: r.interval_id for r in Joins.narrowest_interval(spark.createDataFrame(points, "k long, p double"), frame, "k", "p").collect()}
    for k, p in points:
        held = [(float("inf") if high is None else high - low, i) for i, low, high in bands if low <= p and (high is None or p < high)]
        assert got[k] == (min(held)[1] if held else None)



def test_pareto_against_a_loop(spark):
    random.seed(8)
    rows = [(i, random.randint(0, 20), random.randint(0, 30)) for i in range(80)]
    got = {r.k for r in D.pareto(spark.createDataFrame(rows, "k long, q long, c long"), "k", "q", "c").collect()}
    beats = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and a[1:] != b[1:]
    assert got == {b[0] for b in rows if not any(beats(a, b) for a in rows)}


def test_facts_follow_the_first_pair(spark):
    text = "age: P7;; dev stage: E10;; time: Day 6;; age: 9 weeks;; genotype: WT;; cell type: Tregs;; note: odd;; cell line: primary"
    pairs = K.parse_pairs(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t")
    sources = spark.createDataFrame([(1, "Human kidney cortex cells"), (2, "lung and liver")], "k long, source string")
    rows = K.read_pairs(pairs, "k", F.lit(True), sources).collect()
    facts = {r.attr: (r.value_norm, r.value_num, r.unit, r.confidence) for r in rows if r.outcome == "fact"}
    assert facts == {
        "age": ("P7", 7.0, "postnatal days", 0.95), "life_stage": ("embryonic", None, None, 0.9), "timepoint": ("6 days", 6.0, "days", 0.95),
        "genotype": ("wild type", None, None, 0.95), "cell_type_sorted": ("regulatory t cell", None, None, 0.95), "tissue": ("kidney cortex", None, None, 0.8),
    }
    assert {(r.outcome, r.attr, r.pair_key) for r in rows if r.outcome != "fact"} == {("unplaced", "sample_type", "cell line"), ("unmapped", None, "note")}
    empty = pairs.where("false")
    assert K.read_pairs(empty, "k").count() == 0 and K.classify_sample_type(empty, "k").count() == 0


def test_narrowest_of_a_hundred_thousand_overlapping_intervals(spark):
    """Interval i is [i, 300000 - i): the narrowest around a point has the largest i."""
    intervals = spark.range(100_000).select("id", F.col("id").cast("double").alias("low"), (300_000 - F.col("id")).cast("double").alias("high"))
    points = spark.createDataFrame([(1, 0.5), (2, 70_000.0), (3, 150_000.0), (4, 299_999.5), (5, 300_000.0), (6, -1.0), (7, None), (8, 70_000.0)], "k long, p double")
    got = {r.k: r.interval_id for r in Joins.narrowest_interval(points, intervals, "k", "p").collect()}
    assert got == {1: 0, 2: 70_000, 3: 99_999, 4: 0, 5: None, 6: None, 7: None, 8: 70_000}


def test_a_summary_answers_only_what_it_holds(spark):
    rows = spark.createDataFrame([("a", "x", 1, 5), ("a", "y", 2, 6), ("b", "x", 3, 7)], "k string, f string, weight long, v long")
    wrong = spark.createDataFrame([("a", "x", 100), ("b", "x", 300)], "k string, f string, weight long")  # tells which of both was read
    ask = lambda **more: {r.k: r.weight for r in D.grouped_count(rows, ["k"], "weight", summary=wrong, **more).collect()}
    assert ask() == {"a": 100, "b": 300} and ask(where={"f": ["x"]}) == {"a": 100, "b": 300}
    assert ask(where={"v": [6]}) == {"a": 2} and ask(rows=F.col("v") > 5) == {"a": 2, "b": 3}


def test_terms_are_text(spark):
    rows = spark.createDataFrame([(1, "written in c plus"), (1, "in C++ and c+"), (1, "a ccc b"), (1, "f(x")], "k long, text string")
    got = {r.term: r.n for r in J.match_counts(rows, "k", ["c+", "c++", "(", "c"], ["text"]).collect()}
    assert got == {"c+": 1, "c++": 1, "c": 2}  # the bracket stands inside a word


def test_repeated_cells_give_their_smallest_row(spark):
    rows = [("c1", "b", ["y"]), ("c1", "a", ["z"]), ("c1", "a", ["x"]), ("c2", None, None)]
    for parts in (1, 3):
        found = Sources.export_cells(spark.createDataFrame(rows, "cell string, name string, labels array<string>").repartition(parts), "cell", ["name", "labels"])
        first, second = found.orderBy("j").collect()
        assert (first.cell, first.name, first.labels, second.cell) == ("c1", "a", "x", "c2")


def test_sample_types_read_each_distinct_pair_once(spark):
    rows = [(i, 0, "tissue" if i % 3 else "cell line", "hela" if i % 3 == 1 else "lung", "e") for i in range(60)] + [(99, 0, None, "x", "e"), (98, 0, "tissue", "", "e")]
    pairs = spark.createDataFrame(rows, "k long, position int, attr string, value string, evidence string")
    lines = spark.createDataFrame([("lung", "A2", None), ("lung", "A1", None)], "name string, accession string, category string")
    found = K.classify_sample_type(pairs, "k", lines)
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.tissue_type, r.cell_line) for r in found.collect()}
    assert got[0] == ("cell line", "A1") and got[2] == ("tissue", None) and got[99] == (None, None)
    assert set(got) == {*range(60), 99}


def test_only_pieces_that_hold_points_are_looked_up(spark):
    intervals = spark.range(200).select("id", F.col("id").cast("double").alias("low"), (F.col("id") + 3.0).alias("high"))
    points = spark.createDataFrame([(1, 50.5), (2, 50.5), (3, -1.0), (4, None), (5, 500.0)], "k long, p double")
    found = Joins.narrowest_interval(points, intervals, "k", "p")
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode(" in line and "[level#" in line)
    assert any("Aggregate [" in line for line in plan[at + 1 : at + 3]), plan
    assert {r.k: r.interval_id for r in found.collect()} == {1: 48, 2: 48, 3: None, 4: None, 5: None}
