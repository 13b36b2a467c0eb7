"""Forms that the mapper tries, and which of them decides."""

from __future__ import annotations

from strandwise.operators import mapping as M


def forms(spark, attr, value):
    rows = M.name_forms(spark.createDataFrame([(attr, value)], "attr string, value string")).orderBy("form").collect()
    return [r.name for r in rows]


def test_forms_in_order(spark):
    assert forms(spark, "tissue", "Human Fresh  Lung-Biopsies") == ["human fresh lung biopsies", "fresh lung", "lung", "human fresh lung biopsie", "human fresh lung biopsy"]
    assert forms(spark, "cell_type_sorted", "blood monocytes")[:1] == ["blood monocytes"]
    assert {"monocytes", "monocyte", "blood monocyte", "blood monocytes cell"} <= set(forms(spark, "cell_type_sorted", "blood monocytes"))
    assert "cd4 positive alpha beta t cell" in forms(spark, "cell_type_sorted", "CD4 T cells")
    assert "t cell" in forms(spark, "cell_type_sorted", "CD3+ T cells".replace("+", " positive"))
    assert "monocytes" not in forms(spark, "tissue", "blood monocytes")
    assert forms(spark, "tissue", " !? ") == []


def test_which_form_decides(spark):
    labels = spark.createDataFrame([("lung", "U:1", 0), ("colon", "U:2", 0), ("colon", "U:3", 0), ("colon", "U:4", 1), ("eye", "U:5", 2), ("retina tissue", "U:6", 2), ("t cell", "CL:00084", 0), ("body", "U:9", 0)], "name string, term_id string, tier int")
    aliases = spark.createDataFrame([("tissue", "gut", "U:7", None), ("disease", "lung", "D:1", 0.99)], "attr string, name string, term_id string, confidence double")
    values = ["lung", "Human lung tissues", "colon", "colons", "eye", "retina tissue", "gut", "whole gut", "lung organoids", "CL_00084 of blood", "body", "human body", None, "", "nothing"]
    frame = spark.createDataFrame([("tissue", v) for v in values] + [("disease", "fresh lung"), (None, "lung")], "attr string, value string")
    got = {(r.attr, r.value): (r.term_id, r.method, r.confidence) for r in M.map_values(frame, labels, aliases, ["U:9"]).collect() if r.value}
    nothing = (None, None, None)
    assert got == {
        ("tissue", "lung"): ("U:1", "label", 0.95), ("tissue", "Human lung tissues"): ("U:1", "variant", 0.85), ("tissue", "colon"): nothing, ("tissue", "colons"): nothing,
        ("tissue", "eye"): nothing, ("tissue", "retina tissue"): ("U:6", "synonym", 0.75), ("tissue", "gut"): ("U:7", "curated", 0.9), ("tissue", "whole gut"): ("U:7", "curated", 0.85),
        ("tissue", "lung organoids"): ("U:1", "variant", 0.7), ("tissue", "CL_00084 of blood"): ("CL:00084", "id", 0.99), ("tissue", "body"): nothing, ("tissue", "human body"): nothing,
        ("tissue", "nothing"): nothing, ("disease", "fresh lung"): ("D:1", "curated", 0.85), (None, "lung"): nothing,
    }
