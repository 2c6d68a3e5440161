"""Grounding of records and rules of construction on small fixtures."""

import pytest

from anchorage.operators import validation as V

FIELDS = "paper_id string, entity_type string, record_id string, path string, kind string, value string, label string, reason string, locators array<string>"


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [("p", "b:1", 1, "Pinus sylvestris was planted in 2003."), ("p", "b:2", 2, "P. sylvestris grew to 12.5 kg ha in May"), ("p", "b:3", 3, "Values of 7 and 1,200 mm"), ("q", "b:2", 2, "P. sylvestris alone")]
    return spark.createDataFrame(rows, "paper_id string, anchor string, ord int, text string")


def _codes(found):
    return sorted((r.code, r.entity_id) for r in found.collect())


def _field(paper, path, kind, value, locators, label="EXTRACTED", reason=None, entity="Crop", record="r"):
    return (paper, entity, record, path, kind, value, label, reason, locators)


def test_fields_are_held_against_their_blocks(spark, blocks):
    rows = [
        _field("p", "species", "text", "Pinus sylvestris", ["[b:2]"]),
        _field("q", "species2", "text", "Pinus sylvestris", ["b:2"]),
        _field("p", "weight", "double", "12.5", ["b:2"]),
        _field("p", "half", "double", "2.5", ["b:2"]),
        _field("p", "n", "integer", "7", ["b:3", "b:9"]),
        _field("p", "bad", "integer", "seven", ["b:3"]),
        _field("p", "judged", "judgement", "true", ["b:3"], "INFERRED", " "),
        _field("p", "open", "text", "x", ["b:3"], "UNRESOLVED"),
        _field("p", "none", "text", None, ["b:9"]),
    ]
    got = _codes(V.field_issues(spark.createDataFrame(rows, FIELDS), blocks))
    assert got == [
        ("boolean_inference_basis_missing", "r/judged"), ("provenance_anchor_not_found", "r/n"),
        ("provenance_value_mismatch", "r/bad"), ("provenance_value_mismatch", "r/half"), ("provenance_value_mismatch", "r/species2"),
    ]


def test_quantities_and_dates(spark, blocks):
    q = [("p", "r", "a", "12.5 kg ha", 12.5, "kg ha", ["b:2"]), ("p", "r", "b", "1,200 mm", 1200.0, "mm", ["b:2", "b:3"]), ("p", "r", "c", "1,200 mm", 12.0, "cm", ["b:3"]), ("p", "r", "d", "gone", None, None, ["b:3"]), ("p", "r", "e", "gone", 1.0, "t", ["b:9"])]
    got = V.quantity_issues(spark.createDataFrame(q, "paper_id string, record_id string, path string, reported_text string, numeric double, units string, locators array<string>"), blocks)
    assert _codes(got) == [("provenance_numeric_mismatch", "r/c"), ("provenance_reported_text_mismatch", "r/d"), ("provenance_units_mismatch", "r/c")]
    d = [("p", "r", "a", "May 2003", "2003-05-01", "2003-05-31", ["b:1", "b:2"]), ("p", "r", "b", "in May", "2004-05-01", None, ["b:2"]), ("p", "r", "c", "June", None, None, ["b:2"])]
    got = V.date_issues(spark.createDataFrame(d, "paper_id string, record_id string, path string, reported_text string, earliest string, latest string, locators array<string>"), blocks)
    assert _codes(got) == [("provenance_date_text_mismatch", "r/c"), ("provenance_date_year_unsupported", "r/b")]


def test_excerpts_run_over_blocks_in_document_order(spark, blocks):
    facts = [("p", "over", ["b:2", "[b:1]"], "planted in 2003. P. sylvestris grew"), ("p", "cut", ["b:1"], "Pinus ... planted"), ("p", "back", ["b:1"], "planted ... Pinus"), ("p", "gone", ["b:1", "b:8"], "Pinus"), ("p", "none", [], "Pinus"), ("p", "null", ["b:1"], "never")]
    got = V.excerpt_issues(spark.createDataFrame(facts, "paper_id string, fact_id string, anchors array<string>, excerpt string"), blocks)
    assert _codes(got) == [("anchor_not_found", "gone"), ("excerpt_not_found", "back"), ("excerpt_not_found", "none"), ("excerpt_not_found", "null")]


def test_known_values(spark):
    facts = spark.createDataFrame([("p", "a", "12.5", "it was 12.5"), ("p", "b", None, "11")], "paper_id string, candidate_id string, value string, excerpt string")
    known = spark.createDataFrame([("p", "a", "12.5"), ("p", "b", "12"), ("p", "c", "1")], "paper_id string, candidate_id string, known_value string")
    assert {r.candidate_id: r.borne for r in V.bears_known_value(facts, known).collect()} == {"a": True, "b": False, "c": False}


def test_construction_of_fields(spark):
    rows = [
        _field("p", "ok", "text", "x", ["b:1"]),
        _field("p", "empty", "text", None, ["b:1"]),
        _field("p", "firm", "text", "x", [], "UNRESOLVED", "why"),
        _field("p", "unsaid", "text", None, [], "UNRESOLVED"),
        _field("p", "guess", "text", "x", ["b:1"], "INFERRED"),
        _field("p", "loose", "text", "x", None),
        _field("p", "date", "text", "x", ["b:1"], "INFERRED", "why", "Management"),
    ]
    assert _codes(V.field_construction(spark.createDataFrame(rows, FIELDS))) == [
        ("inference_basis_missing", "r/guess"), ("inferred_forbidden", "r/date"), ("locator_missing", "r/loose"),
        ("unresolved_reason_missing", "r/unsaid"), ("value_missing", "r/empty"), ("value_with_unresolved", "r/firm"),
    ]


def test_construction_of_records(spark):
    df = spark.createDataFrame
    dates = df([("a", "2001", "2000", None), ("b", "2001", None, None), ("c", "2001", "2001", "after"), ("d", None, None, "after"), ("e", "2001", "2002", None)], "record_id string, earliest string, latest string, relative_timing string")
    assert _codes(V.date_construction(dates)) == [("date_interval_and_relative", "c"), ("date_one_end", "b"), ("date_reversed", "a")]
    species = df([("a", "Pinus", "sylvestris", "Pinus sylvestris L."), ("b", "Pinus", "mugo", "Pinus mugolia"), ("c", None, "x", "Y")], "id string, genus string, epithet string, scientific_name string")
    assert _codes(V.name_construction(species)) == [("scientific_name_mismatch", "b")]
    assert _codes(V.pair_construction(df([("a", "t", "t"), ("b", "t", "u"), ("c", None, None)], "id string, treatment_id_1 string, treatment_id_2 string"))) == [("pair_of_one", "a")]
    assert _codes(V.study_construction(df([("a", []), ("b", ["c"]), ("c", None)], "id string, citation_ids array<string>"))) == [("study_without_citation", "a"), ("study_without_citation", "c")]
    assert _codes(V.locator_construction(df([("a", "table", None, None), ("b", "figure", None, "f"), ("c", "text", None, None)], "record_id string, type string, table_id string, figure_id string"))) == [("locator_target_missing", "a")]
    conv = df([("a", 1.0, "deg", None, "r"), ("b", 1.0, "deg", "f", "r"), ("c", None, None, None, None)], "record_id string, converted_value double, converted_units string, conversion_formula string, conversion_rationale string")
    assert _codes(V.conversion_construction(conv)) == [("conversion_incomplete", "a")]
    cands = df([("p", "e", "x", ["Rate", "rate "]), ("p", "e", "y", ["Rate"]), ("p", "e", "y", []), ("p", "f", "x", ["a", "b"])], "paper_id string, enumeration string, candidate_id string, dimensions array<string>")
    assert _codes(V.candidate_construction(cands)) == [("candidate_id_repeats", "y"), ("dimension_repeats", "x")]


def test_construction_of_tables(spark):
    df = spark.createDataFrame
    factors = df([("t", "rate", "rows", "treatment", False), ("t", "rate", "rows", "treatment", False), ("t", "year", "columns", "time", False), ("t", "site", "context", "site", True)], "table_id string, name string, encoding string, dimension string, pooled boolean")
    used = df([("t", "year", "rows"), ("t", "site", "rows"), ("t", "lost", "rows")], "table_id string, name string, encoding string")
    assert _codes(V.factor_construction(factors, used)) == [("factor_encoding", "t/year"), ("factor_pooled_in_table", "t/site"), ("factor_repeats", "t/rate"), ("factor_undeclared", "t/lost")]
    levels = df([("t", "year", "1", None, "2001"), ("t", "year", "2", " ", None), ("t", "year", "1", "May", None), ("t", "site", "x", "May", None)], "table_id string, factor string, level string, date_text string, year_text string")
    assert _codes(V.time_construction(levels, factors)) == [("time_level_of_no_factor", "t/site/x"), ("time_level_repeats", "t/year/1"), ("time_level_undated", "t/year/2")]
    tables = df([("a", True, None, None, ["t1"], ["t2"], ["r", "r"], ["c"], ["c", "d"]), ("b", False, None, "why", ["t1"], [], [], [], [])], "table_id string, applicable boolean, scope string, reason string, table_anchors array<string>, row_anchors array<string>, row_ids array<string>, column_ids array<string>, cell_columns array<string>")
    assert [c for c, _ in _codes(V.table_construction(tables))] == ["table_ids_repeat", "table_row_elsewhere", "table_scope_missing", "table_unknown_column"]
    assert _codes(V.variable_construction(df([("t", "c1", "yield"), ("t", "c2", " ")], "table_id string, value_column_id string, variable string"))) == [("column_without_variable", "t/c2")]
    assert _codes(V.variable_labels(df([("t", "Yield (t)"), ("t", "yield t"), ("t", "mass")], "table_id string, label string"))) == [("variable_repeats", "t/yield t")]
