"""Design of tables: pooling of cells, factors, repeated treatments."""

import pytest
from pyspark.sql import functions as F

from anchorage.operators import design as D

LEVELS = "paper_id string, table_id string, row_group_id string, factor string, level string"
FACTORS = "paper_id string, table_id string, name string, dimension string"


def test_labels(spark):
    told = {"P value PAR t": (True, False), "LSD (0.05)": (True, False), "S.E.": (True, False), "SE": (True, False), "** Mean": (False, True), "Mean yield": (False, False), "Grand mean.": (False, True), "P": (False, False), "Sedge": (False, False), "": (False, False)}
    rows = spark.createDataFrame([(k,) for k in told], "x string").select("x", D.is_statistic(F.col("x")).alias("a"), D.is_summary(F.col("x")).alias("b")).collect()
    assert {r.x: (r.a, r.b) for r in rows} == told


@pytest.fixture(scope="module")
def table(spark):
    levels = [("p", "t", "r1", "rate", "low"), ("p", "t", "r2", "rate", "high"), ("p", "t", "r3", "year", "2002"), ("p", "t", "r4", "year", "2001"), ("p", "t", "r5", "rate", ""), ("p", "t", "r6", "rate", "LSD (0.05)")]
    cells = [("p", "t", f"r{i}", c, v) for i in range(1, 7) for c, v in (("a", "1"), ("b", "2" if i in (1, 2) else " "))]
    factors = [("p", "t", "rate", "treatment"), ("p", "t", "year", "time")]
    return spark.createDataFrame(levels, LEVELS), spark.createDataFrame(cells, "paper_id string, table_id string, row_group_id string, value_column_id string, cell_text string"), spark.createDataFrame(factors, FACTORS)


def test_cells_are_pooled_over_what_varies(table):
    levels, cells, factors = table
    got = {(r.row_group_id, r.value_column_id): (r.pooled_over, r.limitation) for r in D.cell_pooling(cells, levels, factors).collect()}
    assert got == {("r1", "a"): (["year"], None), ("r2", "a"): (["year"], None), ("r3", "a"): (["rate"], "treatment_pooled"), ("r4", "a"): (["rate"], "treatment_pooled"), ("r5", "a"): ([], "unidentified_row")}


def test_tables_with_cells_have_none(spark, table):
    levels = spark.createDataFrame([("p", "t", "r1", "rate", "low"), ("p", "t", "r1", "year", "1"), ("p", "t", "r2", "rate", "x")], LEVELS)
    assert D.cell_pooling(table[1], levels, table[2]).collect() == []


def test_summaries_and_spans(spark, table):
    levels, _, factors = table
    more = levels.union(spark.createDataFrame([("p", "t", "r7", "rate", "Mean"), ("p", "t", "r8", "year", "Mean")], LEVELS))
    assert {r.row_group_id: (r.pooled_over, r.limitation) for r in D.summary_pooling(more, factors).collect()} == {"r7": (["rate"], "treatment_pooled"), "r8": (["year"], None)}
    assert {r.row_group_id: r.label for r in D.summary_level(more).collect()} == {"r6": "LSD (0.05)", "r7": "Mean", "r8": "Mean"}
    order = spark.createDataFrame([("p", "t", f"r{i}", i) for i in range(1, 9)], "paper_id string, table_id string, row_group_id string, pos int")
    assert [tuple(r) for r in D.time_span(levels, factors, order).collect()] == [("p", "t", "year", "2002, 2001")]
    rows = spark.range(1).select(D.effect_scope(F.lit(False), F.array(F.lit("x"))).alias("a"), D.effect_scope(F.lit(True), F.array(F.lit("x"))).alias("b"), D.effect_scope(F.lit(True), F.lit(None).cast("array<string>")).alias("c")).collect()[0]
    assert (tuple(rows.a), tuple(rows.b), tuple(rows.c)) == (("treatment_mean", []), ("aggregated_mean", ["x"]), ("aggregated_mean", None))


def test_registry_consistency_and_manifest(spark, table):
    levels, _, factors = table
    extra = levels.union(spark.createDataFrame([("p", "u", "r1", "rate", "low"), ("p", "u", "r2", "rate", "LOW2"), ("p", "w", "r1", "rate", "stray")], LEVELS))
    f = factors.union(spark.createDataFrame([("p", "u", "rate", "treatment"), ("p", "w", "rate", "treatment"), ("p", "u", "p", "other")], FACTORS))
    tables = spark.createDataFrame([("p", "t", 0, "data"), ("p", "u", 1, "data"), ("p", "w", 2, "data")], "paper_id string, table_id string, pos int, role string")
    readings = spark.createDataFrame([("p", "w", "rate", "stray", "withhold", None), ("p", "u", "rate", "LOW2", "alias", "high")], "paper_id string, table_id string, factor string, level string, reading string, meant string")
    got = {r.factor: (r.dimension, sorted(r.levels), r.tables) for r in D.summary(tables, f, D.consistent(extra, readings), readings).collect()}
    assert got == {"rate": ("treatment", ["high", "low"], ["t", "u"]), "year": ("time", ["2001", "2002"], ["t"])}
    cands = spark.createDataFrame([("p", "t", "Treatment"), ("p", "t", "Treatment"), ("p", "t", "Observation")], "paper_id string, table_id string, entity_type string")
    limits = spark.createDataFrame([("p", "t", "L4"), ("p", "t", "L4")], "paper_id string, table_id string, limitation string")
    fails = spark.createDataFrame([("p", "u")], "paper_id string, table_id string")
    got = {r.table_id: (r.candidates, r.limitations, r.failures) for r in D.manifest(tables, cands, limits, fails).collect()}
    assert got == {"t": ({"Observation": 1, "Treatment": 2}, ["L4"], 0), "u": ({}, [], 1), "w": ({}, [], 0)}


def test_plot_factors_become_treatments(spark):
    factors = spark.createDataFrame([("p", "t", "Sward maturity", "time"), ("p", "t", "Year", "time"), ("p", "t", "Day", "time")], FACTORS)
    said = spark.createDataFrame([("p", "b:2", "sward maturities"), ("p", "b:1", "sward maturities of three"), ("q", "b:3", "years")], "paper_id string, anchor string, phrase string")
    assert {r.name: (r.dimension, r.evidence) for r in D.promote_factors(factors, said).collect()} == {"Sward maturity": ("treatment", "b:1"), "Year": ("time", None), "Day": ("time", None)}


def test_freeform_treatments_have_four_outcomes(spark):
    schema = "paper_id string, candidate_id string, dimensions array<struct<name:string,dimension:string,level:string>>, site_id string"
    table = spark.createDataFrame([("p", "t1", [("Tillage", "treatment", "No-till"), ("Place", "site", "East")], "s1"), ("p", "t2", [("Cover", "treatment", "none"), ("Tillage", "treatment", "till")], None)], schema)
    free = [
        ("p", "covered", [("Practice", "treatment", "no–till"), ("Site", "site", "east")], "s1"),
        ("p", "elsewhere", [("Practice", "treatment", "no-till"), ("Site", "site", "West")], "s2"),
        ("p", "unclear", [("Practice", "treatment", "no-till"), ("Site", "site", "North")], None),
        ("p", "swapped", [("Cover", "treatment", "till"), ("Tillage", "treatment", "none")], None),
        ("p", "bare", [], None), ("p", "null", None, None), ("p", "crop", [("Crop", "crop", "maize")], None),
    ]
    got = {r.candidate_id: (r.decision, r.matched) for r in D.settle_freeform(spark.createDataFrame(free, schema), table).collect()}
    assert got == {"covered": ("dropped_covered", "t1"), "elsewhere": ("kept_new", None), "unclear": ("kept_unresolved", None), "swapped": ("kept_unresolved", None), "bare": ("kept_unresolved", None), "null": ("kept_unresolved", None), "crop": ("dropped_no_treatment_dimension", None)}


def test_species_by_evidence_and_pooling_of_windows(spark):
    blocks = spark.createDataFrame([("p", f"b:{i}", i, t) for i, t in enumerate(["Oats", "the crop", "maize here", "x", "maizes"])], "paper_id string, anchor string, ord int, text string")
    cands = spark.createDataFrame([("p", "two", ["b:1"]), ("p", "one", ["b:3"]), ("p", "none", ["b:4"])], "paper_id string, candidate_id string, anchors array<string>")
    species = spark.createDataFrame([("p", "zea", ["Zea mays", "maize"]), ("p", "avena", ["oats"])], "paper_id string, species_id string, names array<string>")
    assert {r.candidate_id: r.species_id for r in D.evidenced_species(cands, blocks, species).collect()} == {"two": None, "one": "zea", "none": None}
    w = spark.createDataFrame([("p", "t", "b:1"), ("p", "u", "b:1")], "paper_id string, table_anchor string, anchor string")
    s = spark.createDataFrame([("p", "b:1", "year", "accepted"), ("p", "b:1", "year", "accepted"), ("p", "b:2", "site", "accepted")], "paper_id string, anchor string, name string, status string")
    assert sorted((r.table_anchor, r.name) for r in D.pooling_of_tables(w, s).collect()) == [("t", "year"), ("u", "year")]
