"""States of records and lookups on small fixtures."""

import pytest
from pyspark.sql import functions as F

from anchorage.operators import lookups as L
from anchorage.operators import status as S


def test_verdicts_and_corrections(spark):
    df = spark.createDataFrame
    judged = df([("a", 1, "suspicious"), ("b", 1, "suspicious"), ("c", 1, "suspicious"), ("d", 1, "plausible")], "record_id string, seq int, verdict string")
    concerns = df([("a", 1, "value.id"), ("b", 1, "name"), ("b", 1, "record_id")], "record_id string, seq int, field string")
    assert {r.record_id: r.verdict for r in S.verdicts(judged, concerns).collect()} == {"a": "plausible", "b": "suspicious", "c": "suspicious", "d": "plausible"}
    first = df([(x, None if x == "n" else "plausible" if x == "f" else "suspicious") for x in "fcdxn"], "record_id string, verdict string")
    second = df([("c", True, "plausible"), ("d", True, "suspicious"), ("x", False, None)], "record_id string, valid boolean, verdict string")
    demoted = df([("d", True), ("x", False)], "record_id string, settled boolean")
    got = {r.record_id: (r.by, r.status) for r in S.after_correction(first, second, demoted).collect()}
    assert got == {"f": ("first", "ready"), "c": ("corrected", "ready"), "d": ("demoted", "ready"), "x": ("concern", "unresolved"), "n": ("never_validated", "unresolved")}


def test_ids_round_trip(spark):
    rows = spark.createDataFrame([("p_1", "Site", "east"), ("p_1", "Citation", None)], "p string, e string, s string")
    rows = rows.withColumn("id", S.record_id(F.col("p"), F.col("e"), F.col("s"))).withColumn("back", S.slug_of(F.col("p"), F.col("e"), F.col("id")))
    assert [(r.id, r.back) for r in rows.collect()] == [("p_1_site_east", "east"), ("p_1", "p_1")]


def test_prerequisites_and_limitations(spark):
    df = spark.createDataFrame
    records = df([("p", "Site", "s1", "unresolved"), ("p", "Site", "s2", "ready"), ("p", "Crop", "c", "error")], "paper_id string, entity_type string, record_id string, status string")
    needs = df([("Treatment", "site_id", "Site", True), ("Observation", "crop_id", "Crop", False)], "entity_type string, field string, prerequisite string, required boolean")
    concerns = df([("p", "s1", "name"), ("p", "s1", "area")], "paper_id string, record_id string, field string")
    assert [(r.entity_type, r.record_id, r.open_fields) for r in S.prerequisite_notes(records, needs, concerns).collect()] == [("Treatment", "s1", ["area", "name"])]
    tables = df([("p", "t", "treatment_response"), ("q", "t", "treatment_response"), ("r", "t", "other")], "paper_id string, table_id string, role string")
    factors = df([("p", "t", "time"), ("q", "t", "treatment"), ("q", "t", "time"), ("r", "t", "time")], "paper_id string, table_id string, dimension string")
    assert [tuple(r) for r in S.without_treatments(tables, factors).collect()] == [("p", "L1")]
    methods = df([("p", "a"), ("p", "b"), ("q", "a"), ("q", "a")], "paper_id string, record_id string")
    assert [(r.paper_id, r.methods) for r in S.needs_method_map(methods).collect()] == [("p", 2)]


def test_methods_by_name_then_description(spark):
    pool = spark.createDataFrame([("p", "lai", "leaf area index", "canopy analyzer below plants"), ("p", "soil", "soil cores", "bulk density with steel rings"), ("p", "soil2", "soil pits", "profile walls")], "paper_id string, slug string, name string, description string")
    rows = [("p", "name", "leaf area index", None), ("p", "tie", "soil", "bulk density steel rings"), ("p", "text", "BD", "bulk density with steel rings"), ("p", "few", "BD", "steel rings"), ("p", "none", "zz", None), ("q", "away", "leaf", None)]
    got = {r.row_id: (r.slug, r.tier) for r in S.match_method(spark.createDataFrame(rows, "paper_id string, row_id string, value string, hint string"), pool).collect()}
    assert got == {"name": ("lai", "name"), "tie": (None, None), "text": ("soil", "description"), "few": (None, None), "none": (None, None), "away": (None, None)}


def test_concepts_targets_and_statements(spark):
    df = spark.createDataFrame
    audit = df([("t", "soil", 4, "FOUND", ["a", "b", "c", "d"]), ("t", "site", 1, "FOUND", ["x"]), ("t", "climate", 5, "NOT_RETRIEVED", ["z"])], "task_id string, concept string, cpos int, status string, anchors array<string>")
    assert S.found_concepts(audit).collect()[0].found == ["site (x)", "soil (a, b, c)"]
    rows = df([("Variable", "", "leaf_area"), ("Variable", "LAI", "x"), ("Site", "LAI", "x")], "e string, h string, c string").select(S.evidence_target(F.col("e"), F.col("h"), F.col("c")).alias("t"))
    assert [r.t for r in rows.collect()] == ["leaf area", "LAI", None]
    blocks = df([("p", "b", 2, "Row-spacing treatments", "Text", "methods"), ("p", "a", 1, "treatments of row spacing", "Text", "abstract"), ("p", "c", 3, "row spacing treatments", "Text", "results"), ("p", "d", 4, "row spacing", "Text", "methods")], "paper_id string, anchor string, ord int, text string, block_type string, region string")
    names = df([("p", "k", "Row spacing"), ("p", "k", "row-spacing"), ("p", "m", "--")], "paper_id string, candidate_id string, name string")
    assert [(r.candidate_id, r.anchors) for r in S.design_statements(blocks, names, F.col("text").rlike("treatment")).collect()] == [("k", ["a", "b"])]


def test_citations_and_corrections(spark):
    df = spark.createDataFrame
    facts = df([("p", "Journal Name", "Soil"), ("p", "DOI", " "), ("q", "doi", "10.1/x")], "paper_id string, field_name string, value string")
    papers = df([("p", True), ("q", True), ("r", False)], "paper_id string, has_identifier boolean")
    got = sorted(map(tuple, S.not_written(facts, papers, {"journal": ["journal_name"], "persistent_identifier": ["doi"]}, ["journal", "persistent_identifier"]).collect()))
    assert got == [("p", "persistent_identifier", "unreported"), ("q", "journal", "not_written"), ("r", "journal", "not_written"), ("r", "persistent_identifier", "not_written")]
    c = df([("p", "r", "a", 1, "12", None), ("p", "r", "a", 2, "13", "run"), ("p", "r", "b", 3, "x", None), ("p", "r", "b", 4, None, None)], "paper_id string, record_id string, field_name string, seq int, value string, run_id string")
    loc = df([("p", "r", "a", "b:1"), ("p", "r", "a", "b:2")], "paper_id string, record_id string, field_name string, anchor string")
    blocks = df([("p", "b:1", "a 12 there"), ("p", "b:2", "none")], "paper_id string, anchor string, text string")
    assert {r.seq: r.issue for r in S.corrections_checked(c, loc, blocks).collect()} == {1: None, 2: "unsupported", 3: "nothing_cited", 4: None}


def test_observation_context(spark):
    df = spark.createDataFrame
    c = df([("p", "t", "o", "v", "x", "s"), ("p", "t", "o2", None, "x", "s9")], "paper_id string, table_id string, candidate_id string, variable_id string, treatment_id string, site_id string")
    one = lambda key, k, col: df([("p", k, f"{col}!")], f"paper_id string, {key} string, {col} string")
    got = S.observation_context(c, one("variable_id", "v", "label"), one("variable_id", "v", "method_id"), one("treatment_id", "x", "name"), one("candidate_id", "o", "date"), one("site_id", "s", "place"), one("candidate_id", "o", "scope"), one("candidate_id", "o2", "mean"), one("table_id", "t", "layout"))
    by = {r.candidate_id: r for r in got.collect()}
    assert by["o"].variable.label == "label!" and by["o"].method.method_id == "method_id!" and by["o"].site.place == "place!" and by["o"].statistics is None and by["o"].design.layout == "layout!"
    assert by["o2"].variable is None and by["o2"].site is None and by["o2"].statistics.mean == "mean!" and by["o2"].treatment.name == "name!"


@pytest.fixture(scope="module")
def doc(spark):
    blocks = [("p", "b:1", 1, "**See Table 1**", "Text", "methods"), ("p", "b:2", 2, "Table 1. X", "Caption", "results"), ("p", "b:3", 3, "| a |", "Table", "results"), ("p", "b:4", 4, "note", "Footnote", "results"), ("p", "b:5", 5, "gone", "Text", "references")]
    members = [("p", 0, "Table 1", "b:2", "caption", 0), ("p", 0, "Table 1", "b:3", "table", 0), ("p", 0, "Table 1", "b:4", "note", 0), ("p", 1, "Table 2", "b:3", "table", 0)]
    refs = [("p", "b:1", "Table 1", ["b:3", "b:3"]), ("p", "b:5", "Table 9", [])]
    return (
        spark.createDataFrame(blocks, "paper_id string, anchor string, ord int, text string, block_type string, region string"),
        spark.createDataFrame(members, "paper_id string, table_ord int, label string, anchor string, role string, pos int"),
        spark.createDataFrame(refs, "paper_id string, from_anchor string, label string, targets array<string>"),
    )


def test_lookups_of_documents(spark, doc):
    blocks, members, refs = doc
    assert [r.anchor for r in L.region_blocks(blocks, ["results", "methods"], prose_only=True).orderBy("ord").collect()] == ["b:1", "b:4"]
    wanted = spark.createDataFrame([("p", x) for x in ("b:2", "b:3", "b:4", "zz")], "paper_id string, anchor string")
    assert {r.anchor: r.table_ord for r in L.table_containing(wanted, members).collect()} == {"b:2": 0, "b:3": 0, "b:4": None, "zz": None}
    assert sorted((r.table_ord, r.from_anchor) for r in L.references_to(refs, members).collect()) == [(0, "b:1"), (1, "b:1")]
    assert [r.label for r in L.refs_from(refs, spark.createDataFrame([("p", "b:1")], "paper_id string, anchor string")).collect()] == ["Table 1"]
    asked = spark.createDataFrame([("p", " [b:4] "), ("p", "b:9")], "paper_id string, anchor string")
    assert [r.text for r in L.block_text(asked, blocks).orderBy("anchor").collect()] == ["note", None]
    assert [(r.table_ord, r.text, r.cut) for r in L.table_text(members, blocks, 20).orderBy("table_ord").collect()] == [(0, "[b:2] Table 1. X\n[b:", True), (1, "[b:3] | a |", False)]
    assert [r.excerpt for r in L.rendered_order(blocks, blocks.filter("ord < 3")).collect()] == ["See Table 1", "Table 1. X"]
    assert {r.anchor: r.tokens for r in L.prose_tokens(blocks).collect()}["b:1"] == ["table"]
    boxes = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,)], "b array<double>").select(L.box(F.col("b")).alias("b")).collect()
    assert [r.b for r in boxes] == [[1.0, 2.0, 3.0, 4.0], None, None]


def test_provenance_files(spark, tmp_path):
    for paper, text in (("p", '{"[b:1]": {"page": 3}, "b:2": {"page": null}}'), ("q", "{broken")):
        (tmp_path / paper).mkdir()
        (tmp_path / paper / "provenance.json").write_text(text)
    got = L.read_provenance(spark, f"{tmp_path}/*/provenance.json").orderBy("anchor").collect()
    assert [(r.paper_id, r.anchor) for r in got] == [("p", "b:1"), ("p", "b:2")] and '"page":3' in got[0].entry.replace(" ", "")


def test_attempts(spark):
    rows = [("p", "r1", "Table__t1", "final", 1, '{"status": "ready", "x": 1}'), ("p", "r1", "Table__t1", "final", 2, '{"status": "error", "x": 2}'), ("p", "r1", "Site", "draft", 1, "{}"), ("p", "r2", "Site", "final", 1, "{"), ("p", "r2", "Site", "final", 1, "{}")]
    a = spark.createDataFrame(rows, "paper_id string, run_id string, record_key string, stage string, attempt int, data string")
    assert [(r.run_id, r.n) for r in L.attempt_conflicts(a).collect()] == [("r2", 2)]
    assert {r.run_id: r.records for r in L.records_of(a).collect()} == {"r1": ["Site", "Table__t1"], "r2": ["Site"]}
    assert {r.record_key: r.final for r in L.final_records(a.filter("run_id = 'r1'")).collect()} == {"Site": None, "Table__t1": rows[1][5]}
    assert [r.x for r in L.cached(a, "Table__", "x", "error").collect()] == ["2"] and L.cached(a, "Table__", "x", "ready").collect() == []
    assert [(r.paper_id, r.runs) for r in L.runs(a).collect()] == [("p", ["r1", "r2"])]


def test_streams(spark):
    tool, error = '{"type": "tool_use", "part": {"state": {"status": "completed"}}}', '{"type": "error"}'
    defect = '{"type": "error", "error": "<|channel|> unavailable tool"}'
    rows = [("ok", tool, "x", 0), ("stall", f"noise\n{tool}", None, 0), ("down", "", None, 1), ("err", f"{tool}\n{error}", None, 0), ("leak", defect, None, 0), ("quiet", '{"type": "step"}', None, 0)]
    s = spark.createDataFrame(rows, "k string, stdout string, final_text string, returncode int")
    assert {r.k: r.state for r in L.stream_state(s, "stdout", "k").collect()} == {"ok": "answered", "stall": "stall", "down": "outage", "err": "outage", "leak": "no_answer", "quiet": "no_answer"}


def test_reports(spark):
    df = spark.createDataFrame
    found = df([("p", "leak", False), ("p", "leak", False), ("p", "dup", False), ("q", None, False), ("r", None, True)], "paper_id string, kind string, missing boolean")
    per = L.quality_summary(found)
    assert {r.paper_id: (r.issues, r.passed) for r in per.collect()} == {"p": ({"dup": 1, "leak": 2}, False), "q": ({}, True), "r": ({}, False)}
    assert tuple(L.quality_totals(per).collect()[0]) == (3, 1, 2, 1)
    assert sorted(map(tuple, L.cause_counts(df([("Site", "ABSENT"), ("Site", "ABSENT"), ("Site", None)], "entity_type string, cause string")).collect())) == [("Site", "ABSENT", 2)]
    fields = df([("p", "Site", "s", "name", "East ", ["[b:2]", "b:1"]), ("p", "Site", "s", "region", "x" * 100, ["b:2"]), ("p", "Site", "s2", "name", " ", None)], "paper_id string, entity_type string, record_id string, path string, value string, locators array<string>")
    assert {r.record_id: r.anchors for r in L.cited_anchors(fields).collect()} == {"s": ["b:1", "b:2"], "s2": []}
    got = {r.record_id: r.summary for r in L.summaries(fields, {"Site": ["name", "region"]}).collect()}
    assert got["s2"] == "s2" and got["s"].startswith("East · xx") and len(got["s"]) == 80 and got["s"].endswith("…")
    rows = df([("b", 1), ("Ab", 2), ("c", 3), (None, 4)], "t string, n int")
    assert [r.n for r in L.matches_first(rows, "t", "n", "a").collect()] == [2, 1, 3, 4] and [r.n for r in L.matches_first(rows, "t", "n", " ").collect()] == [1, 2, 3, 4]
