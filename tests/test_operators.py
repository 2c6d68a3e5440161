"""Document, record, search, link, table and log operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from anchorage.operators import core, documents, integrity, ledger, links, search, tables
from anchorage.sources import logs

BLOCKS = "paper_id string, anchor string, ord int, block_type string, text string, page int"


@pytest.fixture(scope="module")
def paper(spark):
    texts = [
        ("SectionHeader", "# A title", 0), ("SectionHeader", "## Abstract", 0), ("Text", "We measured things.", 0), ("Text", "Study site", 0),
        ("SectionHeader", "## Materials and methods", 1), ("Text", "Plots, see Tables 2-4 and Fig. 1.", 1), ("Caption", "Table 1. Yields", 1),
        ("PageHeader", "Journal", 1), ("Table", "| a | b |\n|---|---|\n| 1 | 2 |", 1), ("PageFooter", "3", 1), ("Table", "| 5 | 6 |\n|---|---|", 2),
        ("Text", "Notes.", 2), ("Table", "| x |\n|---|", 2), ("Caption", "Figure 1 A plot", 2), ("SectionHeader", "## Results", 2), ("Text", "Figure 1 again", 3),
        ("SectionHeader", "## References", 3), ("Text", "Someone 1990.", 3),
    ]
    return spark.createDataFrame([("p", f"b:{i:04d}", i, t, x, pg) for i, (t, x, pg) in enumerate(texts, 1)], BLOCKS)


def test_regions(paper):
    got = {r.ord: (r.region, r.section) for r in documents.with_regions(paper).collect()}
    assert got[1][0] == "front_matter" and got[3][0] == "abstract" and got[6][0] == "methods" and got[16][0] == "results" and got[18][0] == "references"
    assert got[4][1] == "Study site" and got[6][1] == "Materials and methods"


def test_tables_and_labels(paper):
    got = {r.head: r for r in documents.linked_tables(paper).collect()}
    assert got["b:0009"].anchors == ["b:0009", "b:0011"] and got["b:0009"].label == "Table 1" and got["b:0009"].caption_anchor == "b:0007"
    assert got["b:0013"].label is None
    assert [(r.label, r.anchor) for r in documents.figures(paper).collect()] == [("Figure 1", "b:0014")]
    refs = {(r.anchor, r.target) for r in documents.cross_references(paper.filter("ord = 6"), "text").collect()}
    assert refs == {("b:0006", t) for t in ("Table 2", "Table 3", "Table 4", "Figure 1")}


def test_sections_and_neighbours(paper):
    assert [r.ord for r in documents.section(paper, "methods").orderBy("ord").collect()] == list(range(5, 15))
    got = {r.anchor: r.around for r in documents.neighbours(paper, 1, 1, ["Text"]).collect()}
    assert got["b:0004"] == ["b:0003", "b:0004", "b:0006"] and got["b:0003"] == ["b:0003", "b:0004"]


def test_anchors_end_their_block(spark):
    rows = documents.anchored_blocks(spark.createDataFrame([("p", "one ⟦b:0001⟧\n two⟦b:0010⟧ rest")], "paper_id string, content string")).collect()
    assert [(r.anchor, r.text, r.text_raw, r.ord) for r in rows] == [("b:0001", "one", "one ", 1), ("b:0010", "two", "\n two", 10)]


def test_quality(spark, paper):
    blocks = paper.select("paper_id", "anchor", "block_type", F.lit(True).alias("rendered_in_content_md"))
    anchors = paper.select("paper_id", "anchor")
    assert documents.quality_report(blocks, anchors).first().passed
    bad = documents.quality_report(blocks.filter("anchor <> 'b:0003'"), anchors.filter("anchor <> 'b:0005'").union(anchors.limit(1))).first()
    assert (bad.duplicates, bad.no_provenance, bad.not_in_text, bad.passed) == (1, 1, 1, False)
    leaks = {r.name: r.hits for r in documents.leak_sweep(spark.createDataFrame([("a <b>x</b> &lt;sup&gt; <math> &amp;lt;",)], "t string"), "t").collect()}
    assert leaks == {"html_escaped_tag_fragment": 1, "raw_unrendered_tag": 2, "leftover_content_ref": 0, "dangling_amp_entity": 1}


def test_row_clusters(spark):
    got = spark.createDataFrame([([10.0, 13.0, 16.0, 30.0],)], "v array<double>").select(core.cluster_rows(F.col("v"), 5.0)).first()[0]
    assert [r.row for r in got] == [0, 0, 1, 2]


def test_layout_tree(spark):
    tree = {"id": "/doc", "block_type": "Document", "children": [{"id": "/page/0/Page/0", "block_type": "Page", "children": [
        {"id": "/page/0/SectionHeader/1", "block_type": "SectionHeader", "html": "<h2>Methods</h2>"},
        {"id": "/page/0/Text/2", "block_type": "Text", "html": "<p>P &lt; 0.05</p>", "section_hierarchy": {"2": "/page/0/SectionHeader/1", "3": "/x"}},
        {"id": "/page/0/PageFooter/3", "block_type": "PageFooter", "html": "9"}, {"id": "/page/0/Odd/4", "block_type": "Odd", "html": "?"}]}]}
    nodes = logs.flatten_layout(spark.createDataFrame([("p", json.dumps(tree)), ("q", "{broken")], "paper_id string, json string"))
    assert nodes.filter("error is not null").count() == 1
    got = {r.block_type: r for r in logs.anchored(nodes).collect()}
    assert got["SectionHeader"].anchor == "b:0001" and got["Text"].anchor == "b:0002" and got["Text"].text == "P < 0.05"
    assert got["PageFooter"].anchor is None and got["Odd"].unhandled_block_type and got["Text"].page_id == "page_0"
    assert {r.section_path[1] for r in logs.section_paths(nodes).collect()} == {"[unresolved /x]"}
    cells = spark.createDataFrame([("p", "t", [x, y, x + 1.0, y + 2.0]) for x, y in ((5.0, 0.0), (1.0, 2.0), (1.0, 20.0))], "paper_id string, parent_table_anchor string, bbox array<double>")
    assert sorted((r.bbox[0], r.row_index, r.col_index) for r in logs.grid_positions(cells).collect()) == [(1.0, 0, 0), (1.0, 1, 0), (5.0, 0, 1)]


def test_tree_files(spark):
    files = [("a/p1", "p1.json"), ("a/p1", "x.json"), ("a/p2", "y.json"), ("a/p2", "y_meta.json"), ("a/p3", "1.json"), ("a/p3", "2.json"), ("a/p4", "z.txt")]
    got = {r.directory: (r.name, r.error) for r in logs.one_tree_file(spark.createDataFrame(files, "directory string, name string")).collect()}
    assert got == {"a/p1": ("p1.json", None), "a/p2": ("y.json", None), "a/p3": (None, "several tree files"), "a/p4": (None, "no tree file")}


def test_ledger(spark):
    rows = [(1, "p", "Site", "s1", "ready", "r1"), (2, "p", "Site", "s1", "unresolved", "r2"), (3, "p", "Site", "s2", "ready", "r2")]
    log = spark.createDataFrame(rows, "seq long, paper_id string, entity_type string, record_id string, status string, run_id string")
    assert [r.record_id for r in ledger.dataset_records(log).collect()] == ["s2"]
    assert {r.record_id for r in ledger.dataset_records(log, "r1").collect()} == {"s1"}
    fields = spark.createDataFrame([("p", "Site", "s1", f, v) for f, v in (("name", "A"), ("lat", "1"), ("lon", None))], "paper_id string, entity_type string, record_id string, field_name string, value string")
    acts = [(1, "name", "edit", "B", None), (2, "name", "accept", None, "other"), (3, None, "accept", None, "r"), (4, "lat", "reject", None, "r")]
    log = spark.createDataFrame([(s, "p", "Site", "s1", f, a, p, r) for s, f, a, p, r in acts], "seq long, paper_id string, entity_type string, record_id string, field_name string, action string, payload string, run_id string")
    state = ledger.review_state(fields, log, "r")
    assert {r.field_name: (r.effective, r.review) for r in state.collect()} == {"name": ("B", "edited"), "lat": (None, "rejected"), "lon": (None, "accepted")}
    assert ledger.review_summary(state, ["lon"]).first().fields == 2


def test_unique_best_refuses_ties(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 2), ("c", "x", 0)], "k string, c string, s int")
    assert {r.k: r.c for r in core.unique_best(rows, ["k"], "s", ["c"]).collect()} == {"a": "x", "b": None, "c": None}


def test_budget(spark):
    rows = spark.createDataFrame([("p", i, n) for i, n in enumerate([5, 9, 3, 4, 1])], "p string, i int, n int")
    assert [r.i for r in core.budget_fold(rows, ["p"], ["i"], "n", 10).orderBy("i").collect()] == [0, 2, 4]
    assert [r.i for r in core.budget_fold(rows, ["p"], ["i"], "n", 14, "stop").orderBy("i").collect()] == [0, 1]


def test_links(spark):
    ids = spark.createDataFrame([(x,) for x in ("abc", "abd", "ab", "xabc", "zzz")], "v string")
    assert {(r.id_a, r.id_b) for r in links.one_edit_apart(ids, "v").collect()} == {("abc", "abd"), ("ab", "abc"), ("ab", "abd"), ("abc", "xabc")}
    cand = spark.createDataFrame([("p", "1", "t1"), ("p", "2", "t9"), ("q", "3", None), ("r", "4", None)], "paper_id string, id string, link string")
    pools = spark.createDataFrame([("p", ["t1", "t2"], True), ("q", ["t5"], True), ("r", ["t5"], False)], "paper_id string, ids array<string>, complete boolean")
    got = {r.id: (r.bound, r.refusal) for r in links.known_references(cand, pools, ["paper_id"]).collect()}
    assert got == {"1": ("t1", None), "2": (None, "BLOCKED_PREREQUISITE"), "3": ("t5", None), "4": (None, "AMBIGUOUS")}
    values = spark.createDataFrame([("p", "row", "Maize"), ("p", "row", "high N")], "paper_id string, k string, v string")
    pool = spark.createDataFrame([("p", "T1", "maize"), ("p", "T2", "high nitrogen")], "paper_id string, id string, name string")
    assert links.match_in_scope(values, pool, ["paper_id"], "k", "v", "name", "id").first().id == "T1"


def test_search(spark):
    rows = spark.createDataFrame([("p", "the leaf area index (LAI) rose")], "paper_id string, text string")
    assert ("lai", "leaf area index") in {(r.term, r.alias) for r in search.abbreviations(rows, "text").collect()}
    flags = search.signal_flags(spark.createDataFrame([("45° N, 120 m a.s.l., doi 10.1000/xyz, n = 4",)], "t string"), "t").first()
    assert flags.coordinate and flags.elevation and flags.doi and flags.statistic and not flags.pooling
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps over it yy"), (2, "quick")], "d int, t string")
    asked = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "quick"), (3, "absent words of some length here ok")], "q int, p string")
    assert {r.q: (r.n, r.first_doc) for r in search.grounded(asked, "q", "p", docs, "d", "t").collect()} == {1: (1, 1), 2: (2, 1), 3: (0, None)}


def test_tables(spark):
    schema = "paper_id string, table_id string, row_groups array<struct<row_group_id:string,factor_values:map<string,string>,cells:map<string,string>>>, value_columns array<struct<value_column_id:string,variable:string,factor_levels:map<string,string>>>"
    groups = [("g1", {"crop": "wheat"}, {"c1": "5", "c2": " "}), ("g2", {"crop": "LSD"}, {"c1": "1"}), ("g3", {"crop": "rye"}, {"c1": "6", "c9": "7", "c3": "2"})]
    t = spark.createDataFrame([("p", "t", groups, [("c1", "yield", {}), ("c2", "yield", {}), ("c3", None, {})])], schema)
    got = {(r.row_group_id, r.value_column_id): r.route for r in tables.cell_candidates(t).collect()}
    assert got == {("g1", "c1"): "candidate", ("g2", "c1"): "statistic", ("g3", "c1"): "candidate", ("g3", "c9"): "unknown_column", ("g3", "c3"): "unidentified"}
    g = spark.createDataFrame([("t", "a", ["1", "2", "3"]), ("t", "b", ["9", "8"])], "t string, row_group_id string, values array<string>")
    grid = spark.createDataFrame([("t", 0, ["1", "2", "x"]), ("t", 1, ["3", "7"])], "t string, row_index int, cells array<string>")
    assert [(r.row_group_id, r.row_index) for r in tables.placements(g, grid, ["t"]).collect()] == [("a", 0)]


def test_streams(spark, tmp_path):
    from anchorage.streaming import logs as streams

    for n, rows in enumerate([[(1, "a", "x"), (5, "b", "y")], [(4, "a", "z"), (2, "b", "old")]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(json.dumps({"seq": s, "record_id": r, "status": v}) for s, r, v in rows) + "\n\n")
    source = logs.read_jsonl(spark, str(tmp_path / "in"), "seq long, record_id string, status string", stream=True).drop("_error")
    q = streams.latest_state(source, ["record_id"]).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.record_id, r.status) for r in spark.table("latest").collect()} == {("a", "z"), ("b", "y")}
    streams.upsert_into(source, str(tmp_path / "out"), ["record_id"], str(tmp_path / "cp")).awaitTermination(60)
    kept = core.latest_wins(spark.read.parquet(str(tmp_path / "out")), ["record_id"], F.col("seq"), ["status"])
    assert {(r.record_id, r.status) for r in kept.collect()} == {("a", "z"), ("b", "y")}


def _ef(kind="string"):
    return f"struct<value:{kind},provenance_label:string>"


@pytest.fixture(scope="module")
def dataset(spark):
    make = spark.createDataFrame
    e = lambda v, label="EXTRACTED": (v, label)
    return {
        "Citation": make([("c1",)], "id string"),
        "Study": make([("st1", ["c1"])], "id string, citation_ids array<string>"),
        "Site": make([("s1", e("North"))], f"id string, name {_ef()}"),
        "Species": make([("sp1", e("Zea mays"))], f"id string, scientific_name {_ef()}"),
        "Crop": make([("cr1", "c1", "sp1", e("X"), e(None, "UNRESOLVED"))], f"id string, citation_id string, species_id string, cultivar {_ef()}, common_name {_ef()}"),
        "Method": make([("m1", "c1", e("oven"))], f"id string, citation_id string, name {_ef()}"),
        "Variable": make([("v1", e("yield"))], f"id string, name {_ef()}"),
        "Treatment": make([("t1", "c1", "s1", e("st1"), e("low"), e("d"), e(True)), ("t2", "c1", "s1", e("st1"), e("high"), e("d"), e(False))], f"id string, citation_id string, site_id string, study_id {_ef()}, name {_ef()}, definition {_ef()}, control_status {_ef('boolean')}"),
        "TreatmentPair": make([("tp1", "c1", "t1", "t2")], "id string, citation_id string, treatment_id_1 string, treatment_id_2 string"),
        "Management": make([("mg1", "c1", e(["t1"]))], f"id string, citation_id string, treatment_ids {_ef('array<string>')}"),
        "Observation": make([("o1", "d1", "c1", "s1", "t1", "v1", "cr1", e("treatment_mean"), e([]))], f"id string, dataset_id string, citation_id string, site_id string, treatment_id string, variable_id string, crop_id string, reported_effect_scope {_ef()}, aggregated_over_factors {_ef('array<string>')}"),
        "dataset_id": make([("d1",)], "root string"),
        "Coverage": make([("cv1", "c1", "s1", "v1")], "id string, citation_id string, site_id string, variable_id string"),
    }


def test_containment_needs_the_id(dataset):
    with pytest.raises(ValueError):
        integrity.validate({k: v for k, v in dataset.items() if k != "dataset_id"})


def test_clean_graph_has_no_issues(dataset):
    assert integrity.validate(dataset).collect() == []


def _with(dataset, entity, **columns):
    rows = dataset[entity]
    for name, value in columns.items():
        rows = rows.withColumn(name, value if not isinstance(value, str) else F.lit(value))
    return dataset | {entity: rows}


def _value(value, kind="string", label="EXTRACTED"):
    return F.struct(F.lit(value).cast(kind).alias("value"), F.lit(label).alias("provenance_label"))


MUTATIONS = {
    "duplicate_id": lambda d: d | {"Site": d["Site"].union(d["Site"].withColumn("name", _value("South")))},
    "duplicate_site_name": lambda d: d | {"Site": d["Site"].union(d["Site"].withColumn("id", F.lit("s2")))},
    "duplicate_treatment_name": lambda d: _with(d, "Treatment", name=_value("same")),
    "multiple_controls": lambda d: _with(d, "Treatment", control_status=_value(True, "boolean")),
    "management_treatment_missing": lambda d: _with(d, "Management", treatment_ids=F.struct(F.array(F.lit("t9")).alias("value"), F.lit("EXTRACTED").alias("provenance_label"))),
    "management_without_treatment": lambda d: _with(d, "Management", treatment_ids=F.struct(F.array().cast("array<string>").alias("value"), F.lit("EXTRACTED").alias("provenance_label"))),
    "observation_treatment_missing": lambda d: _with(d, "Observation", treatment_id="t9"),
    "observation_site_mismatch": lambda d: _with(d, "Observation", site_id="s9"),
    "effect_scope_shape": lambda d: _with(d, "Observation", reported_effect_scope=_value("aggregated_mean")),
    "treatment_study_missing": lambda d: _with(d, "Treatment", study_id=_value("st9")),
    "treatment_study_unresolved": lambda d: _with(d, "Treatment", study_id=_value(None, label="UNRESOLVED")),
    "study_citation_missing": lambda d: _with(d, "Study", citation_ids=F.array(F.lit("c9"))),
    "citation_missing": lambda d: _with(d, "Method", citation_id="c9"),
    "crop_species_missing": lambda d: _with(d, "Crop", species_id="sp9"),
    "pair_treatment_missing": lambda d: _with(d, "TreatmentPair", treatment_id_1="t9"),
    "variable_missing": lambda d: _with(d, "Coverage", variable_id="v9"),
    "crop_missing": lambda d: _with(d, "Observation", crop_id="x"),
    "coverage_site_missing": lambda d: _with(d, "Coverage", site_id="x"),
    "treatment_name_may_encode_quantity": lambda d: _with(d, "Treatment", name=F.struct(F.concat(F.lit("n_120_kg "), "id").alias("value"), F.lit("EXTRACTED").alias("provenance_label"))),
}


@pytest.mark.parametrize("code", MUTATIONS)
def test_mutation_is_found(dataset, code):
    assert {r.code for r in integrity.validate(MUTATIONS[code](dataset)).collect()} == {code}


def test_readiness(dataset):
    assert integrity.readiness("Crop", dataset["Crop"]).count() == 0
    assert integrity.readiness("Variable", _with(dataset, "Variable", name=_value(None, label="UNRESOLVED"))["Variable"]).first().code == "variable_name_unresolved"


def test_grounded_short_and_empty_passages(spark):
    asked = [(1, "abc"), (2, "a b"), (3, ""), (4, "x  Y z w"), (5, None), (6, "q"), (7, "bc de"), (8, "one two three four five six seven eight")]
    docs = [(1, "xabcx a bq"), (2, None), (3, ""), (4, "ax y z wb"), (5, "abc de"), (6, "ONE two three  four five six seven eight")]
    got = search.grounded(spark.createDataFrame(asked, "p int, t string"), "p", "t", spark.createDataFrame(docs, "d int, x string"), "d", "x").collect()
    norm = lambda t: " ".join(t.lower().split())
    held = {k: [d for d, x in docs if t is not None and x is not None and norm(t) in norm(x)] for k, t in asked}
    assert {r.p: (r.n, r.first_doc) for r in got} == {k: (len(v), min(v, default=None)) for k, v in held.items()}
