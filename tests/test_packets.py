"""Evidence packets on small documents, whole tables against plain restatements."""

import pytest

from anchorage.operators import packets as P

BLOCKS = "paper_id string, anchor string, ord int, text string, block_type string, region string, section string, page int"


def _blocks(spark, rows):
    return spark.createDataFrame([("p", a, i, t, k, r, None, None) for i, (a, k, r, t) in enumerate(rows)], BLOCKS)


@pytest.fixture
def built(spark):
    def run(rows, task=("Site", "extraction", None), seeds=(), members=(), refs=(), aliases=()):
        tasks = spark.createDataFrame([("t", "p", *task)], "task_id string, paper_id string, entity_type string, task string, target string")
        s = spark.createDataFrame([("t", a, i) for i, a in enumerate(seeds)], "task_id string, anchor string, pos int")
        m = spark.createDataFrame([("p", *x) for x in members], "paper_id string, table_ord int, label string, anchor string, role string, pos int")
        r = spark.createDataFrame([("p", *x) for x in refs], "paper_id string, from_anchor string, pos int, label string, kind string, targets array<string>")
        a = spark.createDataFrame([("p", *x) for x in aliases], "paper_id string, term string, alias string")
        items, audit = P.build(spark, tasks, _blocks(spark, rows), s, m, r, a)
        return sorted(items.collect(), key=lambda x: x.place), {x.concept: x for x in audit.collect()}, items, audit

    return run


def test_levels_and_audit(built, spark):
    rows = [
        ("a", "Text", "front_matter", "A title of nothing"),
        ("b", "Text", "methods", "The farm lay on loam"),
        ("c", "Text", "methods", "Seeds were few"),
        ("d", "Text", "discussion", "The valley was wet, rainfall was high"),
        ("e", "Text", "references", "Climate of a county at 45° N"),
    ]
    got, audit, items, coverage = built(rows, seeds=("c",))
    assert [(x.anchor, x.level) for x in got] == [("c", 0), ("b", 1), ("d", 1)]
    assert {k: v.status for k, v in audit.items()} == {"site_name": "FOUND", "coordinates": "ABSENT_BY_PATTERN", "elevation": "ABSENT_BY_PATTERN", "soil": "FOUND", "climate": "FOUND", "region": "FOUND"}
    text = P.render(items, coverage).collect()[0].packet
    assert text.startswith("[c] primary; candidate anchor\nSeeds were few") and "- soil: FOUND b" in text


def test_whole_document_search_stops_at_covered_concepts(built):
    rows = [("a", "Text", "results", "clay soil in the valley"), ("b", "Text", "results", "soil again"), ("c", "Text", "results", "soil thrice"), ("d", "Text", "results", "the region")]
    got, audit, _, _ = built(rows)
    # soil takes two; the first of them covers region, so d is not fetched
    assert [(x.anchor, x.level) for x in got] == [("a", 5), ("b", 5)]
    assert audit["region"].status == "FOUND" and audit["region"].anchors == ["a"]
    assert audit["climate"].status == "NOT_FOUND_AFTER_FULL_SEARCH"


def test_budget_passes_over_and_reports(built):
    big = "loam " * 400
    rows = [(f"m{i}", "Text", "methods", big) for i in range(6)] + [("z", "Text", "results", "rainfall " * 400), ("y", "Text", "results", "a mild climate")]
    got, audit, _, _ = built(rows, ("Site", "enumeration", None))
    assert [x.anchor for x in got] == ["m0", "m1", "m2", "m3", "y"] and got[0].truncated and len(got[0].body) == P.BLOCK_CHARS
    assert audit["climate"].anchors == ["y"] and audit["climate"].level == 5


def test_nothing_left_is_not_retrieved(built):
    rows = [(f"m{i}", "Text", "methods", "loam " * 400) for i in range(5)] + [("n", "Text", "methods", "loam " * 200), ("z", "Text", "results", "rainfall " * 40)]
    got, audit, _, _ = built(rows, ("Site", "enumeration", None))
    assert sum(len(x.body) for x in got) == 7000 and audit["climate"].status == "NOT_RETRIEVED" and audit["climate"].anchors == ["z"]


def test_targets_gate_signals(built):
    rows = [("a", "Text", "methods", "Plant height was 12 cm"), ("b", "Text", "methods", "Root mass was 3 kg"), ("c", "Text", "methods", "HGT of 4 m")]
    got, audit, _, _ = built(rows, ("Variable", "extraction", "plant_height"), aliases=[("plant_height", "hgt")])
    assert {x.anchor for x in got} == {"a"} | {"c"} and "b" not in audit["units"].anchors


def test_tables_come_with_caption_head_note_and_mentions(built):
    table = "| n | level |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(30))
    rows = [("a", "Text", "methods", "See Table 1 there"), ("c", "Caption", "results", "Table 1. Yield"), ("t", "Table", "results", table), ("n", "Footnote", "results", "* note"), ("o", "Footnote", "results", "second note"), ("x", "Text", "results", "Table 1 shows it"), ("y", "Text", "results", "Table 1 once more")]
    members = [(0, "Table 1", "c", "caption", 0), (0, "Table 1", "t", "table", 0), (0, "Table 1", "n", "note", 0), (0, "Table 1", "o", "note", 1)]
    refs = [(a, i, "Table 1", "table", ["t"]) for i, a in enumerate(("a", "x", "y"))]
    got, _, _, _ = built(rows, ("Method", "extraction", None), seeds=("a",), members=members, refs=refs)
    by = {x.anchor: x for x in got}
    assert [x.anchor for x in got] == ["a", "c", "t", "n", "x"]
    assert by["c"].kind == "caption" and by["c"].relation == "caption_of:Table 1"
    assert by["t"].kind == "table_header" and by["t"].body == "\n".join(table.split("\n")[:4])
    short, _, _, _ = built([*rows[:2], ("t", "Table", "results", "| n |\n|---|\n| 1 |"), *rows[3:]], ("Treatment", "enumeration", None), members=members, refs=refs)
    assert [x.anchor for x in short][:3] == ["c", "t", "n"] and short[1].kind == "table"


def test_roles_break_alone(spark):
    blocks = _blocks(spark, [("a", "Text", "methods", "x" * 60), ("b", "Text", "methods", "y" * 60), ("c", "Text", "methods", "z" * 30), ("d", "Table", "results", "plain")])
    roles = [("t", "p", 0, "method", 0, "a"), ("t", "p", 0, "method", 1, "b"), ("t", "p", 0, "method", 2, "c"), ("t", "p", 1, "table", 0, "a"), ("t", "p", 1, "table", 1, "d"), ("t", "p", 1, "table", 2, "gone")]
    got = P.by_role(spark.createDataFrame(roles, "task_id string, paper_id string, role_pos int, role string, pos int, anchor string"), blocks, cap=100).orderBy("place").collect()
    assert [(x.anchor, x.kind) for x in got] == [("a", "method"), ("d", "table_header")]


def test_ids_change_with_anchors_and_empty_tables(built, spark):
    tasks = spark.createDataFrame([("t", "p", "Site", "extraction", None)], "task_id string, paper_id string, entity_type string, task string, target string")
    hashes = spark.createDataFrame([("p", "h")], "paper_id string, document_hash string")
    one = built([("a", "Text", "methods", "loam")])[2]
    two = built([("a", "Text", "methods", "nothing"), ("b", "Text", "methods", "loam")])[2]
    ids = [P.packet_ids(tasks, x, hashes).collect()[0].packet_id for x in (one, two, one)]
    assert ids[0] == ids[2] != ids[1] and len(ids[0]) == 12
    got, audit, _, _ = built([])
    assert got == [] and audit == {}
