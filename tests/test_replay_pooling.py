"""Replay scores, record states, pooling statements and design."""

from pyspark.sql import functions as F

from anchorage.operators import pooling, replay

EXPECTED = "paper_id string, id string, entity_type string, status string, anchors array<string>, literals array<string>, pattern string, fields array<string>, contains_any array<string>, label_in array<string>, status_in array<string>"


def test_expectations(spark):
    rows = [
        ("p", "e1", "Site", "present", ["b:1"], ["45 N"], None, ["lat"], ["45"], [], ["ready"]),
        ("p", "e2", "Site", "present", ["b:9"], ["x"], None, [], ["zzz"], [], []),
        ("p", "e3", "Site", "absent", [], [], "glasshouse", [], ["glass"], [], []),
        ("p", "e3", "Site", "absent", [], [], "nothing", [], ["none"], [], []),
        ("p", "e4", "Table", "present", ["b:2"], ["7"], None, [], ["7"], [], []),
    ]
    exp = spark.createDataFrame(rows, EXPECTED)
    blocks = spark.createDataFrame([("p", "b:1", "at 45 N here"), ("p", "b:2", "a Glasshouse 7")], "paper_id string, anchor string, text string")
    faults = {(r.id, r.fault) for r in replay.verify_expectations(exp, blocks).collect()}
    assert faults == {("e2", "anchor_missing"), ("e2", "literal_absent"), ("e3", "pattern_matches"), ("e3", "id_repeats")}
    exp = exp.filter("pattern is null or pattern <> 'nothing'")
    fields = spark.createDataFrame([("p", "Site", "s1", "ready", "lat", "45.0", "EXTRACTED"), ("p", "Site", "s2", "error", "lat", "45", "EXTRACTED")], "paper_id string, entity_type string, record_id string, status string, field_name string, value string, label string")
    captured = replay.outcome_holds(exp, fields)
    assert {r.id: r.captured for r in captured.collect()} == {"e1": True, "e2": False, "e3": False, "e4": False}
    traces = spark.createDataFrame([("p", "Site", "supplied", "b:1"), ("p", "Site", "cited", "b:1"), ("p", "Table", "retrieved", "c:1")], "paper_id string, entity_type string, kind string, anchor string")
    cells = spark.createDataFrame([("p", "b:2", "c:1")], "paper_id string, parent_table_anchor string, anchor string")
    scored = replay.score(exp, traces, cells, captured)
    assert {r.id: r.state for r in scored.collect()} == {"e1": "captured", "e2": "not_seen", "e3": "rightly_absent", "e4": "seen_not_cited"}
    assert replay.summary(scored).first().captured == 1
    packets = spark.createDataFrame([("p", "Site", 1, "it is at 45  N")], "paper_id string, entity_type string, place int, text string")
    assert {r.id: r.recalled for r in replay.packet_recall(exp, packets).collect()} == {"e1": True, "e2": False, "e3": True, "e4": False}


def test_states(spark):
    rows = [("p", "S", "a", 1, "failed"), ("p", "S", "a", 2, "committed"), ("p", "S", "b", 1, "flagged"), ("p", "S", "c", 3, "failed")]
    got = replay.terminal_state(spark.createDataFrame(rows, "paper_id string, entity_type string, record_id string, seq int, outcome string"))
    assert {r.record_id: (r.status, r.attempts) for r in got.collect()} == {"a": ("ready", 2), "b": ("unresolved", 1), "c": ("error", 1)}
    old = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "bad")], "k string, verdict string")
    new = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("d", "ok")], "k string, verdict string")
    assert {r.k for r in replay.verdict_changes(old, new, ["k"]).collect()} == {"b", "c", "d"}
    fields = spark.createDataFrame([("r", "name"), ("r", "notes"), ("q", "name")], "record_id string, field_name string")
    doubts = spark.createDataFrame([("r", "notes", "not in text"), ("q", "name", "wrong site"), ("r", "name", "The name omits the cultivar")], "record_id string, field_name string, concern string")
    got = {(r.record_id, r.field_name): (r.doubted, r.settled) for r in replay.settle_concerns(fields, doubts, ["name"]).collect()}
    assert got == {("r", "name"): (False, True), ("r", "notes"): (True, True), ("q", "name"): (True, False)}
    facts = spark.createDataFrame([("r", "notes", False), ("r", "value", True), ("q", "value", False), ("q", "notes", True), ("s", "notes", False)], "record_id string, field_name string, grounded boolean")
    assert {(r.record_id, r.field_name) for r in replay.drop_ungrounded(facts, ["value"]).collect()} == {("r", "value"), ("q", "value"), ("q", "notes"), ("s", "notes")}
    assert [r[0] for r in spark.createDataFrame([("(a[b])",), ("(a",), ("$x$",), ("5 $ x",)], "t string").select(replay.balanced(F.col("t"))).collect()] == [True, False, True, False]
    told = ["lacks the unit", "Qualifier is gone", "abbreviated form", "does not fully reflect it", "wrong site", "naming style", None, "black"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in told], "t string").select(replay.is_naming_style(F.col("t"))).collect()] == [True] * 4 + [False] * 4


def test_pooling(spark):
    told = {
        "a": ("Values are averaged across years and locations. Something else follows here.", {("year", "time", "accepted", None), ("location", "site", "accepted", None)}),
        "b": ("Yield was pooled over sites.", {(None, None, "rejected", "no_reported_value")}),
        "c": ("Means of treatments were separated by Tukey tests after ANOVA.", set()),
        "d": ("Means were averaged over treatments and separated by Tukey.", {(None, None, "rejected", "statistical_procedure")}),
        "e": ("Data were pooled over replicates.", {("replicate", "replicate", "rejected", "replicate")}),
        "f": ("Data were combined over the two nitrogen treatments, since they did not differ.", {("nitrogen", "treatment", "accepted", None)}),
        "g": ("Values were averaged across treatments.", {(None, None, "rejected", "generic")}),
        "h": ("Results for all cultivars are given.", {(None, None, "rejected", "clause")}),
        "i": ("Means across N_rate.", {(None, None, "rejected", "digits_or_markup")}),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in told.items()], "paper_id string, text string")
    got = pooling.pooling_statements(rows, "text").collect()
    assert {k: {(r.name, r.dimension, r.status, r.reason) for r in got if r.paper_id == k} for k in told} == {k: w for k, (_, w) in told.items()}
    caption = pooling.pooling_statements(rows.filter("paper_id = 'b'"), "text", F.lit(True)).collect()
    assert [(r.name, r.status) for r in caption] == [("site", "accepted")]
    blocks = [("Caption", "Table 1. x"), ("Table", "|a|"), ("Text", "note"), ("Footnote", "f1"), ("SectionHeader", "# R"), ("Footnote", "far"), ("Table", "|b|"), ("Caption", "Table 9. y")]
    df = spark.createDataFrame([("p", f"b:{i}", i, t, x) for i, (t, x) in enumerate(blocks)], "paper_id string, anchor string, ord int, block_type string, text string")
    assert {(r.table_anchor, r.anchor, r.role) for r in pooling.windows(df).collect()} == {("b:1", "b:0", "caption"), ("b:1", "b:2", "note"), ("b:1", "b:3", "note")}
    f = spark.createDataFrame([("a", "site", True), ("a", "treatment", False), ("b", "time", True), ("c", "treatment", False)], "t string, dimension string, pooled boolean")
    assert {r.t: r.limitation for r in pooling.pooled_representable(f, ["t"]).collect()} == {"a": "L2", "b": "L1", "c": None}
    r = spark.createDataFrame([("a", 1, "N"), ("a", 2, "W"), ("b", 1, "N"), ("b", 1, "W"), ("c", 1, "N")], "t string, row_id int, factor string")
    assert {x.t: x.marginal for x in pooling.is_main_effect_layout(r, ["t"]).collect()} == {"a": True, "b": False, "c": False}
    lv = spark.createDataFrame([("t", "N", "High N"), ("t", "rate", "high-n"), ("t", "W", "dry")], "t string, factor string, level string")
    assert {(x.factor, x.other, x.verdict) for x in pooling.factor_readings(lv, ["t"]).collect()} == {("N", "rate", "alias"), ("rate", "N", "alias")}
    cells = spark.createDataFrame([("t", 1, "year", "1990", "s1"), ("t", 2, "year", "1991", "s1")], "t string, cell_id int, factor string, level string, site string")
    levels = spark.createDataFrame([("t", "year", "1990", None, "June 1990"), ("t", "year", "1991", "s1", "a"), ("t", "year", "1991", None, "b")], "t string, factor string, level string, site string, date_text string")
    assert [(x.cell_id, x.date_text) for x in pooling.time_level(cells, levels, ["t"]).collect()] == [(1, "June 1990")]
    w = spark.createDataFrame([("yield was then carefully measured with an oven".split(),), (["measured"] + ["x"] * 9 + ["yield"],)], "w array<string>")
    assert [x[0] for x in w.select(pooling.proximity(F.col("w"), ["measured"], ["yield"])).collect()] == [True, False]
