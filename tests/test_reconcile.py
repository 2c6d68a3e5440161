"""Reconciliation operators and similarity functions."""

from pyspark.sql import functions as F

from anchorage.functions import similar
from anchorage.operators import reconcile as R


def test_columns_and_levels(spark):
    v = spark.createDataFrame([("t", "Yield (t/ha)", "grain yield"), ("t", "N", "nitrogen"), ("t", "P", "nitrogen")], "t string, label string, variable_name string")
    c = spark.createDataFrame([("t", "c1", "Grain yield"), ("t", "c2", "N"), ("t", "c3", "nitrogen")], "t string, c string, variable string")
    assert {r.c: r.repaired for r in R.repair_column_variables(c, v, ["t"]).collect()} == {"c1": "Yield (t/ha)", "c2": "N", "c3": "nitrogen"}
    levels = spark.createDataFrame([("t", "n"), ("t", "K")], "t string, level string")
    assert [r.level for r in R.undeclared_levels(levels, v, ["t"]).collect()] == ["K"]
    got = spark.createDataFrame([(None, " ", "x"), ("a", "b", "c")], "a string, b string, c string").select(R.effective("e", "a", "b", "c")).collect()
    assert [r.e for r in got] == ["x", "a"]


def test_hints_and_links(spark):
    blocks = spark.createDataFrame([("p", "b1", "Text", "Carbon dioxide was measured with an infrared analyser."), ("p", "b2", "Table", "| x |")], "paper_id string, anchor string, block_type string, text string")
    hints = spark.createDataFrame([("p", "infrared analyser", "b1"), ("p", "measured carbon", "b2"), ("p", "oven drying", "b2")], "paper_id string, hint string, anchor string")
    flags = R.hint_flags(hints, blocks)
    assert {r.hint: (r.in_cited, r.in_prose) for r in flags.collect()} == {"infrared analyser": (True, True), "measured carbon": (False, True), "oven drying": (False, False)}
    known = spark.createDataFrame([("p", "Infrared Analyser")], "paper_id string, name string")
    assert [(r.hint, r.anchors) for r in R.hint_seeds(flags, known).collect()] == [("measured carbon", ["b2"])]
    methods = spark.createDataFrame([("p", "m1", "infrared analyser", ["b7"]), ("p", "m2", "oven", ["b7"])], "paper_id string, method_id string, name string, anchors array<string>")
    asked = spark.createDataFrame([("p", "carbon dioxide", "m1", "b1"), ("p", "nitrogen", "m1", "b1"), ("p", "carbon dioxide", "m2", "b1"), ("p", "x", "m1", "b9")], "paper_id string, variable string, method_id string, anchor string")
    assert sorted((r.variable, r.method_id, r.refusal or "") for r in R.verify_links(asked, blocks, methods).collect()) == [("carbon dioxide", "m1", ""), ("carbon dioxide", "m2", "method_not_named"), ("nitrogen", "m1", "variable_not_named"), ("x", "m1", "unknown_block")]
    cand = spark.createDataFrame([("p", "c", "low input", ["b1"], [("input", "low"), ("gas", "carbon dioxide"), ("n", "high")], {"site_ids": "s1"})], "paper_id string, candidate_id string, description string, anchors array<string>, dimensions array<struct<name:string,level:string>>, links map<string,string>")
    assert [r.level for r in R.unsupported_levels(cand, blocks).collect()] == ["high"]
    pools = spark.createDataFrame([("p", "site_id", ["s1", "s2"])], "paper_id string, field string, ids array<string>")
    assert R.unsplit_dimensions(cand, pools).count() == 1
    assert [(r.key, r.field) for r in R.misnamed_keys(cand, pools).collect()] == [("site_ids", "site_id")]


def test_records(spark):
    schema = "paper_id string, record_id string, mean double, statistic string, scope string, method_id string, units string"
    o = spark.createDataFrame([("p", "a", 2.0, "SE", "mean", "m", "g m-2"), ("p", "b", 2.0, None, "mean", "m", "kg")], schema)
    c = spark.createDataFrame([("p", "a", 2.0, "SE", None, "m", "g m⁻²"), ("p", "b", 2.1, "SD", "mean", None, "g")], schema)
    assert {(r.record_id, r.field) for r in R.observation_disagreements(o, c).collect()} == {("b", "mean"), ("b", "statistic"), ("b", "units")}
    m = spark.createDataFrame([("p", "e1", ["t1", "t2"]), ("p", "e2", ["t1"])], "paper_id string, record_id string, treatment_ids array<string>")
    v = spark.createDataFrame([("p", "e1", ["t1"]), ("p", "e2", ["t1"])], "paper_id string, record_id string, verified_ids array<string>")
    assert [(r.record_id, r.extra) for r in R.unverified_treatments(m, v).collect()] == [("e1", ["t2"])]
    t = spark.createDataFrame([("t1", False), ("t2", True)], "t string, has_pooled boolean")
    d = spark.createDataFrame([("t1", "years", "time"), ("t1", "N rate", "treatment"), ("t2", "sites", "site")], "t string, name string, dimension string")
    f = spark.createDataFrame([("t1", "N Rates")], "t string, name string")
    assert {(r.name, r.verdict) for r in R.apply_pooling(t, d, f, ["t"]).collect()} == {("years", "applied"), ("N rate", "conflict")}
    x = spark.createDataFrame([("p", "Yield", "t1", None, "kg", 1), ("p", "yield", "t2", "oven", None, 2)], "paper_id string, label string, table_id string, method_hint string, units string, ord int")
    assert [(r.label, r.tables, r.hints, r.units) for r in R.collect_variables(x).collect()] == [("Yield", ["t1", "t2"], ["oven"], "kg")]


def test_content_order(spark):
    html = "<content-ref src='/b'/><content-ref src=\"/a\"></content-ref>"
    rows = [("g", html, "/a", 0), ("g", html, "/b", 1), ("h", html, "/a", 0), ("h", html, "/c", 1)]
    got = R.content_order(spark.createDataFrame(rows, "g string, html string, node_id string, pos int"), "html", ["g"])
    assert {(r.g, r.node_id): r.place for r in got.collect()} == {("g", "/a"): 1, ("g", "/b"): 0, ("h", "/a"): 0, ("h", "/c"): 1}


def test_similarity(spark):
    df = spark.createDataFrame([("Hohenheim research station", "at the Hohenheim reserch station in"), ("abc", "zzz")], "v string, t string")
    got = [r[0] for r in df.select(similar.closest_span(F.col("v"), F.col("t"))).collect()]
    assert got[0].span == "Hohenheim reserch station" and got[0].ratio > 0.9 and got[1].span is None
    pairs = spark.createDataFrame([("São Paulo", "Sao Paulo"), ("Sao Paulo", "Sao Pablo"), ("a b", "a")], "v string, t string")
    assert [r[0] for r in pairs.select(similar.differs_in_letters_only(F.col("v"), F.col("t"))).collect()] == [True, False, False]
    names = spark.createDataFrame([("Trees of Pinus sylvestris grew. Published online there. Fagus sylvatica L. too. Zea mays", "Z. mays")], "t string, d string")
    assert names.select(similar.binomials(F.col("t"), F.col("d"))).first()[0] == ["Pinus sylvestris", "Fagus sylvatica", "Zea mays"]
    vocab = spark.createDataFrame([(w,) for w in ("harvest", "harrowing", "irrigation")], "w string")
    assert [r.w for r in similar.close_matches(spark.createDataFrame([("harvesting",)], "t string"), "t", vocab, "w").orderBy("place").collect()][0] == "harvest"
