"""Scalar functions on literal rows."""

import datetime as dt
import re
import unicodedata

import pytest

from anchorage.functions import text as T
from anchorage.functions import values as V
from anchorage.operators import ledger
from anchorage.sources import html


def run(spark, values, f, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.select("i", f(df).alias("o")).orderBy("i").select("o").collect()]


def test_coordinates(spark):
    got = run(spark, ["45°42′ N", "36˚37´N", "35°3' N", "121.5 W", "45-46 N", "12°61' N", "N 45 S", "45", "10°20'30\" E", None], lambda d: V.parse_coordinate(d.v))
    want = [45.7, 36 + 37 / 60, 35.05, -121.5, None, None, None, None, 10 + 20 / 60 + 30 / 3600, None]
    assert [g and g.decimal for g in got] == [pytest.approx(w) if w is not None else None for w in want]
    assert got[0].is_sexagesimal and got[3].hemisphere == "W" and not got[3].is_sexagesimal


def test_cells(spark):
    got = run(spark, ["2.8 ± 0.3 a", "1.2 [0.9, 1.5]", "3.4 (0.2)", "88±22 mm", "1 2 3", "text", "–0,5"], lambda d: V.parse_cell(d.v))
    assert (got[0].mean, got[0].dispersion, got[0].letters) == (2.8, 0.3, "a")
    assert (got[1].low, got[1].high) == (0.9, 1.5) and got[2].parenthetical == 0.2
    assert (got[3].dispersion, got[3].letters) == (22.0, None)
    assert got[4] is None and got[5] is None and got[6].mean == -0.5


def test_dates(spark):
    d = dt.date
    cases = {
        "9 June 1993": (d(1993, 6, 9), d(1993, 6, 9)),
        "June 9, 1993": (d(1993, 6, 9), d(1993, 6, 9)),
        "15-24 June 1981": (d(1981, 6, 15), d(1981, 6, 24)),
        "28 May to 3 June 1981": (d(1981, 5, 28), d(1981, 6, 3)),
        "June 1993": (d(1993, 6, 1), d(1993, 6, 30)),
        "1993-06 to 1993-08": (d(1993, 6, 1), d(1993, 8, 31)),
        "1993-06-02": (d(1993, 6, 2), d(1993, 6, 2)),
        "9 June": (None, None),
        "9 June 1993 and 10 July 1994": (None, None),
        "31 June 1993": (None, None),
        "before planting": (None, None),
    }
    got = run(spark, list(cases), lambda x: V.parse_dates(x.v))
    assert [(g.earliest, g.latest) for g in got] == list(cases.values())
    assert got[-1].relative_timing == "before_planting" and got[0].relative_timing is None


def test_numbers_and_ranges(spark):
    assert run(spark, ["–0.69", "0-0.1", "g m -2", "x 1,234.5 and (-3)", "5 -2"], lambda d: T.numbers_in(d.v)) == [[-0.69], [0.0, 0.1], [2.0], [1234.5, -3.0], [5.0, 2.0]]
    got = run(spark, ["10–20 cm and 30-25"], lambda d: V.ranges_in(d.v))
    assert [tuple(r) for r in got[0]] == [(10.0, 20.0)]


def test_units(spark):
    keys = run(spark, ["g N m -2", "g N m^{-2}", "g N m⁻²", "g·N·m-2"], lambda d: T.units_key(d.v))
    assert len(set(keys)) == 1
    cases = [("g", "5 g of soil"), ("g", "going"), ("µmol", "10 μmol per"), ("%", "45% of"), ("m2", "per m 2"), ("mm", "5 cm")]
    assert run(spark, cases, lambda d: T.supports_units(d.u, d.t), "u string, t string") == [True, False, True, True, True, False]


def test_grounding(spark):
    cases = [("NH4+-N", "the NH 4 + -N pool", True), ("abc", "ab d", False), ("", "x", False), ("STRASSE", "straße 5", True), (None, "x", True)]
    assert run(spark, [(v, t) for v, t, _ in cases], lambda d: T.supports_string(d.v, d.t), "v string, t string") == [w for *_, w in cases]
    assert run(spark, [(12, "a 12 b"), (12, "a 112 b"), (None, "")], lambda d: T.supports_integer(d.v, d.t), "v int, t string") == [True, False, True]
    assert run(spark, [(2.0, "is 2 kg"), (2.5, "12.5"), (2.5, "2.5 kg")], lambda d: T.supports_double(d.v, d.t), "v double, t string") == [True, False, True]


def test_typography_is_idempotent(spark):
    values = ["$\\mathrm{Mg~ha^{-1}}$", "V_{\\text{cmax}}", "N_a and C_i", "CO_2 – 5 µg", "a  b\tc", "x^2", "5 \\pm 2"]
    once = run(spark, values, lambda d: T.canon(d.v))
    assert once[0] == "mg ha-1" and once[1] == "vcmax" and once[2] == "na and ci" and once[6] == "5 ± 2"
    assert run(spark, once, lambda d: T.canon(d.v)) == once


def _two_stretches(text, blocks):
    words = re.findall("[a-z0-9]+", text.lower())
    padded = [" " + " ".join(re.findall("[a-z0-9]+", b.lower())) + " " for b in blocks]
    has = lambda p: any(f" {' '.join(p)} " in b for b in padded)
    return bool(words) and any(has(words[:k]) and (k == len(words) or has(words[k:])) for k in range(1, len(words) + 1))


def test_stretches(spark):
    cases = [("a b c d", ["x a b", "c d y"]), ("a b c d", ["a x b", "c d"]), ("", ["a"]), ("a b", ["a b"]), ("a c", ["a", "b"])]
    assert run(spark, cases, lambda d: T.two_stretches(d.t, d.b), "t string, b array<string>") == [_two_stretches(*c) for c in cases]
    got = run(spark, [("first part ... last part", "the first part is here and the last part"), ("last ... first", "first then last"), ("...", "x"), ("5 x 10 ... mol m", "5x10 and molm"), ("5 x 10 ... mol m", "5x10 and mol x"), ("ab ... first", "ab first")], lambda d: T.segments_in_order(d.e, d.t), "e string, t string")
    assert got == [True, False, False, True, False, False]


def test_keys(spark):
    assert run(spark, ["  Nitrogen-Rates (kg) ", "Varieties"], lambda d: T.name_key(d.v)) == ["nitrogen rate kg", "variety"]
    assert run(spark, ["A b--C!", "??", None], lambda d: T.slug(d.v)) == ["a_b_c", "candidate", "candidate"]
    assert unicodedata.normalize("NFC", "é") == "é"


def test_html(spark):
    got = run(spark, ["P &lt; 0.05 <b>x</b>", "a&lt;sup&gt;-2&lt;/sup&gt;", "<sup>&amp;</sup>lt;sup&gt;1&lt;/sup&gt;", "<math> x </math>", None, "&amp;lt;"], lambda d: html.html_to_text(d.v))
    assert got == ["P < 0.05 x", "a -2", "1", "$x$", "", "&lt;"]
    table = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>"
    assert run(spark, [table, "", "<p>"], lambda d: html.table_markdown(d.v)) == ["| A | B |\n|---|---|\n| 1 |  |", "*[empty table]*", "*[table with no parseable rows]*"]


def test_unpacked_rows(spark):
    got = run(spark, [(["1 2", "3 4"],), (["x", "5 6"],), (["1", "2"],), (["1 2", "3"],)], lambda d: V.unpack(d.v), "v array<string>")
    assert got == [[["1", "3"], ["2", "4"]], [["x", "5"], ["x", "6"]], [["1", "2"]], [["1 2", "3"]]]


def test_statistics(spark):
    assert run(spark, ["std err", " SD ", "range"], lambda d: V.statistic_alias(d.v)) == ["SE", "SD", "range"]
    got = run(spark, [(["n", "values are means ± s.e."], False), (["95% confidence interval"], True), (["standard deviation"], True)], lambda d: V.statistic_name(d.s, d.h), "s array<string>, h boolean")
    assert got == ["SE", "95% CI", None]


def test_causes(spark):
    schema = "status string, d struct<unresolved_cause:string,failure_kind:string,failure_class:string,message:string,unresolved_by:string>, reason string, errors string, ready string"
    n = (None,) * 5
    cases = [
        (("ready", n, None, None, None), None),
        (("blocked", n, "current-IR limitation L1", None, None), "SCHEMA_LIMITATION"),
        (("blocked", n, "no site", None, None), "BLOCKED_PREREQUISITE"),
        (("error", (None, "provider", None, None, None), None, None, None), "PROVIDER_FAILURE"),
        (("error", (None, None, None, "raw evidence grounding failed", None), None, None, None), "GROUNDING_FAILURE"),
        (("error", (None, None, "no_final_answer", None, None), None, None, None), "NOT_RETRIEVED"),
        (("error", n, None, None, None), "VALIDATION_FAILURE"),
        (("unresolved", (None, None, None, None, "ai_validation"), None, "x", None), "AI_CONCERN"),
        (("unresolved", n, None, "is ambiguous among 2", None), "AMBIGUOUS"),
        (("unresolved", n, None, "is not supported by block", None), "GROUNDING_FAILURE"),
        (("unresolved", n, None, None, "does not give a value"), "ABSENT"),
        (("unresolved", n, None, None, None), "NOT_READY"),
    ]
    got = run(spark, [c for c, _ in cases], lambda d: ledger.cause_of(d.status, d.d, d.reason, d.errors, d.ready), schema)
    assert got == [w for _, w in cases]


def test_layers():
    assert ledger.layers(ledger.DEPENDENCIES)[0] == ["Citation", "Site", "Species", "Variable"]
    assert "Observation" in ledger.dependents(ledger.DEPENDENCIES, {"Species"})
    with pytest.raises(ValueError):
        ledger.layers((("a", "b"), ("b", "a")))


def test_close_matches_of_other_first_letters(spark):
    from difflib import get_close_matches

    from anchorage.functions import similar

    words = ["total_nitrogen", "aboveground_biomass", "grain_yield", "leaf_area_index", "root_depth", "plant_height"]
    terms = ["nitrogen", "biomass", "yield", "qqq"]
    found = similar.close_matches(spark.createDataFrame([(t,) for t in terms], "t string"), "t", spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    for t in terms:
        assert {r.w for r in found if r.t == t} == set(get_close_matches(t, words, 5, 0.3))
    assert ("nitrogen", "total_nitrogen") in {(r.t, r.w) for r in found}


def test_coordinate_shapes(spark):
    told = ["N 45°30'", "45° 30.5' S", "-12.25°", "12°30", "1234 N", "45 30' N", "10°75'N", "N", "12°20'30''W", "12° N E", "45,5 N", ""]
    got = [g and round(g.decimal, 6) for g in run(spark, told, lambda d: V.parse_coordinate(d.v))]
    assert got == [45.5, -45.508333, -12.25, None, None, 45.5, None, None, -12.341667, None, None, None]


def test_cell_parts(spark):
    got = run(spark, ["5.1 ± x", "1,5 [1,0, 2,0] (0,3) ab", "(3)", "4 ab c", "−2", "7 [1, 2", "3 ± 1 ± 2", "$5 \\pm 2$", None], lambda d: V.parse_cell(d.v))
    assert got[0] is None and tuple(got[1]) == (1.5, None, 1.0, 2.0, 0.3, "ab") and all(got[i] is None for i in (2, 3, 5, 6, 8))
    assert got[4].mean == -2 and (got[7].mean, got[7].dispersion) == (5, 2)


def test_significant_tokens(spark):
    assert run(spark, ["Measured using the oven-drying method, soil"], lambda d: T.significant_tokens(d.v)) == [["oven", "drying", "soil"]]
