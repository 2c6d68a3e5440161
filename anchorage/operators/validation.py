"""Records against their sources and their schema: grounding of fields and excerpts, and rules of construction.

``fields`` has one row for each field of a record: paper_id, entity_type, record_id, path, kind ('text', 'integer',
'double' or 'judgement'), value (as text), label, reason, locators (anchors). ``blocks``: paper_id, anchor, ord, text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .core import issues

BINOMIAL = r"(\b[A-Z][a-z]{2,}\s+[a-z]{3,}\b)"
_KEY = ["paper_id", "record_id", "path"]


def plain_anchor(anchor: Column) -> Column:
    return F.trim(F.translate(anchor, "[]", ""))


def supported(value: Column, kind: Column, text: Column) -> Column:
    """Whether a text bears a value of its kind; a judgement needs no literal match, an unreadable number fails."""
    number = F.coalesce(T.supports_double(value.try_cast("double"), text) & value.try_cast("double").isNotNull(), F.lit(False))
    whole = F.coalesce(T.supports_integer(value.try_cast("bigint"), text) & value.try_cast("bigint").isNotNull(), F.lit(False))
    return F.when(kind == "judgement", F.lit(True)).when(kind == "integer", whole).when(kind == "double", number).otherwise(T.supports_string(value, text))


def spelled_binomials(blocks: DataFrame) -> DataFrame:
    """The binomials each paper spells in full: paper_id, binomial (blanks collapsed)."""
    found = blocks.select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(BINOMIAL), F.lit(1))).alias("b"))
    return found.select("paper_id", F.regexp_replace("b", r"\s+", " ").alias("binomial")).distinct()


def abbreviated(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Values with one binomial written with its genus's first letter, where the same paper spells it in full: _KEY, variant."""
    told = fields.filter("kind = 'text' and value is not null").select(*_KEY, "value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(BINOMIAL), F.lit(1)))).alias("as_written"))
    told = told.withColumn("binomial", F.regexp_replace("as_written", r"\s+", " ")).join(spelled_binomials(blocks), ["paper_id", "binomial"])
    short = F.concat(F.substring("binomial", 1, 1), F.lit(". "), F.substring_index("binomial", " ", -1))
    return told.select(*_KEY, F.replace("value", F.col("as_written"), short).alias("variant"))


def field_issues(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fields whose cited block is not there or does not bear the value, and inferred judgements without a basis.

    Only EXTRACTED and INFERRED fields with a value are looked at; each locator stands for itself.
    """
    f = fields.filter("label in ('EXTRACTED', 'INFERRED') and value is not null")
    basis = f.filter((F.col("kind") == "judgement") & (F.col("label") == "INFERRED") & (F.trim(F.coalesce("reason", F.lit(""))) == ""))
    out = issues(basis, "error", "boolean_inference_basis_missing", "field", F.concat_ws("/", "record_id", "path"), "an inferred judgement needs a basis")
    variants = abbreviated(f, blocks).groupBy(*_KEY).agg(F.collect_set("variant").alias("variants"))
    cited = f.select(*_KEY, "kind", "value", F.explode(F.array_distinct("locators")).alias("anchor")).withColumn("anchor", plain_anchor(F.col("anchor")))
    cited = cited.join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"], "left").join(variants, _KEY, "left")
    at = F.concat_ws("/", "record_id", "path")
    missing = issues(cited.filter("text is null"), "error", "provenance_anchor_not_found", "field", at, F.concat_ws(" ", F.lit("no block"), "anchor"))
    bears = supported(F.col("value"), F.col("kind"), F.col("text")) | F.exists(F.coalesce("variants", F.array().cast("array<string>")), lambda v: T.supports_string(v, F.col("text")))
    wrong = issues(cited.filter(F.col("text").isNotNull() & ~bears), "error", "provenance_value_mismatch", "field", at, F.concat_ws(" ", "anchor", F.lit("does not bear"), "value"))
    return out.unionByName(missing).unionByName(wrong)


def _cited(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with the texts of the blocks they cite, those that exist, in document order; rows that cite none fall out."""
    found = rows.select(*_KEY, F.explode(F.array_distinct("locators")).alias("anchor")).withColumn("anchor", plain_anchor(F.col("anchor"))).distinct()
    texts = found.join(blocks.select("paper_id", "anchor", "ord", "text"), ["paper_id", "anchor"]).groupBy(*_KEY)
    return rows.join(texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "anchor", "text"))), lambda b: b["text"]).alias("texts")), _KEY)


def quantity_issues(quantities: DataFrame, blocks: DataFrame) -> DataFrame:
    """The parts of a quantity (reported_text, numeric, units) against the blocks it cites; any of them may bear a part."""
    rows = _cited(quantities, blocks)
    at = F.concat_ws("/", "record_id", "path")
    text = F.coalesce("reported_text", F.lit(""))
    unsaid = (F.trim(text) != "") & ~F.exists("texts", lambda t: T.supports_string(F.col("reported_text"), t))
    number = F.col("numeric").isNotNull() & F.col("reported_text").isNotNull() & ~F.exists(T.numbers_in(text), lambda n: F.abs(n - F.col("numeric")) < 1e-9)
    units = F.col("units").isNotNull() & ~F.exists("texts", lambda t: T.supports_units(F.col("units"), t))
    found = [("provenance_reported_text_mismatch", unsaid), ("provenance_numeric_mismatch", number), ("provenance_units_mismatch", units)]
    return reduce(DataFrame.unionByName, [issues(rows.filter(c), "error", code, "field", at, "not as the cited blocks have it") for code, c in found])


def date_issues(dates: DataFrame, blocks: DataFrame) -> DataFrame:
    """A date's reported text (at most two literal stretches) and the years of its ends against the blocks it cites."""
    rows = _cited(dates, blocks)
    at = F.concat_ws("/", "record_id", "path")
    text = F.coalesce("reported_text", F.lit(""))
    said = F.exists("texts", lambda t: T.supports_string(F.col("reported_text"), t)) | T.two_stretches(text, F.col("texts"))
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1), F.lit(""))
    stated = lambda y: F.exists("texts", lambda t: F.regexp_like(t, F.concat(F.lit(r"(?<!\d)"), y, F.lit(r"(?!\d)"))))
    unstated = reduce(lambda a, b: a | b, [year(F.col(c)).isNotNull() & ~F.coalesce(stated(year(F.col(c))), F.lit(True)) for c in ("earliest", "latest")])
    mismatch = issues(rows.filter((F.trim(text) != "") & ~said), "error", "provenance_date_text_mismatch", "field", at, "its text is not in the cited blocks")
    return mismatch.unionByName(issues(rows.filter(unstated), "error", "provenance_date_year_unsupported", "field", at, "its year is not in the cited blocks"))


def excerpt_issues(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Facts (paper_id, fact_id, anchors, excerpt) against their cited blocks read as one text in document order.

    Issues: anchor_not_found where any cited block is missing (its excerpt is not looked at then), else
    excerpt_not_found. A fact without anchors has an empty text, which bears no excerpt.
    """
    each = facts.select("paper_id", "fact_id", F.explode_outer(F.array_distinct("anchors")).alias("anchor")).withColumn("anchor", plain_anchor(F.col("anchor"))).distinct()
    each = each.join(blocks.select("paper_id", "anchor", "ord", "text"), ["paper_id", "anchor"], "left")
    gone = F.col("anchor").isNotNull() & F.col("text").isNull()
    there = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "anchor", "text"))))
    read = each.groupBy("paper_id", "fact_id").agg(F.array_sort(F.collect_set(F.when(gone, F.col("anchor")))).alias("missing"), F.array_join(F.transform(there, lambda b: b["text"]), "\n").alias("text"))
    rows = facts.select("paper_id", "fact_id", "excerpt").join(read, ["paper_id", "fact_id"])
    absent = issues(rows.filter(F.size("missing") > 0), "error", "anchor_not_found", "fact", "fact_id", F.concat_ws(" ", F.lit("no block"), F.array_join("missing", ", ")))
    ok = T.supports_string(F.col("excerpt"), F.col("text")) | T.segments_in_order(F.col("excerpt"), F.col("text"))
    return absent.unionByName(issues(rows.filter((F.size("missing") == 0) & ~F.coalesce(ok, F.lit(False))), "error", "excerpt_not_found", "fact", "fact_id", "not literal text of its blocks"))


def bears_known_value(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Each candidate (paper_id, candidate_id, known_value) with whether any of its facts (value, excerpt) has the value."""
    rows = known.join(facts.select("paper_id", "candidate_id", "value", "excerpt"), ["paper_id", "candidate_id"], "left")
    has = lambda c: F.col(c).isNotNull() & T.supports_string(F.col("known_value"), F.col(c))
    return rows.groupBy("paper_id", "candidate_id").agg(F.bool_or(F.coalesce(has("value") | has("excerpt"), F.lit(False))).alias("borne"))


# ---- construction: each rule takes the rows of one kind and returns issues


def _rule(rows: DataFrame, bad: Column, code: str, entity: str, key: Column | str, message: str) -> DataFrame:
    return issues(rows.filter(F.coalesce(bad, F.lit(False))), "error", code, entity, key, message)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def field_construction(fields: DataFrame) -> DataFrame:
    """Labels against values: what EXTRACTED, INFERRED and UNRESOLVED need and must not have."""
    at, label = F.concat_ws("/", "record_id", "path"), F.col("label")
    firm = label.isin("EXTRACTED", "INFERRED")
    found = [
        ("value_missing", firm & F.col("value").isNull()),
        ("value_with_unresolved", (label == "UNRESOLVED") & F.col("value").isNotNull()),
        ("unresolved_reason_missing", (label == "UNRESOLVED") & blank(F.col("reason"))),
        ("inference_basis_missing", (label == "INFERRED") & blank(F.col("reason"))),
        ("locator_missing", (label != "UNRESOLVED") & (F.size(F.coalesce("locators", F.array().cast("array<string>"))) == 0)),
        ("inferred_forbidden", (F.col("entity_type") == "Management") & F.col("path").isin("date", "amount") & (label == "INFERRED")),
    ]
    return reduce(DataFrame.unionByName, [_rule(fields, bad, code, "field", at, "its label and content do not fit") for code, bad in found])


def locator_construction(locators: DataFrame) -> DataFrame:
    """A table locator needs table_id, a figure locator figure_id."""
    bad = ((F.col("type") == "table") & blank(F.col("table_id"))) | ((F.col("type") == "figure") & blank(F.col("figure_id")))
    return _rule(locators, bad, "locator_target_missing", "locator", "record_id", "its table or figure is not named")


def conversion_construction(quantities: DataFrame) -> DataFrame:
    """A converted value needs its units, formula and rationale."""
    bad = F.col("converted_value").isNotNull() & (blank(F.col("converted_units")) | blank(F.col("conversion_formula")) | blank(F.col("conversion_rationale")))
    return _rule(quantities, bad, "conversion_incomplete", "quantity", "record_id", "units, formula or rationale is missing")


def date_construction(dates: DataFrame) -> DataFrame:
    """A date is an interval of two ordered ends or a relative timing, not both."""
    ends = F.col("earliest").isNotNull().cast("int") + F.col("latest").isNotNull().cast("int")
    relative = ~blank(F.col("relative_timing"))
    found = [("date_interval_and_relative", (ends > 0) & relative), ("date_one_end", ends == 1), ("date_reversed", F.col("earliest") > F.col("latest"))]
    return reduce(DataFrame.unionByName, [_rule(dates, bad, code, "date", "record_id", "the date is not one interval or timing") for code, bad in found])


def name_construction(species: DataFrame) -> DataFrame:
    """A scientific name starts with its genus and epithet where all three are there."""
    lead = F.concat_ws(" ", "genus", "epithet")
    bad = F.col("genus").isNotNull() & F.col("epithet").isNotNull() & F.col("scientific_name").isNotNull() & (F.col("scientific_name") != lead) & ~F.startswith(F.col("scientific_name"), F.concat(lead, F.lit(" ")))
    return _rule(species, bad, "scientific_name_mismatch", "Species", "id", "its name does not start with genus and epithet")


def pair_construction(pairs: DataFrame) -> DataFrame:
    return _rule(pairs, F.col("treatment_id_1") == F.col("treatment_id_2"), "pair_of_one", "TreatmentPair", "id", "a pair needs two treatments")


def study_construction(studies: DataFrame) -> DataFrame:
    return _rule(studies, F.size(F.coalesce("citation_ids", F.array().cast("array<string>"))) == 0, "study_without_citation", "Study", "id", "it cites nothing")


def candidate_construction(candidates: DataFrame) -> DataFrame:
    """Candidates of an enumeration (paper_id, enumeration, candidate_id, dimensions): unique ids, each dimension named once."""
    names = F.transform("dimensions", lambda d: T.fold_case(F.trim(d)))
    twice = _rule(candidates, F.size(F.array_distinct(names)) < F.size(names), "dimension_repeats", "candidate", "candidate_id", "a dimension is named twice")
    ids = candidates.groupBy("paper_id", "enumeration", "candidate_id").agg(F.count("*").alias("n"))
    return twice.unionByName(_rule(ids, F.col("n") > 1, "candidate_id_repeats", "candidate", "candidate_id", "its id stands more than once"))


def time_construction(levels: DataFrame, factors: DataFrame) -> DataFrame:
    """Time levels (table_id, factor, level, date_text, year_text): dated, once, of a declared time or treatment factor."""
    at = F.concat_ws("/", "table_id", "factor", "level")
    dated = _rule(levels, blank(F.col("date_text")) & blank(F.col("year_text")), "time_level_undated", "time_level", at, "neither date nor year")
    twice = _rule(levels.groupBy("table_id", "factor", "level").agg(F.count("*").alias("n")), F.col("n") > 1, "time_level_repeats", "time_level", at, "given more than once")
    fit = factors.filter("dimension in ('time', 'treatment')").select("table_id", F.col("name").alias("factor")).distinct()
    stray = levels.join(fit, ["table_id", "factor"], "left_anti")
    return dated.unionByName(twice).unionByName(_rule(stray, F.lit(True), "time_level_of_no_factor", "time_level", at, "its factor is not declared as time or treatment"))


def factor_construction(factors: DataFrame, used: DataFrame) -> DataFrame:
    """Factors (table_id, name, encoding, pooled) against their use (table_id, name, encoding): declared once, as used,
    pooled ones not at all in the table."""
    at = F.concat_ws("/", "table_id", "name")
    twice = _rule(factors.groupBy("table_id", "name").agg(F.count("*").alias("n")), F.col("n") > 1, "factor_repeats", "factor", at, "declared more than once")
    u = used.select("table_id", "name", F.col("encoding").alias("used_as")).distinct()
    undeclared = _rule(u.join(factors.select("table_id", "name").distinct(), ["table_id", "name"], "left_anti"), F.lit(True), "factor_undeclared", "factor", at, "used but not declared")
    both = factors.join(u, ["table_id", "name"])
    other = _rule(both, ~F.coalesce("pooled", F.lit(False)) & (F.col("encoding") != F.col("used_as")), "factor_encoding", "factor", at, "used in another encoding")
    pooled = _rule(both.select("table_id", "name", "pooled").distinct(), F.col("pooled"), "factor_pooled_in_table", "factor", at, "pooled, yet in the table")
    return twice.unionByName(undeclared).unionByName(other).unionByName(pooled)


def table_construction(tables: DataFrame) -> DataFrame:
    """Classified tables (table_id, role, applicable, scope, reason, table_anchors, row_anchors, row_ids, column_ids, cell_columns)."""
    firm = F.coalesce("applicable", F.lit(False))
    found = [
        ("table_reason_missing", ~firm & blank(F.col("reason"))),
        ("table_scope_missing", firm & blank(F.col("scope"))),
        ("table_ids_repeat", (F.size(F.array_distinct("row_ids")) < F.size("row_ids")) | (F.size(F.array_distinct("column_ids")) < F.size("column_ids"))),
        ("table_unknown_column", F.size(F.array_except("cell_columns", "column_ids")) > 0),
        ("table_row_elsewhere", F.size(F.array_except("row_anchors", "table_anchors")) > 0),
    ]
    return reduce(DataFrame.unionByName, [_rule(tables, bad, code, "table", "table_id", "the table's parts do not fit") for code, bad in found])


def variable_construction(columns: DataFrame) -> DataFrame:
    """Value columns (table_id, value_column_id, variable) name a variable; declared variables differ by their words."""
    return _rule(columns, blank(F.col("variable")), "column_without_variable", "column", F.concat_ws("/", "table_id", "value_column_id"), "it names no variable")


def variable_labels(variables: DataFrame) -> DataFrame:
    """Variables (table_id, label) whose labels are the same words."""
    twice = variables.groupBy("table_id", T.words_key(F.col("label")).alias("key")).agg(F.count("*").alias("n"))
    return _rule(twice, F.col("n") > 1, "variable_repeats", "variable", F.concat_ws("/", "table_id", "key"), "declared more than once")
