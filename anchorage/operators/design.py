"""Experimental design of a paper's tables: what cells are pooled over, factors and levels, repeated treatments.

``cells``: paper_id, table_id, row_group_id, value_column_id, cell_text. ``levels``: paper_id, table_id, row_group_id,
factor, level (the levels a row sets; NULL or '' sets none). ``factors``: paper_id, table_id, name, dimension, encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Labels of rows that hold a statistic (more may follow) and of those that sum up (nothing else does).
STATISTICS = ["p value", "p values", "p-value", "p-values", "pvalue", "pvalues", "probability", "significance", "lsd", "hsd", "msd", "se", "s.e.", "sem", "s.e.m.", "sd", "s.d.", "standard error", "standard deviation", "cv", "c.v.", "f value", "f values", "f-value", "f-values", "contrast", "contrasts"]
SUMMARIES = ["mean", "means", "average", "overall", "total", "totals", "pooled", "all", "all treatments", "all systems", "grand mean", "grand means", "grand average", "grand total"]
_TABLE = ["paper_id", "table_id"]


def _bare(label: Column) -> Column:
    return T.collapse(F.translate(F.lower(F.regexp_replace(label, r"^\W+", "")), ".-", "  "))


def _spelled(words: list[str]) -> list[str]:
    return sorted({" ".join(w.replace(".", " ").replace("-", " ").split()) for w in words} | {w.replace(".", "") for w in words if "." in w})


def is_statistic(label: Column) -> Column:
    """A label that starts with the name of a statistic, as whole words."""
    key = F.concat(_bare(label), F.lit(" "))
    return F.coalesce(F.exists(F.array(*map(F.lit, _spelled(STATISTICS))), lambda w: F.regexp_like(key, F.concat(F.lit("^"), w, F.lit("[^a-z0-9_]")))), F.lit(False))


def is_summary(label: Column) -> Column:
    """A label that is the name of a summary and nothing else."""
    return F.coalesce(F.regexp_replace(_bare(label), r"\W+$", "").isin(SUMMARIES), F.lit(False))


def design_levels(levels: DataFrame) -> DataFrame:
    """The levels that rows set, without rows of statistics."""
    rows = levels.filter("level is not null and trim(level) <> ''")
    tests = rows.filter(is_statistic(F.col("level"))).select(*_TABLE, "row_group_id").distinct()
    return rows.join(tests, [*_TABLE, "row_group_id"], "left_anti")


def summary_level(levels: DataFrame) -> DataFrame:
    """For each row the first level (by factor) that is a statistic or a summary: row, label."""
    found = levels.filter(is_statistic(F.col("level")) | is_summary(F.col("level")))
    return found.groupBy(*_TABLE, "row_group_id").agg(F.min_by("level", "factor").alias("label"))


def table_levels(levels: DataFrame, columns: DataFrame, context: DataFrame) -> DataFrame:
    """The distinct levels of each factor over a table's rows, columns and context (each paper_id, table_id, factor, level)."""
    parts = [d.select(*_TABLE, "factor", "level") for d in (levels, columns, context)]
    return parts[0].union(parts[1]).union(parts[2]).filter("level is not null and trim(level) <> ''").distinct()


def cell_pooling(cells: DataFrame, levels: DataFrame, factors: DataFrame) -> DataFrame:
    """Cells of main-effect tables with the factors they are pooled over, those their rows set, and what can't be recorded.

    A main-effect table's rows each set one factor while several occur. A factor is pooled over in a column only if
    the column has values in that factor's own rows. ``limitation`` is 'unidentified_row' where a row sets none,
    'treatment_pooled' where treatments are pooled and none is set, else NULL; cells pooled over nothing fall out.
    """
    rows = design_levels(levels)
    sets = rows.groupBy(*_TABLE, "row_group_id").agg(F.collect_set("factor").alias("own"))
    layout = sets.groupBy(*_TABLE).agg(F.bool_and(F.size("own") == 1).alias("one"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("all")).filter("one and size(all) > 1")
    dimension = factors.select(*_TABLE, F.col("name").alias("factor"), "dimension").dropDuplicates([*_TABLE, "factor"])
    full = cells.filter("trim(cell_text) <> ''")
    varies = full.join(rows, [*_TABLE, "row_group_id"]).select(*_TABLE, "value_column_id", "factor").distinct().join(dimension, [*_TABLE, "factor"], "left")
    varies = varies.groupBy(*_TABLE, "value_column_id").agg(F.array_sort(F.collect_set(F.struct("factor", F.coalesce("dimension", F.lit("")).alias("dimension")))).alias("varies"))
    tests = levels.filter(is_statistic(F.col("level"))).select(*_TABLE, "row_group_id").distinct()
    out = full.join(tests, [*_TABLE, "row_group_id"], "left_anti").join(layout.select(*_TABLE), _TABLE).join(sets, [*_TABLE, "row_group_id"], "left").join(varies, [*_TABLE, "value_column_id"], "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    pooled = F.filter("varies", lambda v: ~F.array_contains(own, v["factor"]))
    mine = F.filter("varies", lambda v: F.array_contains(own, v["factor"]))
    treatment = lambda a: F.exists(a, lambda v: v["dimension"] == "treatment")
    limitation = F.when(F.size(own) == 0, "unidentified_row").when(treatment(pooled) & ~treatment(mine), "treatment_pooled")
    names = F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.transform(pooled, lambda v: v["factor"]))
    out = out.select(*_TABLE, "row_group_id", "value_column_id", "cell_text", F.array_sort(own).alias("set_factors"), F.coalesce(names, F.array().cast("array<string>")).alias("pooled_over"), limitation.alias("limitation"))
    return out.filter("size(pooled_over) > 0 or limitation is not null")


def summary_pooling(levels: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows labelled as a summary: the factors whose place the label takes, and whether a treatment is among them."""
    found = levels.filter(is_summary(F.col("level"))).join(factors.select(*_TABLE, F.col("name").alias("factor"), "dimension"), [*_TABLE, "factor"], "left")
    return found.groupBy(*_TABLE, "row_group_id").agg(F.array_sort(F.collect_set("factor")).alias("pooled_over"), F.when(F.bool_or(F.coalesce(F.col("dimension") == "treatment", F.lit(False))), "treatment_pooled").alias("limitation"))


def time_span(levels: DataFrame, factors: DataFrame, order: DataFrame) -> DataFrame:
    """The time levels of each time factor as its table lists them; ``order``: paper_id, table_id, row_group_id, pos."""
    t = design_levels(levels).join(factors.filter("dimension = 'time'").select(*_TABLE, F.col("name").alias("factor")).distinct(), [*_TABLE, "factor"])
    first = t.join(order, [*_TABLE, "row_group_id"]).groupBy(*_TABLE, "factor", "level").agg(F.min("pos").alias("pos"))
    return first.groupBy(*_TABLE, "factor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "level"))), lambda x: x["level"]), ", ").alias("span"))


def effect_scope(aggregated: Column, factors: Column) -> Column:
    """A cell's effect scope and its pooled factors: none for a treatment's mean, NULL where they must still be told."""
    named = F.size(F.coalesce(factors, F.array().cast("array<string>"))) > 0
    return F.struct(
        F.when(aggregated, "aggregated_mean").otherwise("treatment_mean").alias("reported_effect_scope"),
        F.when(~aggregated, F.array().cast("array<string>")).when(named, factors).alias("aggregated_over_factors"),
    )


def summary(tables: DataFrame, factors: DataFrame, levels: DataFrame, readings: DataFrame) -> DataFrame:
    """Each factor of a paper: its dimension, levels that are no statistic, and the tables that are not withheld.

    ``tables``: paper_id, table_id, pos; ``readings``: paper_id, table_id, reading ('withhold' or other). A factor
    without such a level is a column of test results and falls out.
    """
    kept = tables.join(readings.filter("reading = 'withhold'").select(*_TABLE).distinct(), _TABLE, "left_anti")
    told = levels.filter("level is not null and trim(level) <> ''").filter(~is_statistic(F.col("level"))).join(kept, _TABLE)
    told = told.join(factors.select(*_TABLE, F.col("name").alias("factor"), "dimension"), [*_TABLE, "factor"])
    by_level = told.groupBy("paper_id", "factor", "level").agg(F.min(F.struct("pos", "table_id")).alias("first"))
    ordered = by_level.groupBy("paper_id", "factor").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "level"))), lambda x: x["level"]).alias("levels"))
    where = told.groupBy("paper_id", "factor").agg(F.min_by("dimension", "pos").alias("dimension"), F.array_sort(F.collect_set("table_id")).alias("tables"))
    return where.join(ordered, ["paper_id", "factor"])


def consistent(levels: DataFrame, readings: DataFrame) -> DataFrame:
    """Levels without those of withheld tables, aliased ones rewritten; ``readings``: paper_id, table_id, factor, level, reading, meant."""
    kept = levels.join(readings.filter("reading = 'withhold'").select(*_TABLE).distinct(), _TABLE, "left_anti")
    alias = readings.filter("reading = 'alias'").select(*_TABLE, "factor", "level", "meant").dropDuplicates([*_TABLE, "factor", "level"])
    return kept.join(alias, [*_TABLE, "factor", "level"], "left").withColumn("level", F.coalesce("meant", "level")).drop("meant")


def manifest(tables: DataFrame, candidates: DataFrame, limitations: DataFrame, failures: DataFrame) -> DataFrame:
    """Each table (paper_id, table_id, role) with its candidates by entity type, its limitations and its failures."""
    by = candidates.groupBy(*_TABLE, "entity_type").agg(F.count("*").alias("n")).groupBy(*_TABLE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("candidates"))
    lim = limitations.groupBy(*_TABLE).agg(F.array_sort(F.collect_set("limitation")).alias("limitations"))
    bad = failures.groupBy(*_TABLE).agg(F.count("*").alias("failures"))
    none = F.array().cast("array<string>")
    out = tables.join(by, _TABLE, "left").join(lim, _TABLE, "left").join(bad, _TABLE, "left")
    return out.select(*_TABLE, "role", F.coalesce("candidates", F.create_map().cast("map<string,bigint>")).alias("candidates"), F.coalesce("limitations", none).alias("limitations"), F.coalesce("failures", F.lit(0).cast("long")).alias("failures"))


def names_factor(phrase: Column, name: Column) -> Column:
    """The stem of every word of at least four letters (three letters less, four at least) stands in the phrase."""
    words = F.filter(F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 4)
    stems = F.transform(words, lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 3)))
    return (F.size(stems) > 0) & F.forall(stems, lambda s: F.contains(F.lower(phrase), s))


def promote_factors(factors: DataFrame, statements: DataFrame) -> DataFrame:
    """Time factors that a design statement (paper_id, anchor, phrase) of the paper names as treatments, with the evidence."""
    time = factors.filter("dimension = 'time'").select("paper_id", "name").distinct()
    found = time.join(statements, "paper_id").filter(names_factor(F.col("phrase"), F.col("name"))).groupBy("paper_id", "name").agg(F.min_by("anchor", F.struct("anchor", "phrase")).alias("evidence"))
    out = factors.join(found, ["paper_id", "name"], "left")
    promoted = (F.col("dimension") == "time") & F.col("evidence").isNotNull()
    return out.withColumns({"evidence": F.when(promoted, F.col("evidence")), "dimension": F.when(promoted, "treatment").otherwise(F.col("dimension"))})


def identities(candidates: DataFrame, site_matters: DataFrame) -> DataFrame:
    """Candidates with the key of their treatment levels and site, whether it is ambiguous, and their named levels.

    ``candidates``: paper_id, candidate_id, dimensions array<struct<name, dimension, level>>, site_id (NULL if the site
    text resolves to none or several). Names of factors count only where two levels of a candidate are the same text.
    """
    of = lambda d: F.filter("dimensions", lambda x: x["dimension"] == d)
    named = F.array_sort(F.transform(of("treatment"), lambda x: F.struct(T.canon(x["name"]).alias("name"), T.canon(x["level"]).alias("level"))))
    rows = candidates.withColumns({"named": named, "site_text": F.array_join(F.array_sort(F.transform(of("site"), lambda x: T.canon(x["level"]))), ";")}).join(site_matters, "paper_id", "left")
    texts = F.array_sort(F.transform("named", lambda x: x["level"]))
    levels = F.when(F.size(F.array_distinct(texts)) < F.size(texts), F.transform("named", lambda x: F.concat(x["name"], F.lit("="), x["level"]))).otherwise(texts)
    sited = F.coalesce("site_matters", F.lit(False))
    key = F.to_json(F.struct(levels.alias("levels"), F.when(sited, F.coalesce("site_id", F.lit(""))).alias("site")))
    ambiguous = sited & (F.col("site_text") != "") & F.col("site_id").isNull()
    return rows.select("paper_id", "candidate_id", "named", F.when(F.size("named") > 0, key).alias("identity"), ambiguous.alias("ambiguous"))


def settle_freeform(freeform: DataFrame, table: DataFrame) -> DataFrame:
    """What becomes of each free-form candidate beside the tables' candidates, with the reason.

    kept_unresolved: no dimensions, an ambiguous site, or the same levels under other factor names;
    dropped_no_treatment_dimension; dropped_covered by the first table candidate of the same identity; kept_new.
    The site counts only where the paper's candidates have more than one.
    """
    both = freeform.select("paper_id", "dimensions").union(table.select("paper_id", "dimensions"))
    sites = both.select("paper_id", F.explode("dimensions").alias("d")).filter("d.dimension = 'site'").select("paper_id", T.canon(F.col("d.level")).alias("s")).filter("s <> ''")
    matters = sites.groupBy("paper_id").agg((F.count_distinct("s") > 1).alias("site_matters"))
    t = identities(table, matters).filter("identity is not null and not ambiguous").select("paper_id", "identity", F.col("candidate_id").alias("table_candidate"), F.col("named").alias("tnamed"))
    f = freeform.select("paper_id", "candidate_id", F.size(F.coalesce("dimensions", F.array().cast("array<struct<name:string,dimension:string,level:string>>"))).alias("n")).join(identities(freeform, matters), ["paper_id", "candidate_id"])
    name = lambda a: F.transform(a, lambda x: x["name"])
    agrees = (F.size("named") == 1) | ~F.arrays_overlap(name("named"), name("tnamed")) | (F.col("named") == F.col("tnamed"))
    equal = f.filter("identity is not null and not ambiguous").join(t, ["paper_id", "identity"]).groupBy("paper_id", "candidate_id").agg(F.min(F.when(agrees, F.col("table_candidate"))).alias("matched"), F.lit(True).alias("equal"))
    rows = f.join(equal, ["paper_id", "candidate_id"], "left")
    outcome = (
        F.when(F.col("n") == 0, F.struct(F.lit("kept_unresolved").alias("decision"), F.lit("no dimensions").alias("reason")))
        .when(F.col("identity").isNull(), F.struct(F.lit("dropped_no_treatment_dimension").alias("decision"), F.lit("no treatment level").alias("reason")))
        .when(F.col("ambiguous"), F.struct(F.lit("kept_unresolved").alias("decision"), F.lit("ambiguous site").alias("reason")))
        .when(F.col("equal").isNull(), F.struct(F.lit("kept_new").alias("decision"), F.lit("no table has its identity").alias("reason")))
        .when(F.col("matched").isNull(), F.struct(F.lit("kept_unresolved").alias("decision"), F.lit("other factor names").alias("reason")))
        .otherwise(F.struct(F.lit("dropped_covered").alias("decision"), F.lit("same identity as a table's").alias("reason")))
    )
    return rows.select("paper_id", "candidate_id", outcome["decision"].alias("decision"), outcome["reason"].alias("reason"), "matched")


def evidenced_species(candidates: DataFrame, blocks: DataFrame, species: DataFrame) -> DataFrame:
    """The one species that a candidate's own blocks and their neighbours name; NULL where they name none or several.

    ``candidates``: paper_id, candidate_id, anchors; ``species``: paper_id, species_id, names.
    """
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "anchor"))
    numbered = blocks.select("paper_id", "anchor", "text", place.alias("n"))
    own = candidates.select("paper_id", "candidate_id", F.explode("anchors").alias("anchor")).join(numbered.select("paper_id", "anchor", "n"), ["paper_id", "anchor"])
    around = own.select("paper_id", "candidate_id", F.explode(F.sequence(F.col("n") - 1, F.col("n") + 1)).alias("n")).distinct().join(numbered.select("paper_id", "n", "text"), ["paper_id", "n"])
    padded = F.concat(F.lit(" "), T.words_key(F.col("text")), F.lit(" "))
    names = species.select("paper_id", "species_id", F.explode("names").alias("name")).select("paper_id", "species_id", T.words_key(F.col("name")).alias("name")).filter("name <> ''")
    hits = around.withColumn("_t", padded).join(names, "paper_id").filter(F.contains("_t", F.concat(F.lit(" "), "name", F.lit(" "))))
    found = hits.groupBy("paper_id", "candidate_id").agg(F.count_distinct("species_id").alias("n"), F.min("species_id").alias("species_id"))
    return candidates.select("paper_id", "candidate_id").join(found, ["paper_id", "candidate_id"], "left").select("paper_id", "candidate_id", F.when(F.col("n") == 1, F.col("species_id")).alias("species_id"))


def pooling_of_tables(windows: DataFrame, statements: DataFrame) -> DataFrame:
    """Pooling statements (paper_id, anchor, name, status, ...) of each table's window, each (anchor, name, status) once."""
    found = windows.select("paper_id", "table_anchor", "anchor").distinct().join(statements, ["paper_id", "anchor"])
    return found.dropDuplicates(["paper_id", "table_anchor", "anchor", "name", "status"])
