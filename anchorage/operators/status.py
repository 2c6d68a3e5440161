"""States of records and what is told about them: corrections, prerequisites, known values, method tiers, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .core import unique_best
from .links import pool_score

#: Fields that the pipeline owns, so that no concern about them counts; regions that tell a design.
OWNED = ("id", "record_id", "citation_id", "page_number", "source_document_id")
DESIGN_REGIONS = ("methods", "abstract", "front_matter")


def scoped_concerns(concerns: DataFrame) -> DataFrame:
    """Concerns (record_id, seq, verdict, field, ...) about fields that the pipeline does not own."""
    parts = F.split(F.coalesce("field", F.lit("")), r"[.\[\]]")
    return concerns.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, OWNED))))


def verdicts(judged: DataFrame, concerns: DataFrame) -> DataFrame:
    """Each judgement (record_id, seq, verdict); a suspicious one that is left without a concern is plausible.

    A judgement that never had a concern stays as it is.
    """
    keys = ["record_id", "seq"]
    had = concerns.groupBy(*keys).agg(F.count("*").alias("had"))
    left = scoped_concerns(concerns).groupBy(*keys).agg(F.count("*").alias("left"))
    rows = judged.join(had, keys, "left").join(left, keys, "left")
    plain = (F.col("verdict") == "suspicious") & F.col("had").isNotNull() & F.col("left").isNull()
    return rows.select(*keys, F.when(plain, "plausible").otherwise(F.col("verdict")).alias("verdict"))


def after_correction(first: DataFrame, second: DataFrame, demoted: DataFrame) -> DataFrame:
    """What becomes of each record after its first verdict, one correction, and demotion of the doubted fields.

    ``first``: record_id, verdict; ``second``: record_id, valid, verdict (of the corrected record; absent where no
    correction was made); ``demoted``: record_id, settled (whether no required field was lost). A record that was
    never judged is unresolved.
    """
    s = second.select("record_id", "valid", F.col("verdict").alias("verdict2"))
    rows = first.join(s, "record_id", "left").join(demoted.select("record_id", "settled"), "record_id", "left")
    fine = F.col("verdict") == "plausible"
    corrected = F.coalesce(F.col("valid") & (F.col("verdict2") == "plausible"), F.lit(False))
    step = F.when(F.col("verdict").isNull(), "never_validated").when(fine, "first").when(corrected, "corrected").when(F.coalesce("settled", F.lit(False)), "demoted").otherwise("concern")
    return rows.select("record_id", step.alias("by"), F.when(step.isin("first", "corrected", "demoted"), "ready").otherwise("unresolved").alias("status"))


def record_id(paper: Column, entity: Column, slug: Column | None = None) -> Column:
    """A record's id: the paper's for its citation, else paper, type in lower case and slug."""
    base = F.concat_ws("_", paper, F.lower(entity))
    return F.when(entity == "Citation", paper).otherwise(base if slug is None else F.concat_ws("_", base, slug))


def slug_of(paper: Column, entity: Column, record: Column) -> Column:
    """The slug of an id made by ``record_id``; the id itself where it was made otherwise."""
    lead = F.concat(paper, F.lit("_"), F.lower(entity), F.lit("_"))
    return F.when(F.startswith(record, lead), F.substring(record, F.length(lead) + 1, F.length(record))).otherwise(record)


def prerequisite_notes(records: DataFrame, needs: DataFrame, concerns: DataFrame) -> DataFrame:
    """For each dependent type its required prerequisites' records that are not ready, with their open fields.

    ``records``: paper_id, entity_type, record_id, status; ``needs``: entity_type, field, prerequisite, required.
    """
    open_ = concerns.groupBy("paper_id", "record_id").agg(F.array_sort(F.collect_set("field")).alias("open_fields"))
    waiting = records.filter("status <> 'ready'").withColumnRenamed("entity_type", "prerequisite").join(open_, ["paper_id", "record_id"], "left")
    found = needs.filter("required").select("entity_type", "field", "prerequisite").join(waiting, "prerequisite")
    return found.select("paper_id", "entity_type", "field", "prerequisite", "record_id", "status", F.coalesce("open_fields", F.array().cast("array<string>")).alias("open_fields"))


def found_concepts(audit: DataFrame, most: int = 3) -> DataFrame:
    """The concepts a packet found, each with up to three anchors, in order: 'soil (b:1, b:4)'."""
    told = F.concat(F.col("concept"), F.lit(" ("), F.array_join(F.slice("anchors", 1, most), ", "), F.lit(")"))
    return audit.filter("status = 'FOUND'").groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cpos", told.alias("t")))), lambda x: x["t"]).alias("found"))


def evidence_target(entity: Column, hint: Column, candidate: Column) -> Column:
    """What a packet is looked up by: a variable by its hint or its id's words, others by their anchors alone."""
    return F.when(entity == "Variable", F.coalesce(F.nullif(hint, F.lit("")), F.nullif(F.replace(candidate, F.lit("_"), F.lit(" ")), F.lit(""))))


def design_statements(blocks: DataFrame, names: DataFrame, design_term: Column) -> DataFrame:
    """For each candidate (paper_id, candidate_id, name of a treatment factor) the blocks that describe its factor.

    Blocks of the methods, abstract or front matter, no tables, with a design term, whose words contain the name.
    """
    told = blocks.filter(F.col("region").isin(*DESIGN_REGIONS) & (F.col("block_type") != "Table") & design_term).select("paper_id", "anchor", "ord", T.joined_key(F.col("text")).alias("_t"))
    keyed = names.select("paper_id", "candidate_id", T.joined_key(F.col("name")).alias("_k")).filter("_k <> ''").distinct()
    hits = keyed.join(told, "paper_id").filter(F.contains("_t", F.col("_k"))).select("paper_id", "candidate_id", F.struct("ord", "anchor").alias("x")).distinct()
    return hits.groupBy("paper_id", "candidate_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["anchor"]).alias("anchors"))


def without_treatments(tables: DataFrame, factors: DataFrame) -> DataFrame:
    """Papers whose data tables (role treatment_response) declare factors but not one treatment among them."""
    declared = tables.filter("role = 'treatment_response'").join(factors, ["paper_id", "table_id"])
    return declared.groupBy("paper_id").agg(F.bool_or(F.coalesce(F.col("dimension") == "treatment", F.lit(False))).alias("t")).filter("not t").select("paper_id", F.lit("L1").alias("limitation"))


def needs_method_map(methods: DataFrame) -> DataFrame:
    """Papers with more than one method that can be referred to: only those need a map of variables to methods."""
    return methods.groupBy("paper_id").agg(F.count_distinct("record_id").alias("methods")).filter("methods > 1")


def match_method(rows: DataFrame, pool: DataFrame, least: int = 3) -> DataFrame:
    """The method of each row (paper_id, row_id, value, hint) in its paper's pool (paper_id, slug, name, description).

    First by scored names: the strictly best; a tie is a tie and nothing more is tried. Where nothing scored at all,
    by description: the only entry whose name and description hold every significant token of the hint, of which
    there must be three. ``tier`` says which.
    """
    both = rows.join(pool, "paper_id").withColumn("_score", pool_score(F.col("value"), F.col("name")))
    best = unique_best(both.groupBy("paper_id", "row_id", "slug").agg(F.sum("_score").alias("_score")), ["paper_id", "row_id"], "_score", ["slug"])
    scored = both.groupBy("paper_id", "row_id").agg(F.max("_score").alias("_top"))
    tokens = F.array_distinct(T.significant_tokens(F.coalesce("hint", F.lit(""))))
    own = T.significant_tokens(F.concat_ws(" ", "name", "description"))
    told = both.filter((F.size(tokens) >= least) & (F.size(F.array_except(tokens, own)) == 0)).groupBy("paper_id", "row_id").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("by_text"))
    out = rows.select("paper_id", "row_id").distinct().join(best, ["paper_id", "row_id"], "left").join(scored, ["paper_id", "row_id"], "left").join(told, ["paper_id", "row_id"], "left")
    second = (F.coalesce("_top", F.lit(0)) == 0) & (F.col("n") == 1)
    return out.select("paper_id", "row_id", F.coalesce("slug", F.when(second, F.col("by_text"))).alias("slug"), F.when(F.col("slug").isNotNull(), "name").when(second, "description").alias("tier"))


def not_written(facts: DataFrame, papers: DataFrame, aliases: dict[str, list[str]], missable: list[str], identifier: str = "persistent_identifier") -> DataFrame:
    """Citation fields without a valued fact: 'not_written', or 'unreported' for an identifier that the front page has.

    ``facts``: paper_id, field_name, value; ``papers``: paper_id, has_identifier. Names are folded by ``aliases``.
    """
    fold = F.create_map(*[F.lit(x) for canonical, names in aliases.items() for n in [canonical, *names] for x in ("".join(c for c in n.lower() if c.isalnum()), canonical)])
    valued = facts.filter("trim(value) <> ''").select("paper_id", F.element_at(fold, T.joined_key(F.col("field_name"))).alias("field")).filter("field is not null").distinct()
    wanted = papers.select("paper_id", "has_identifier", F.explode(F.array(*map(F.lit, missable))).alias("field"))
    open_ = wanted.join(valued, ["paper_id", "field"], "left_anti")
    return open_.select("paper_id", "field", F.when((F.col("field") == identifier) & F.col("has_identifier"), "unreported").otherwise("not_written").alias("state"))


def corrections_checked(corrections: DataFrame, locators: DataFrame, blocks: DataFrame) -> DataFrame:
    """Corrections (paper_id, record_id, field_name, seq, value, run_id) with whether a cited block bears the new value.

    All are recorded, with their issues: an unsupported value or a field that cites no block says so. A correction
    without a run belongs to none.
    """
    keys = ["paper_id", "record_id", "field_name"]
    cited = locators.join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"]).select(*keys, "text")
    rows = corrections.join(cited, keys, "left")
    checked = rows.groupBy(*keys, "seq", "value", "run_id").agg(F.bool_or(F.coalesce(T.supports_string(F.col("value"), F.col("text")), F.lit(False)) & F.col("text").isNotNull()).alias("ok"), F.count("text").alias("cited"))
    return checked.select(*keys, "seq", "value", "run_id", F.when(F.col("value").isNull() | F.col("ok"), F.lit(None).cast("string")).when(F.col("cited") == 0, "nothing_cited").otherwise("unsupported").alias("issue"))


def observation_context(candidates: DataFrame, variables: DataFrame, methods: DataFrame, treatments: DataFrame, times: DataFrame, sites: DataFrame, scopes: DataFrame, statistics: DataFrame, designs: DataFrame) -> DataFrame:
    """Each cell's candidate with what was settled upstream, one struct a part; a part that is open is NULL.

    ``candidates``: paper_id, table_id, candidate_id, variable_id, treatment_id, site_id. Variables, treatments and sites join by their
    ids; methods by variable; times, scopes and statistics by candidate; designs by table. Each has one row a key.
    """
    part = lambda d, keys, name: d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(name))
    out = candidates
    for rows, key, name in ((variables, "variable_id", "variable"), (methods, "variable_id", "method"), (treatments, "treatment_id", "treatment"), (sites, "site_id", "site"), (times, "candidate_id", "time"), (scopes, "candidate_id", "aggregation"), (statistics, "candidate_id", "statistics"), (designs, "table_id", "design")):
        out = out.join(part(rows, ["paper_id", key], name), ["paper_id", key], "left")
    return out
