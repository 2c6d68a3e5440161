"""Reconciliation of reconstructed tables, links and records with what their sources say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def repair_column_variables(columns: DataFrame, variables: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that name a variable by its name get its label, where one variable alone has that name."""
    labels = variables.select(*keys, F.col("label").alias("_label"), T.joined_key(F.col("label")).alias("_lk"), T.joined_key(F.col("variable_name")).alias("_nk"))
    rows = columns.withColumn("_k", T.joined_key(F.col("variable")))
    known = labels.select(*keys, F.col("_lk").alias("_k")).distinct().withColumn("_known", F.lit(True))
    named = labels.groupBy(*keys, F.col("_nk").alias("_k")).agg(F.count("*").alias("_n"), F.min("_label").alias("_label"))
    found = rows.join(known, [*keys, "_k"], "left").join(named, [*keys, "_k"], "left")
    fixed = F.when(F.col("_known").isNull() & (F.col("_n") == 1), F.col("_label")).otherwise(F.col("variable"))
    return found.select(*columns.columns, fixed.alias("repaired"))


def undeclared_levels(levels: DataFrame, variables: DataFrame, keys: list[str]) -> DataFrame:
    """Levels of variable factors that no variable declares."""
    known = variables.select(*keys, T.joined_key(F.col("label")).alias("_k")).distinct()
    return levels.withColumn("_k", T.joined_key(F.col("level"))).join(known, [*keys, "_k"], "left_anti").drop("_k")


def effective(column: str, *sources: str):
    """The first source with a text in it."""
    return F.coalesce(*[F.nullif(F.trim(F.col(s)), F.lit("")) for s in sources]).alias(column)


def hint_flags(hints: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hints with whether their cited block holds them, and whether all their significant words stand in one prose block."""
    cited = hints.join(blocks.select("paper_id", "anchor", F.col("text").alias("_cited")), ["paper_id", "anchor"], "left")
    in_cited = F.coalesce(T.supports_string(F.col("hint"), F.col("_cited")), F.lit(False))
    words = hints.select("paper_id", "hint", F.explode(F.array_distinct(T.significant_tokens(F.col("hint")))).alias("word")).distinct()
    prose = blocks.filter("block_type in ('Text', 'ListItem', 'Footnote', 'Caption')").select("paper_id", "anchor", F.explode(F.array_distinct(T.significant_tokens(F.col("text")))).alias("word"))
    sizes = words.groupBy("paper_id", "hint").agg(F.count("*").alias("_size"))
    hit = words.join(prose, ["paper_id", "word"]).groupBy("paper_id", "hint", "anchor").agg(F.count("*").alias("_n")).join(sizes, ["paper_id", "hint"]).filter("_n = _size")
    whole = hit.select("paper_id", "hint").distinct().withColumn("in_prose", F.lit(True))
    return cited.withColumn("in_cited", in_cited).drop("_cited").join(whole, ["paper_id", "hint"], "left").withColumn("in_prose", F.coalesce("in_prose", F.lit(False)))


def apply_pooling(tables: DataFrame, detected: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Detected pooled factors of tables that give none themselves; one that is a declared factor or level is rejected.

    ``tables``: keys, has_pooled; ``detected``: keys, name, dimension; ``factors``: keys, name (factors and levels).
    """
    declared = factors.select(*keys, T.name_key(F.col("name")).alias("_k")).distinct().withColumn("_declared", F.lit(True))
    rows = detected.join(tables.filter(~F.col("has_pooled")).select(*keys), keys).withColumn("_k", T.name_key(F.col("name")))
    found = rows.join(declared, [*keys, "_k"], "left")
    return found.select(*detected.columns, F.when(F.col("_declared"), "conflict").otherwise("applied").alias("verdict"))


def collect_variables(variables: DataFrame) -> DataFrame:
    """Distinct variables by key over a paper's tables, with the tables and hints in order."""
    rows = variables.withColumn("key", T.words_key(F.col("label")))
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))), lambda x: x["v"]))
    return rows.groupBy("paper_id", "key").agg(F.min_by("label", "ord").alias("label"), ordered("table_id").alias("tables"), ordered("method_hint").alias("hints"), F.min_by("units", F.when(F.col("units").isNotNull(), F.col("ord"))).alias("units"))


def hint_seeds(hints: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """Grounded hints that no candidate names yet, each with its first anchors."""
    rows = hints.filter("in_cited or in_prose").withColumn("key", T.words_key(F.col("hint")))
    new = rows.join(known.select("paper_id", T.words_key(F.col("name")).alias("key")).distinct(), ["paper_id", "key"], "left_anti")
    anchors = F.slice(F.array_sort(F.collect_set("anchor")), 1, most)
    return new.groupBy("paper_id", "key").agg(F.min("hint").alias("hint"), anchors.alias("anchors"))


def verify_links(proposals: DataFrame, blocks: DataFrame, methods: DataFrame) -> DataFrame:
    """Proposed links with why they are refused: the cited block must name the variable, and be or name the method.

    ``proposals``: paper_id, variable, method_id, anchor; ``methods``: paper_id, method_id, name, anchors.
    """
    rows = proposals.join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"], "left").join(methods, ["paper_id", "method_id"], "left")
    padded = F.concat(F.lit(" "), T.words_key(F.col("text")), F.lit(" "))
    says = lambda c: F.contains(padded, F.concat(F.lit(" "), T.words_key(F.col(c)), F.lit(" ")))
    reason = F.when(F.col("text").isNull(), "unknown_block").when(F.col("name").isNull(), "unknown_method").when(~says("variable"), "variable_not_named").when(~(F.array_contains("anchors", F.col("anchor")) | says("name")), "method_not_named")
    return rows.select(*proposals.columns, reason.alias("refusal"))


def pending_links(references: DataFrame, records: DataFrame) -> DataFrame:
    """References to records that are not ready, by field."""
    return references.join(records.select("paper_id", F.col("record_id").alias("target"), "status"), ["paper_id", "target"], "left").filter("status is null or status <> 'ready'")


def unsplit_dimensions(candidates: DataFrame, pools: DataFrame) -> DataFrame:
    """Required fields with several records to choose from that no candidate of the paper links."""
    used = candidates.select("paper_id", F.explode(F.map_keys("links")).alias("field")).distinct()
    return pools.filter(F.size("ids") > 1).join(used, ["paper_id", "field"], "left_anti").select("paper_id", "field")


def misnamed_keys(candidates: DataFrame, pools: DataFrame) -> DataFrame:
    """Link keys that are no field but its singular or plural."""
    stem = lambda c: F.regexp_replace(c, "s$", "")
    keys = candidates.select("paper_id", "candidate_id", F.explode(F.map_keys("links")).alias("key"))
    fields = pools.select("paper_id", "field").distinct()
    wrong = keys.join(fields.withColumnRenamed("field", "key"), ["paper_id", "key"], "left_anti")
    return wrong.withColumn("_s", stem(F.col("key"))).join(fields.withColumn("_s", stem(F.col("field"))), ["paper_id", "_s"]).drop("_s")


def unsupported_levels(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Declared levels that neither the candidate's description nor a cited block holds."""
    levels = candidates.select("paper_id", "candidate_id", "description", "anchors", F.explode("dimensions").alias("d")).select("paper_id", "candidate_id", "description", "anchors", "d.name", "d.level")
    cited = levels.withColumn("anchor", F.explode_outer("anchors")).join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"], "left")
    held = T.supports_string(F.col("level"), F.coalesce("description", F.lit(""))) | F.coalesce(T.supports_string(F.col("level"), F.col("text")), F.lit(False))
    return cited.groupBy("paper_id", "candidate_id", "name", "level").agg(F.bool_or(held).alias("ok")).filter("not ok").drop("ok")


def observation_disagreements(observations: DataFrame, context: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Where an observation differs from the cell it stands for: mean, statistic, scope, method, units.

    Both: paper_id, record_id, mean, statistic, scope, method_id, units; the context's nulls ask nothing.
    """
    both = observations.alias("o").join(context.alias("c"), ["paper_id", "record_id"])
    differ = lambda f: F.col(f"c.{f}").isNotNull() & ~F.col(f"o.{f}").eqNullSafe(F.col(f"c.{f}"))
    mean = F.col("c.mean").isNotNull() & ~F.coalesce(F.abs(F.col("o.mean") - F.col("c.mean")) <= tolerance, F.lit(False))
    units = F.col("c.units").isNotNull() & ~F.coalesce(T.units_key(F.col("o.units")) == T.units_key(F.col("c.units")), F.lit(False))
    faults = F.array_compact(F.array(F.when(mean, "mean"), F.when(units, "units"), *[F.when(differ(f), F.lit(f)) for f in ("statistic", "scope", "method_id")]))
    return both.select("paper_id", "record_id", F.explode(faults).alias("field"))


def unverified_treatments(managements: DataFrame, verified: DataFrame) -> DataFrame:
    """Treatments that an event links beyond the verified ones."""
    rows = managements.join(verified, ["paper_id", "record_id"], "left")
    extra = F.array_except("treatment_ids", F.coalesce("verified_ids", F.array().cast("array<string>")))
    return rows.select("paper_id", "record_id", extra.alias("extra")).filter(F.size("extra") > 0)


def content_order(children: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """Children of a group in the order of its content references; in their own order if the two don't match one to one."""
    refs = F.regexp_extract_all(html, F.lit("<content-ref\\s+src=['\"]([^'\"]+)['\"]\\s*/?>"), F.lit(1))
    own = children.groupBy(*keys).agg(F.array_sort(F.collect_list("node_id")).alias("_ids"))
    rows = children.join(own, keys).withColumn("_refs", refs)
    same = F.array_sort(F.col("_refs")) == F.col("_ids")
    return rows.withColumn("place", F.when(same, F.array_position("_refs", F.col("node_id")).cast("int") - 1).otherwise(F.col("pos"))).drop("_refs", "_ids")
