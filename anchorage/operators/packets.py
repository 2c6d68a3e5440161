"""Evidence packets: what a task is given of its document, by concept, level and character budget.

Tables of this module, one row each:

- ``tasks``: task_id, paper_id, entity_type, task ('extraction' or 'enumeration'), target (NULL for none)
- ``blocks``: paper_id, anchor, ord, text, block_type, region, section, page
- ``seeds``: task_id, anchor, pos
- ``members``: paper_id, table_ord, label, anchor, role ('table', 'caption' or 'note'), pos
- ``refs``: paper_id, from_anchor, pos, label, kind, targets (anchors)
- ``aliases``: paper_id, term, alias (lower case)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import SIGNALS

VERSION = "1"
#: Characters of a packet, of a block, of a table's head that is no pipe table; its lines; hits of a concept.
PACKET_CHARS, BLOCK_CHARS, HEAD_CHARS, HEAD_LINES, HITS = 7000, 1500, 400, 4, 3

#: Concepts of each entity type: name, phrases, signals, marks. Marks: e expected in the audit,
#: p absence shows by pattern, t the task's target and its aliases are phrases too.
CONCEPTS = {
    "Site": (
        ("site_name", "study site, experimental site, was conducted, were performed, located, farm, station, research center, forest, stand, near", "site_term", "e"),
        ("coordinates", "", "coordinate", "ep"),
        ("elevation", "", "elevation", "ep"),
        ("soil", "soil, loam, clay, sandy, silt, andisol, alfisol, mollisol", "", "e"),
        ("climate", "rainfall, precipitation, mean annual temperature, climate", "", "e"),
        ("region", "county, state, province, region, country, valley, mountains", "", "e"),
    ),
    "Species": (
        ("scientific_names", "", "binomial", "ep"),
        ("common_names", "cultivar, variety, crop, species, tree, saplings, seedlings", "", "e"),
    ),
    "Crop": (
        ("cultivars", "cultivar, cultivars, variety, varieties, genotype, population, populations, hybrid, line", "", "e"),
        ("species", "", "binomial", ""),
    ),
    "Variable": (
        ("definition", "", "measurement_verb", "et"),
        ("units", "", "unit", "et"),
        ("table_header", "", "", "t"),
    ),
    "Method": (
        ("procedure", "", "measurement_verb", "et"),
        ("instrument", "", "instrument", "e"),
    ),
    "Management": (
        ("planting", "planted, planting, sown, sowing, seeded, transplanted, transplanting, established", "management_verb", ""),
        ("harvest", "harvested, harvest, clipped, clipping", "", ""),
        ("fertilization", "fertilizer, fertilized, fertilization, kg n ha, applied", "", ""),
        ("irrigation", "irrigated, irrigation, watered, watering", "", ""),
        ("tillage", "tilled, tillage, disked, disced, plowed, spader, subsoiled, cultivated", "", ""),
        ("thinning", "thinned, thinning, stems ha, stem ha", "", ""),
        ("mowing_cutting", "mowed, mown, mowing, was cut, were cut, cut at ground level", "", ""),
        ("incorporation", "incorporated, incorporation", "", ""),
        ("amendment", "compost, manure, lime, amendment", "", ""),
        ("weeding", "weeded, weeding, weed control, herbicide", "", ""),
        ("residue_removal", "removed, removal, residue", "", ""),
        ("event_dates", "", "date, relative_time", ""),
        ("amounts", "", "amount", ""),
    ),
    "Treatment": (
        ("design", "treatment, treatments, control, levels, classes, compared, compare, comparison, versus, contrasted, gradient", "design_term", "e"),
        ("definitions", "", "", "t"),
        ("pooling", "", "pooling", ""),
    ),
    "Study": (
        ("design", "randomized, complete block, split-plot, factorial, replicates, experimental unit", "design_term", "e"),
        ("sample_size", "replicates, saplings were sampled, plots", "statistic", "e"),
        ("statistics", "analysis of variance, anova, regression, mixed model", "statistic", ""),
    ),
}
#: The regions of each type in order of preference; which take tables, all of them when enumerating, and
#: before the prose; budgets that differ; a table of so few lines is given in full.
REGIONS = {
    "Site": "methods abstract front_matter introduction",
    "Species": "front_matter abstract methods introduction",
    "Crop": "methods abstract front_matter",
    "Variable": "methods results abstract",
    "Method": "methods",
    "Management": "methods abstract front_matter",
    "Treatment": "methods abstract front_matter results",
    "Study": "methods abstract",
}
TABLES, ALL_TABLES, TABLES_FIRST = ("Variable", "Method", "Treatment"), ("Variable", "Treatment"), ("Variable", "Treatment")
EXTRACTION_CHARS = {"Variable": 9000, "Method": 9000, "Treatment": 9000}
ENUMERATION_CHARS = {"Method": 14000, "Treatment": 14000}
FULL_LINES = {"Treatment": 16}

_CONCEPT = "struct<name:string,phrases:array<string>,signals:array<string>,expected:boolean,detectable:boolean,use_target:boolean>"


def strategies(spark: SparkSession) -> DataFrame:
    """The rules as a table of eight rows: entity_type, its settings, and its concepts in order."""
    words = lambda text: [w.strip() for w in text.split(",") if w.strip()]
    rows = []
    for entity, concepts in CONCEPTS.items():
        chars = EXTRACTION_CHARS.get(entity, PACKET_CHARS)
        told = [(n, words(p), words(s), "e" in m, "p" in m, "t" in m) for n, p, s, m in concepts]
        rows.append((entity, REGIONS[entity].split(), entity in TABLES, entity in ALL_TABLES, entity in TABLES_FIRST, chars, ENUMERATION_CHARS.get(entity, chars), FULL_LINES.get(entity, 0), told))
    schema = f"entity_type string, regions array<string>, tables boolean, all_tables boolean, tables_first boolean, extraction_chars int, enumeration_chars int, full_lines int, concepts array<{_CONCEPT}>"
    return spark.createDataFrame(rows, schema)


def _prepared(phrase: Column) -> Column:
    return F.struct(phrase.alias("phrase"), T.canon(phrase).alias("norm"), T.significant_words(phrase).alias("words"))


def phrase_tier(phrase: Column, norm: Column, words: Column) -> Column:
    """1 the phrase stands in the text, 2 all its words do, 4 half of at least two; NULL for none."""
    n, have = F.size(phrase["words"]), F.size(F.filter(phrase["words"], lambda w: F.array_contains(words, w)))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    whole = F.contains(padded(norm), padded(phrase["norm"])) | ((F.length(phrase["norm"]) > 3) & F.contains(norm, phrase["norm"]))
    return F.when((phrase["norm"] != "") & whole, 1).when((n > 0) & (have == n), 2).when((n >= 2) & (2 * have >= n), 4)


def _hit(concept: Column, target: Column, norm: Column, words: Column, signals: Column) -> Column:
    """A concept's match in a block: name, tier (NULL for none), reasons. Any of its phrases or signals makes it.

    With a target, a concept of both target and signals needs the target's phrase or all its words in the same block.
    """
    phrases = F.concat(concept["phrases"], F.when(concept["use_target"], target).otherwise(F.slice(target, 1, 0)))
    found = F.filter(F.transform(phrases, lambda p: F.struct(phrase_tier(p, norm, words).alias("tier"), p["phrase"].alias("phrase"))), lambda x: x["tier"].isNotNull())
    named = F.array_intersect(concept["signals"], signals)
    gated = concept["use_target"] & (F.size(target) > 0) & (F.size(concept["signals"]) > 0)
    on_target = F.exists(target, lambda p: F.coalesce(phrase_tier(p, norm, words) <= 2, F.lit(False)))
    tier = F.least(F.array_min(F.transform(found, lambda x: x["tier"])), F.when(F.size(named) > 0, 3))
    kind = lambda x: F.when(x["tier"] == 1, "phrase:").when(x["tier"] == 2, "all words:").otherwise("some words:")
    reasons = F.concat(F.transform(found, lambda x: F.concat(kind(x), x["phrase"])), F.transform(named, lambda s: F.concat(F.lit("signal:"), s)))
    return F.struct(concept["name"].alias("name"), F.when(~gated | on_target, tier).alias("tier"), reasons.alias("reasons"))


def task_blocks(tasks: DataFrame, blocks: DataFrame, aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """Each task with the blocks of its document (references aside), and in each the concepts it hits, by name.

    Tasks of a type without a strategy fall out. A target's phrases are its words and its first six aliases.
    """
    told = aliases.groupBy("paper_id", "term").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, 6).alias("_aliases"))
    own = F.lower("target")
    t = tasks.withColumn("_term", own).join(told.withColumnRenamed("term", "_term"), ["paper_id", "_term"], "left").drop("_term")
    phrases = F.array_distinct(F.concat(F.array(F.replace("target", F.lit("_"), F.lit(" "))), F.coalesce("_aliases", F.array().cast("array<string>"))))
    prepared = F.filter(F.transform(phrases, _prepared), lambda p: F.size(p["words"]) > 0)
    nothing = F.slice(F.array(_prepared(F.lit(""))), 1, 0)
    t = t.withColumn("target_phrases", F.when(F.col("target").isNull() | (F.trim("target") == ""), nothing).otherwise(prepared)).drop("_aliases")
    concept = lambda c: F.struct(c["name"].alias("name"), F.transform(c["phrases"], _prepared).alias("phrases"), c["signals"].alias("signals"), c["expected"].alias("expected"), c["detectable"].alias("detectable"), c["use_target"].alias("use_target"))
    t = t.join(F.broadcast(rules.withColumn("concepts", F.transform("concepts", concept))), "entity_type")  # eight rows
    t = t.withColumn("cap", F.when(F.col("task") == "enumeration", F.col("enumeration_chars")).otherwise(F.col("extraction_chars")))
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in SIGNALS.items()]))
    b = blocks.filter("region is null or region <> 'references'").withColumns({"_norm": T.canon(F.col("text")), "_words": F.array_distinct(T.significant_words(F.col("text"))), "signals": hit})
    both = t.join(b, "paper_id")
    hits = F.filter(F.transform("concepts", lambda c: _hit(c, F.col("target_phrases"), F.col("_norm"), F.col("_words"), F.col("signals"))), lambda h: h["tier"].isNotNull())
    on_target = F.exists("target_phrases", lambda p: F.coalesce(phrase_tier(p, F.col("_norm"), F.col("_words")) <= 2, F.lit(False)))
    return both.withColumns({"hits": hits, "on_target": on_target}).drop("_norm", "_words")


def table_head(text: Column) -> Column:
    """The first four lines of a pipe table that are not blank, else the first 400 characters."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    piped = F.startswith(F.ltrim(F.get(lines, F.lit(0))), F.lit("|"))
    return F.when(F.coalesce(piped, F.lit(False)), F.array_join(F.slice(lines, 1, HEAD_LINES), "\n")).otherwise(F.substring(text, 1, HEAD_CHARS))


_ITEM = ("step", "rank", "anchor", "ord", "level", "kind", "relation", "reasons", "body", "truncated", "concept", "cpos", "hits")


def _items(rows: DataFrame, step: Column, rank: list, level: int, kind: str, relation: Column, reasons: Column, concept: Column | None = None, body: Column | None = None) -> DataFrame:
    """Candidates in one form; ``rank`` orders those of a step."""
    text = F.col("text") if body is None else body
    none = F.lit(None)
    return rows.select(
        "task_id", step.cast("int").alias("step"), F.array(*[F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in rank]).alias("rank"), "anchor", F.col("ord").cast("long").alias("ord"), F.lit(level).alias("level"),
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), relation.cast("string").alias("relation"), reasons.alias("reasons"), F.substring(text, 1, BLOCK_CHARS).alias("body"), (F.length(text) > BLOCK_CHARS).alias("truncated"),
        (none if concept is None else concept["name"]).cast("string").alias("concept"), (none if concept is None else concept["pos"]).cast("int").alias("cpos"), F.transform("hits", lambda h: h["name"]).alias("hits"),
    )


def fold(candidates: DataFrame, caps: DataFrame) -> DataFrame:
    """The items a task takes, in order, within its budget: each anchor once, one that does not fit is passed over.

    An item of a whole-document search (``concept`` set) is taken only while no item before that concept's turn hits
    the concept. One task's candidates, blocks of one document, lie in one row.
    """
    item = F.struct(*[c for c in _ITEM])
    rows = candidates.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("_items")).join(caps.select("task_id", "cap"), "task_id")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("anchors"), empty.alias("covered"), F.slice("_items", 1, 0).alias("taken"))

    def step(acc, x):
        fits = acc["used"] + F.length(x["body"]) <= F.col("cap")
        wanted = ~F.array_contains(acc["anchors"], x["anchor"]) & (x["concept"].isNull() | ~F.array_contains(acc["covered"], F.coalesce(x["concept"], F.lit(""))))
        shown = F.when(x["concept"].isNull(), x["hits"]).otherwise(F.filter(x["hits"], lambda h: h != x["concept"]))
        took = F.struct((acc["used"] + F.length(x["body"])).cast("long").alias("used"), F.array_append(acc["anchors"], x["anchor"]).alias("anchors"), F.array_union(acc["covered"], shown).alias("covered"), F.array_append(acc["taken"], x).alias("taken"))
        return F.when(wanted & fits, took).otherwise(acc)

    taken = F.aggregate("_items", start, step, lambda acc: acc["taken"])
    return rows.select("task_id", F.posexplode(taken).alias("place", "_x")).select("task_id", "place", "_x.*")


def _once(rows: DataFrame) -> DataFrame:
    """Rows that are read many times, written to the checkpoint folder where the session has one."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def build(spark: SparkSession, tasks: DataFrame, blocks: DataFrame, seeds: DataFrame, members: DataFrame, refs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packets' items and the audit of their concepts, for every task whose type has a strategy.

    Levels: 0 seeds, 1 their neighbours, 2 blocks of the preferred regions that hit a concept (the best three when
    extracting, all when enumerating; best by tier, number of concepts hit, reasons, region, order), 3 captions, heads
    and first notes of linked tables, 4 the first two blocks that refer to each, 5 the first two hits anywhere of a
    concept still missing. A task without blocks gets no item; tied ranks fall to the anchor.

    Returns (items: task_id, place, level, kind, relation, anchor, ord, reasons, body, truncated; audit: task_id,
    concept, cpos, status, level, anchors).
    """
    rules = strategies(spark)
    tb = _once(task_blocks(tasks, blocks, aliases, rules))
    per_task = tb.select("task_id", "cap").distinct()
    none = F.lit(None).cast("string")
    solid = F.col("block_type") != "Table"

    own = tb.join(seeds.select("task_id", "anchor", "pos"), ["task_id", "anchor"])
    level0 = _items(own.filter(solid), F.lit(0), [F.col("pos")], 0, "primary", none, F.array(F.lit("candidate anchor")))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "anchor"))
    numbered = blocks.select("paper_id", "anchor", place.alias("n"))
    around = own.filter(solid).select("task_id", "paper_id", F.col("anchor").alias("seed"), "pos").join(numbered.withColumnRenamed("anchor", "seed"), ["paper_id", "seed"])
    around = around.select("task_id", "paper_id", "seed", "pos", F.explode(F.array(F.col("n") - 1, F.col("n") + 1)).alias("n")).join(numbered, ["paper_id", "n"])
    near = tb.join(around.select("task_id", "anchor", "seed", F.col("pos").alias("spos")), ["task_id", "anchor"])
    level1 = _items(near, F.lit(1), [F.col("spos"), F.col("ord")], 1, "supporting", F.concat(F.lit("neighbour_of:"), "seed"), F.array(F.lit("reading-order neighbour")))

    liked = tb.withColumn("_region", F.array_position("regions", F.col("region"))).filter("_region > 0")
    names = F.transform("concepts", lambda c: c["name"])
    hit = liked.withColumn("h", F.explode("hits")).withColumn("cpos", F.array_position(names, F.col("h.name")))
    order = ["h.tier", F.desc(F.size("hits")), F.desc(F.size("h.reasons")), "_region", "ord", "anchor"]
    hit = hit.withColumn("_nth", F.row_number().over(Window.partitionBy("task_id", "cpos").orderBy(*order))).filter((F.col("task") == "enumeration") | (F.col("_nth") <= HITS))
    many = F.when(F.size("hits") > 1, F.array(F.concat(F.lit("matches "), F.size("hits").cast("string"), F.lit(" concepts")))).otherwise(F.array().cast("array<string>"))
    level2 = _items(hit, F.when(F.col("tables_first"), 3).otherwise(2), [F.col("cpos"), F.col("_nth")], 2, "supporting", F.concat(F.lit("concept:"), "h.name"), F.concat("h.reasons", many))

    first = level0.unionByName(level1).unionByName(level2)
    after = tasks.select("task_id", "paper_id", "task", "entity_type").join(F.broadcast(rules.select("entity_type", "tables", "all_tables", "tables_first", "full_lines")), "entity_type").filter("tables")
    before_tables = fold(first.join(after.filter("tables_first").select("task_id", F.lit(True).alias("_tf")), "task_id", "left").filter("_tf is null or step < 2").drop("_tf"), per_task)

    member = members.select("paper_id", "table_ord", "label", "anchor", "role", F.col("pos").alias("mpos"))
    inner = member.filter("role <> 'note'")
    start = before_tables.select("task_id", "anchor").union(seeds.select("task_id", "anchor")).distinct().join(after.select("task_id", "paper_id"), "task_id")
    of_table = inner.groupBy("paper_id", "anchor").agg(F.min("table_ord").alias("table_ord"))
    inside = start.join(of_table, ["paper_id", "anchor"]).select("task_id", "paper_id", "table_ord")
    pointed = refs.filter("kind = 'table'").select("paper_id", "from_anchor", "pos", "label", F.explode(F.array_distinct("targets")).alias("anchor"))
    pointed = pointed.join(member.filter("role = 'table'").select("paper_id", "anchor", "table_ord"), ["paper_id", "anchor"]).select("paper_id", "from_anchor", "pos", "label", "table_ord").distinct()
    through = start.join(pointed.withColumnRenamed("from_anchor", "anchor").select("paper_id", "anchor", "table_ord"), ["paper_id", "anchor"]).select("task_id", "paper_id", "table_ord")
    aimed = tb.filter("tables and on_target").select("task_id", "paper_id", "anchor").join(inner.select("paper_id", "anchor", "table_ord"), ["paper_id", "anchor"]).select("task_id", "paper_id", "table_ord")
    every = after.filter("all_tables and task = 'enumeration'").select("task_id", "paper_id").join(members.select("paper_id", "table_ord").distinct(), "paper_id").select("task_id", "paper_id", "table_ord")
    linked = inside.union(through).union(aimed).union(every).distinct()

    table_rows = linked.join(member, ["paper_id", "table_ord"]).join(tb.drop("paper_id"), ["task_id", "anchor"])
    nth = F.row_number().over(Window.partitionBy("task_id", "table_ord", "role").orderBy("mpos", "anchor"))
    table_rows = table_rows.withColumn("_nth", nth).filter("role = 'caption' or _nth = 1").withColumn("label", F.coalesce("label", F.concat(F.lit("table "), "anchor")))
    lines = F.size(F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x) != ""))
    small = (F.col("full_lines") > 0) & (lines <= F.col("full_lines"))
    kind = F.when(F.col("role") == "caption", "caption").when(F.col("role") == "note", "table_note").when(small, "table").otherwise("table_header")
    body = F.when((F.col("role") == "table") & ~small, table_head(F.col("text"))).otherwise(F.col("text"))
    part = F.when(F.col("role") == "caption", 0).when(F.col("role") == "table", 1).otherwise(2)
    word = F.when(F.col("role") == "caption", "caption_of:").when(F.col("role") == "table", "header_of:").otherwise("note_of:")
    level3 = _items(table_rows, F.when(F.col("tables_first"), 2).otherwise(3), [F.col("table_ord"), part, F.col("mpos")], 3, kind, F.concat(word, "label"), F.array(F.concat_ws(" ", "label", kind)), body=body)

    mention = Window.partitionBy("task_id", "table_ord").orderBy("pos", "from_anchor")
    named = linked.join(pointed, ["paper_id", "table_ord"]).withColumn("_nth", F.row_number().over(mention)).filter("_nth <= 2")
    named = named.select("task_id", "table_ord", F.col("from_anchor").alias("anchor"), "label", F.col("_nth").alias("rnth")).join(tb, ["task_id", "anchor"])
    level4 = _items(named, F.lit(4), [F.col("table_ord"), F.col("rnth")], 4, "cross_reference", F.concat(F.lit("refers_to:"), "label"), F.array(F.concat(F.lit("mentions "), "label")))

    wide = tb.withColumn("h", F.explode("hits")).withColumn("cpos", F.array_position(names, F.col("h.name"))).filter(F.exists("concepts", lambda c: (c["name"] == F.col("h.name")) & c["expected"]))
    wide = wide.withColumn("_nth", F.row_number().over(Window.partitionBy("task_id", "cpos").orderBy("ord", "anchor"))).filter("_nth <= 2")
    level5 = _items(wide, F.lit(5), [F.col("cpos"), F.col("ord")], 5, "supporting", F.concat(F.lit("concept:"), "h.name"), F.array(F.lit("whole-document search")), F.struct(F.col("h.name").alias("name"), F.col("cpos").alias("pos")))

    taken = _once(fold(first.unionByName(level3).unionByName(level4).unionByName(level5), per_task))
    of_caption = member.filter("role = 'caption'").groupBy("paper_id", "anchor").agg(F.max_by(F.coalesce("label", F.concat(F.lit("table "), "anchor")), "table_ord").alias("_caption"))
    items = taken.join(tasks.select("task_id", "paper_id"), "task_id").join(of_caption, ["paper_id", "anchor"], "left")
    is_caption = (F.col("kind") == "supporting") & F.col("_caption").isNotNull()
    items = items.withColumns({"kind": F.when(is_caption, "caption").otherwise(F.col("kind")), "relation": F.when(is_caption, F.concat(F.lit("caption_of:"), "_caption")).otherwise(F.col("relation"))})
    return items.select("task_id", "place", "level", "kind", "relation", "anchor", "ord", "reasons", "body", "truncated"), audit(tb, taken)


def audit(tb: DataFrame, taken: DataFrame) -> DataFrame:
    """Each concept of a task: FOUND, NOT_RETRIEVED, ABSENT_BY_PATTERN or NOT_FOUND_AFTER_FULL_SEARCH.

    An optional concept (not expected) has a row only if it is found. NOT_RETRIEVED names the first five blocks.
    """
    wanted = tb.groupBy("task_id").agg(F.first("concepts").alias("concepts")).select("task_id", F.posexplode("concepts").alias("cpos", "c"))
    wanted = wanted.select("task_id", (F.col("cpos") + 1).alias("cpos"), F.col("c.name").alias("concept"), F.col("c.expected").alias("expected"), F.col("c.detectable").alias("detectable"), F.col("c.signals").alias("wanted_signals"))
    got = taken.select("task_id", "anchor", "ord", F.col("level").alias("ilevel"), F.col("cpos").alias("icpos"), F.explode("hits").alias("concept"))
    got = wanted.select("task_id", "cpos", "concept").join(got, ["task_id", "concept"]).filter("icpos is null or icpos <= cpos")
    got = got.groupBy("task_id", "concept").agg(F.min("ilevel").alias("level"), F.array_sort(F.collect_set(F.struct("ilevel", "ord", "anchor"))).alias("_in"))
    there = tb.select("task_id", "ord", "anchor", F.explode("hits").alias("h")).groupBy("task_id", F.col("h.name").alias("concept"))
    there = there.agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "anchor"))), 1, 5).alias("_there"))
    seen = tb.select("task_id", F.explode("signals").alias("s")).groupBy("task_id").agg(F.collect_set("s").alias("_signals"))
    out = wanted.join(got, ["task_id", "concept"], "left").join(there, ["task_id", "concept"], "left").join(seen, "task_id", "left")
    absent = F.col("detectable") & (F.size("wanted_signals") > 0) & ~F.coalesce(F.arrays_overlap("wanted_signals", "_signals"), F.lit(False))
    status = F.when(F.col("_in").isNotNull(), "FOUND").when(F.col("_there").isNotNull(), "NOT_RETRIEVED").when(absent, "ABSENT_BY_PATTERN").otherwise("NOT_FOUND_AFTER_FULL_SEARCH")
    anchors = F.coalesce(F.transform("_in", lambda x: x["anchor"]), F.transform("_there", lambda x: x["anchor"]), F.array().cast("array<string>"))
    return out.filter("expected or _in is not null").select("task_id", "concept", "cpos", status.alias("status"), "level", anchors.alias("anchors"))


def packet_ids(tasks: DataFrame, items: DataFrame, hashes: DataFrame) -> DataFrame:
    """A packet's id: the hash of its document's hash (paper_id, document_hash), its task and its anchors by level and order."""
    anchors = items.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "ord", "anchor"))), lambda x: x["anchor"]).alias("a"))
    rows = tasks.join(hashes, "paper_id").join(anchors, "task_id", "left")
    parts = F.to_json(F.struct("document_hash", "task", "entity_type", "target", F.lit(VERSION).alias("version"), F.coalesce("a", F.array().cast("array<string>")).alias("anchors")))
    return rows.select("task_id", F.substring(F.sha2(parts, 256), 1, 12).alias("packet_id"))


def by_role(roles: DataFrame, blocks: DataFrame, cap: int = PACKET_CHARS) -> DataFrame:
    """A packet from roles (task_id, paper_id, role_pos, role, pos, anchor): each anchor once; the first that does not
    fit ends its role, and the next role goes on. An anchor without a block is passed over."""
    found = roles.join(blocks.select("paper_id", "anchor", "block_type", "text"), ["paper_id", "anchor"])
    body = F.substring(F.when(F.col("block_type") == "Table", table_head(F.col("text"))).otherwise(F.col("text")), 1, BLOCK_CHARS)
    kind = F.when(F.col("block_type") == "Table", "table_header").otherwise(F.col("role"))
    item = F.struct("role_pos", "pos", "anchor", kind.alias("kind"), F.concat("role", F.lit("_evidence")).alias("relation"), body.alias("body"))
    rows = found.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("ended"), F.slice("_items", 1, 0).alias("taken"))

    def step(acc, x):
        over = F.coalesce(acc["ended"] == x["role_pos"], F.lit(False)) | F.exists(acc["taken"], lambda y: y["anchor"] == x["anchor"])
        size = acc["used"] + F.length(x["body"])
        ends = F.struct(acc["used"].alias("used"), x["role_pos"].cast("long").alias("ended"), acc["taken"].alias("taken"))
        took = F.struct(size.cast("long").alias("used"), acc["ended"].alias("ended"), F.array_append(acc["taken"], x).alias("taken"))
        return F.when(over, acc).when(size > cap, ends).otherwise(took)

    taken = F.aggregate("_items", start, step, lambda acc: acc["taken"])
    return rows.select("task_id", F.posexplode(taken).alias("place", "_x")).select("task_id", "place", "_x.*")


def render(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """A packet as text: its blocks by level and order, each behind its anchor and origin, then the audit."""
    head = F.concat(F.lit("["), "anchor", F.lit("] "), F.concat_ws("; ", "kind", "relation", F.array_join(F.slice("reasons", 1, 4), ", ")))
    block = F.concat(head, F.lit("\n"), "body", F.when(F.col("truncated"), " [truncated]").otherwise(""))
    parts = items.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "ord", "anchor", block.alias("block")))), lambda x: x["block"]).alias("blocks"))
    line = F.concat(F.lit("- "), "concept", F.lit(": "), F.concat_ws(" ", "status", F.array_join(F.slice("anchors", 1, 5), ", ")))
    told = coverage.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cpos", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    none = F.array().cast("array<string>")
    both = parts.join(told, "task_id", "full").select("task_id", F.coalesce("blocks", none).alias("blocks"), F.coalesce("lines", none).alias("lines"))
    return both.select("task_id", F.concat_ws("\n\n", "blocks", F.when(F.size("lines") > 0, F.concat(F.lit("Coverage\n"), F.array_join("lines", "\n")))).alias("packet"))
