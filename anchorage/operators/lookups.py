"""Lookups over a document's blocks and tables, over attempts of a run, and counts for reports.

``blocks``: paper_id, anchor, ord, text, block_type, region. ``members``: paper_id, table_ord, label, anchor, role, pos.
``attempts``: paper_id, run_id, record_key, stage, attempt, data (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Block types that are no prose; characters of a table's text in a prompt.
NOT_PROSE = ("Table", "Figure", "Picture", "PageHeader", "PageFooter", "SectionHeader", "Caption")
TABLE_CHARS = 16000


def region_blocks(blocks: DataFrame, regions: list[str], prose_only: bool = False) -> DataFrame:
    """Blocks of the given regions, prose alone if asked."""
    rows = blocks.filter(F.col("region").isin(regions))
    return rows.filter(~F.col("block_type").isin(*NOT_PROSE)) if prose_only else rows


def table_containing(anchors: DataFrame, members: DataFrame) -> DataFrame:
    """The first logical table that each anchor is a table or caption of; NULL where there is none."""
    first = members.filter("role in ('table', 'caption')").groupBy("paper_id", "anchor").agg(F.min_by(F.struct("table_ord", "label"), "table_ord").alias("t"))
    return anchors.join(first, ["paper_id", "anchor"], "left").select(*anchors.columns, F.col("t.table_ord").alias("table_ord"), F.col("t.label").alias("label"))


def references_to(refs: DataFrame, members: DataFrame) -> DataFrame:
    """References (paper_id, from_anchor, label, targets) with the tables that hold one of their targets: one row a pair."""
    each = refs.select("paper_id", "from_anchor", "label", F.explode(F.array_distinct("targets")).alias("anchor"))
    tables = members.filter("role = 'table'").select("paper_id", "anchor", "table_ord")
    return each.join(tables, ["paper_id", "anchor"]).select("paper_id", "table_ord", "from_anchor", "label").distinct()


def refs_from(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The references that stand in the given blocks."""
    return refs.join(anchors.select("paper_id", F.col("anchor").alias("from_anchor")).distinct(), ["paper_id", "from_anchor"], "left_semi")


def anchor_key(anchor: Column) -> Column:
    """An anchor without brackets and blanks around it."""
    return F.trim(F.regexp_replace(F.trim(anchor), r"^\[+|\]+$", ""))


def block_text(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Texts by anchor, however written; NULL where there is no such block."""
    rows = wanted.withColumn("_key", anchor_key(F.col("anchor")))
    return rows.join(blocks.select("paper_id", F.col("anchor").alias("_key"), "text"), ["paper_id", "_key"], "left").select(*wanted.columns, "text")


def box(values: Column) -> Column:
    """A box of four numbers, else NULL."""
    return F.when((F.size(values) == 4) & F.forall(values, lambda x: x.isNotNull()), values)


def prose_tokens(blocks: DataFrame, least: int = 4) -> DataFrame:
    """Prose blocks with the set of their significant tokens and their normalised text."""
    rows = blocks.filter(~F.col("block_type").isin(*NOT_PROSE))
    return rows.select("paper_id", "anchor", "ord", F.array_sort(F.array_distinct(T.significant_tokens(F.col("text"), least))).alias("tokens"), T.canon(F.col("text")).alias("normal"))


def table_text(members: DataFrame, blocks: DataFrame, most: int = TABLE_CHARS) -> DataFrame:
    """Caption, table and notes of each logical table as they stand, cut at ``most`` characters, and whether it was cut."""
    part = F.when(F.col("role") == "caption", 0).when(F.col("role") == "table", 1).otherwise(2)
    rows = members.join(blocks.select("paper_id", "anchor", "text"), ["paper_id", "anchor"]).select("paper_id", "table_ord", F.struct(part.alias("part"), "pos", "anchor", F.concat(F.lit("["), "anchor", F.lit("] "), "text").alias("line")).alias("x"))
    whole = rows.groupBy("paper_id", "table_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("t"))
    return whole.select("paper_id", "table_ord", F.substring("t", 1, most).alias("text"), (F.length("t") > most).alias("cut"))


def rendered_order(blocks: DataFrame, provenance: DataFrame) -> DataFrame:
    """Blocks that both the text and the provenance have, in anchor order, with emphasis taken off their ends."""
    both = blocks.join(provenance.select("paper_id", "anchor").distinct(), ["paper_id", "anchor"], "left_semi")
    return both.withColumn("excerpt", F.regexp_replace("text", r"^[*_\s]+|[*_\s]+$", "")).orderBy("paper_id", "ord")


def read_provenance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Provenance maps (one JSON object by anchor a file) as rows: paper_id (the file's folder), anchor, entry (JSON text).

    A broken file gives no row; a paper without a file is simply absent, for a left join.
    """
    files = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("paper_id"), "value")
    entries = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return files.select("paper_id", F.explode(entries).alias("anchor", "entry")).withColumn("anchor", anchor_key(F.col("anchor")))


# ---- attempts of runs


def attempt_conflicts(attempts: DataFrame) -> DataFrame:
    """Attempts that stand more than once with different data: none may be overwritten."""
    keys = ["paper_id", "run_id", "record_key", "stage", "attempt"]
    return attempts.groupBy(*keys).agg(F.count_distinct("data").alias("n")).filter("n > 1")


def records_of(attempts: DataFrame) -> DataFrame:
    """The record keys of each run in order."""
    return attempts.groupBy("paper_id", "run_id").agg(F.array_sort(F.collect_set("record_key")).alias("records"))


def final_records(attempts: DataFrame) -> DataFrame:
    """Each record's last 'final' data of a run, and whether it can be read; records without one have NULL."""
    keys = ["paper_id", "run_id", "record_key"]
    last = attempts.groupBy(*keys).agg(F.max_by(F.when(F.col("stage") == "final", F.col("data")), F.when(F.col("stage") == "final", F.col("attempt"))).alias("final"))
    return last.withColumn("readable", F.expr("try_parse_json(final)").isNotNull())


def cached(attempts: DataFrame, prefix: str, field: str, status: str | None = None) -> DataFrame:
    """A field of the final data of a run's records whose key starts with a prefix, of one status if asked."""
    rows = final_records(attempts).filter(F.startswith("record_key", F.lit(prefix)))
    read = lambda f: F.get_json_object("final", f"$.{f}")
    rows = rows if status is None else rows.filter(read("status") == status)
    return rows.select("paper_id", "run_id", "record_key", read(field).alias(field))


def runs(attempts: DataFrame) -> DataFrame:
    """The catalogue of papers and their runs."""
    return attempts.groupBy("paper_id").agg(F.array_sort(F.collect_set("run_id")).alias("runs"))


# ---- event streams: one JSON event a line


def stream_events(streams: DataFrame, text: str) -> DataFrame:
    """The events of each stream that can be read: type, status of a tool's call, whether it is the known format defect."""
    line = streams.withColumn("_line", F.explode(F.split(text, "\n"))).withColumn("_v", F.expr("try_parse_json(_line)"))
    field = lambda p: F.expr(f"try_variant_get(_v, '$.{p}', 'string')")
    defect = F.col("_line").rlike(r"<\|channel\|>") & F.contains("_line", F.lit("unavailable tool"))
    return line.filter(F.startswith(F.trim("_line"), F.lit("{")) & F.col("_v").isNotNull()).select(*[c for c in streams.columns if c != text], field("type").alias("type"), field("part.state.status").alias("tool_status"), defect.alias("defect"))


def stream_state(streams: DataFrame, text: str, key: str) -> DataFrame:
    """Each stream's kind: answered, stall (a tool was used, no answer came), outage (errors or nothing) or no_answer.

    ``streams``: the key, the text, final_text, returncode. A format defect is no outage and no stall.
    """
    e = stream_events(streams.select(key, text), text)
    counted = e.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "error").alias("errors"), F.count_if((F.col("type") == "error") & ~F.col("defect")).alias("real"), F.count_if(F.col("tool_status") == "completed").alias("tools"), F.bool_or("defect").alias("defect"))
    rows = streams.select(key, "final_text", "returncode").join(counted, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    defect = F.coalesce("defect", F.lit(False))
    kind = (
        F.when(F.col("final_text").isNotNull(), "answered")
        .when(~defect & (F.col("returncode") == 0) & (zero("errors") == 0) & (zero("tools") > 0), "stall")
        .when(~defect & ((zero("n") == 0) | (zero("real") > 0)), "outage")
        .otherwise("no_answer")
    )
    return rows.select(key, kind.alias("state"))


# ---- reports


def quality_summary(found: DataFrame) -> DataFrame:
    """Issues by paper and kind in one row a paper: ``found`` has paper_id, kind (NULL for none) and missing (no input)."""
    by = found.groupBy("paper_id", "kind").agg(F.count("*").alias("n"), F.bool_or("missing").alias("missing"))
    per = by.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))).alias("issues"), F.bool_or("missing").alias("missing"))
    return per.withColumn("passed", (F.size("issues") == 0) & ~F.col("missing"))


def quality_totals(summaries: DataFrame) -> DataFrame:
    """One row: papers found, passed, failed and without input."""
    return summaries.agg(F.count("*").alias("found"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("missing").alias("missing"))


def cause_counts(records: DataFrame) -> DataFrame:
    """Records that are not ready by entity type and cause."""
    return records.filter("cause is not null").groupBy("entity_type", "cause").agg(F.count("*").alias("n"))


def cited_anchors(fields: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct anchors that a record's fields cite, sorted, the first ``most`` if asked."""
    rows = fields.groupBy("paper_id", "record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("locators", anchor_key))))).alias("anchors"))
    return rows if most is None else rows.withColumn("anchors", F.slice("anchors", 1, most))


def summaries(fields: DataFrame, shown: dict[str, list[str]], most: int = 80) -> DataFrame:
    """Each record in a line: the fields shown for its type, those that have a value, cut at ``most`` characters; else its id."""
    order = F.create_map(*[F.lit(x) for e, names in shown.items() for n, f in enumerate(names) for x in (f"{e}.{f}", n)])
    rows = fields.withColumn("_n", F.element_at(order, F.concat_ws(".", "entity_type", "path")))
    told = F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull() & (F.trim(F.coalesce("value", F.lit(""))) != ""), F.struct("_n", F.trim("value").alias("v")))))
    line = F.array_join(F.transform(told, lambda x: x["v"]), " · ")
    out = rows.groupBy("paper_id", "entity_type", "record_id").agg(line.alias("_l"))
    cut = F.when(F.length("_l") > most, F.concat(F.rtrim(F.substring("_l", 1, most - 1)), F.lit("…"))).otherwise(F.col("_l"))
    return out.select("paper_id", "entity_type", "record_id", F.when(F.col("_l") == "", F.col("record_id").cast("string")).otherwise(cut).alias("summary"))


def matches_first(rows: DataFrame, text: str, order: str, query: str) -> DataFrame:
    """Rows whose text contains the query first, each half in the order it had; an empty query changes nothing."""
    hit = F.contains(F.lower(text), F.lit(query.strip().lower())) if query.strip() else F.lit(False)
    return rows.orderBy(F.coalesce(hit, F.lit(False)).desc(), order)
