"""Document structure over blocks (paper_id, anchor, ord, block_type, text, page): blocks, regions, labels, tables, references, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block types by how they are treated.
POLICY = (
    *((t, "citable") for t in "Text SectionHeader Table Figure Picture Caption ListItem Footnote Equation".split()),
    ("TableCell", "provenance"),
    *((t, "silent") for t in "PageHeader PageFooter".split()),
    *((t, "container") for t in "Document Page TableGroup FigureGroup PictureGroup ListGroup".split()),
)
#: How headings of regions begin, the first region that fits decides; a final '-' lets any ending follow.
REGIONS = (
    ("references", ("references", "literature cited", "bibliography")),
    ("acknowledgements", ("acknowledg-", "funding-", "author contributions-")),
    ("supplementary", ("supporting information-", "supplementary-")),
    ("conclusions", ("summary and conclusion", "summary and conclusions", "conclusion", "conclusions")),
    ("abstract", ("abstract", "summary")),
    ("introduction", ("introduction", "background")),
    ("methods", ("material", "materials", "method", "methods", "experimental design-", "experimental procedure-")),
    ("results", ("result", "results")),
    ("discussion", ("discussion",)),
)
#: Words before the number of a label.
TABLE_WORDS, FIGURE_WORDS = ("table", "tab"), ("fig", "figs", "figure", "figures")
_LABEL = r"^[^A-Za-z0-9]*([A-Za-z]+)\.?\s*([0-9]+|[IVXivx]+)\b"
_REFERENCE = r"\b([A-Z][a-z]+\.?\s*[0-9]+(?:(?:\s*[,&–-]\s*|\s+and\s+)[0-9]+)*)"
REFERENCES = (("Table", ("table", "tables", "tab")), ("Figure", FIGURE_WORDS))
RUN_IN_CHARS, CAPTION_REACH, BARE_LABEL = 60, 8, 8
FURNITURE = ("PageHeader", "PageFooter")


def line_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One block for each line, in order from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "block"))


def anchored_blocks(papers: DataFrame) -> DataFrame:
    """(paper_id, content) as blocks: the text BEFORE an anchor belongs to it; order is the anchor's number."""
    parts = F.split("content", "⟦b:\\d+⟧")
    names = F.regexp_extract_all("content", F.lit("⟦(b:\\d+)⟧"), F.lit(1))
    rows = papers.select("paper_id", F.explode(F.arrays_zip(names.alias("anchor"), F.slice(parts, 1, F.size(names)).alias("text_raw"))).alias("b")).select("paper_id", "b.*")
    return rows.withColumn("text", F.regexp_replace("text_raw", r"^\s+|\s+$", "")).withColumn("ord", F.substring("anchor", 3, 20).cast("int"))


def region_of_heading(text: Column) -> Column:
    """The region whose beginning the heading has, as whole words."""
    heading = F.concat(F.regexp_replace(F.lower(text), r"^[^a-z0-9]+|[^a-z0-9]+", " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for region, beginnings in reversed(REGIONS):
        fits = F.lit(False)
        for b in beginnings:
            fits = fits | F.startswith(F.ltrim(heading), F.lit(b[:-1] if b.endswith("-") else b + " "))
        out = F.when(fits, F.lit(region)).otherwise(out)
    return out


def table_label(text: Column) -> Column:
    return _label(text, TABLE_WORDS, "Table ")


def figure_label(text: Column) -> Column:
    return _label(text, FIGURE_WORDS, "Figure ")


def _number_behind(text: Column, words: tuple) -> Column:
    """The number of a label that the text starts with; figures have no Roman ones."""
    number = F.regexp_extract(text, _LABEL, 2)
    fits = F.lower(F.regexp_extract(text, _LABEL, 1)).isin(*words)
    return F.when(fits if words == TABLE_WORDS else fits & number.rlike("^[0-9]"), number)


def _label(text: Column, words: tuple, kind: str) -> Column:
    """The label at the start, else the one at the start of what follows 'Caption:'."""
    at = F.instr(F.lower(text), "caption:")
    behind = F.when(at > 0, F.substring(text, at + 8, F.length(text)))
    return F.concat(F.lit(kind), F.coalesce(_number_behind(text, words), _number_behind(behind, words)))


def _starts_with_label(text: Column) -> Column:
    return _number_behind(text, TABLE_WORDS).isNotNull() | _number_behind(text, FIGURE_WORDS).isNotNull()


def is_run_in_heading(block_type: Column, text: Column) -> Column:
    """A short text that starts with a capital, ends no sentence and is no label."""
    return (block_type == "Text") & (text != "") & (F.length(text) <= RUN_IN_CHARS) & ~F.rtrim(text).rlike(r"[.,;:]$") & text.rlike(r"(?U)^\p{Lu}") & ~_starts_with_label(text)


def with_regions(blocks: DataFrame) -> DataFrame:
    """Region and section as they hold in reading order: front_matter until a heading says otherwise.

    A run-in heading opens any region but the abstract; a label never opens a section.
    """
    header, run_in = F.col("block_type") == "SectionHeader", is_run_in_heading(F.col("block_type"), F.col("text"))
    told = region_of_heading(F.col("text"))
    change = F.when(header, told).when(run_in & (told != "abstract"), told)
    section = F.when((header | run_in) & ~_starts_with_label(F.col("text")), F.trim(F.regexp_replace("text", r"^[#* ]+", "")))
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("region", F.coalesce(F.last(change, True).over(w), F.lit("front_matter"))).withColumn("section", F.last(section, True).over(w))


def table_columns(text: Column) -> Column:
    """Columns of a rendered table: the pipes of its first line less one."""
    first = F.substring_index(text, "\n", 1)
    return F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1


def table_continuations(blocks: DataFrame) -> DataFrame:
    """Tables with the one they continue: nothing but page furniture between, no label, the same or the next page, as many columns."""
    w = Window.partitionBy("paper_id").orderBy("ord")
    is_table = F.col("block_type") == "Table"
    between = F.when(~is_table & ~F.col("block_type").isin(*FURNITURE), 1).otherwise(0)
    rows = blocks.withColumn("_solid", F.sum(between).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(is_table).withColumn("columns", table_columns(F.col("text")))
    same = (F.lag("_solid").over(w) == F.col("_solid")) & (F.col("page") - F.lag("page").over(w)).isin(0, 1) & (F.lag("columns").over(w) == F.col("columns")) & table_label(F.col("text")).isNull()
    return rows.withColumn("continuation_of", F.when(same, F.lag("anchor").over(w))).drop("_solid")


def linked_tables(blocks: DataFrame) -> DataFrame:
    """Chains of tables with the nearest label at most CAPTION_REACH blocks before their head, not past another table."""
    w = Window.partitionBy("paper_id").orderBy("ord")
    solid = blocks.filter(~F.col("block_type").isin(*FURNITURE))
    label = F.struct(table_label(F.col("text")).alias("label"), F.col("anchor").alias("caption_anchor"))
    before = w.rowsBetween(-CAPTION_REACH, -1)
    near = solid.withColumn("_cap", F.last(F.when(table_label(F.col("text")).isNotNull() & (F.col("block_type") != "Table"), F.struct("ord", label.alias("l"))), True).over(before))
    near = near.withColumn("_prev", F.last(F.when(F.col("block_type") == "Table", F.col("ord")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    heads = near.filter("block_type = 'Table'").select("paper_id", "anchor", F.when(F.col("_prev").isNull() | (F.col("_cap.ord") > F.col("_prev")), F.col("_cap.l")).alias("cap"))
    chained = table_continuations(blocks).withColumn("chain", F.sum(F.when(F.col("continuation_of").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = chained.join(heads, ["paper_id", "anchor"])
    return rows.groupBy("paper_id", "chain").agg(F.min_by("anchor", "ord").alias("head"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "anchor"))), lambda x: x["anchor"]).alias("anchors"), F.min_by("cap", "ord").alias("cap")).select("paper_id", "head", "anchors", "cap.label", "cap.caption_anchor")


def figures(blocks: DataFrame) -> DataFrame:
    """The first block of each figure label."""
    rows = blocks.withColumn("label", figure_label(F.col("text"))).filter("label is not null")
    return rows.groupBy("paper_id", "label").agg(F.min_by("anchor", "ord").alias("anchor"))


def cross_references(rows: DataFrame, text: str) -> DataFrame:
    """rows with a target for each label their text names; a dash between two numbers less than ten apart spans them."""
    found = None
    for kind, words in REFERENCES:
        named = F.filter(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), lambda r: F.lower(F.regexp_extract(r, "^([A-Za-z]+)", 1)).isin(*words))
        hits = rows.withColumn("_ref", F.explode(named))
        numbers = F.transform(F.regexp_extract_all("_ref", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
        spans = F.col("_ref").rlike("[–-]") & (F.size(numbers) == 2) & (numbers[1] - numbers[0] < 10) & (numbers[1] >= numbers[0])
        hits = hits.withColumn("_n", F.explode(F.when(spans, F.sequence(numbers[0], numbers[1])).otherwise(numbers)))
        hits = hits.withColumn("target", F.concat(F.lit(f"{kind} "), F.col("_n").cast("string"))).drop("_ref", "_n")
        found = hits if found is None else found.unionByName(hits)
    return found


def neighbours(blocks: DataFrame, before: int, after: int, types: list[str] | None = None) -> DataFrame:
    """Each block's anchor with those of up to ``before`` and ``after`` blocks of the wanted types around it."""
    rows = blocks if types is None else blocks.filter(F.col("block_type").isin(types))
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(-before, after)
    return rows.select("paper_id", "anchor", F.collect_list("anchor").over(w).alias("around"))


def section(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks of the first section whose heading contains the name, to the next heading of its level or above."""
    level = F.when(F.col("block_type") == "SectionHeader", F.length(F.regexp_extract("text", "^(#*)", 1)))
    rows = blocks.withColumn("_level", level)
    start = rows.filter(F.col("_level").isNotNull() & F.contains(F.lower("text"), F.lit(name.lower()))).groupBy("paper_id").agg(F.min(F.struct("ord", "_level")).alias("s"))
    inside = rows.join(start, "paper_id").filter("ord >= s.ord")
    stop = inside.filter("ord > s.ord and _level <= s._level").groupBy("paper_id").agg(F.min("ord").alias("_stop"))
    return inside.join(stop, "paper_id", "left").filter("_stop is null or ord < _stop").drop("_level", "s", "_stop")


def sections(blocks: DataFrame) -> DataFrame:
    """Distinct section paths in the order of their first block."""
    return blocks.groupBy("paper_id", "section_path").agg(F.min("ord").alias("first"))


def under_path(blocks: DataFrame, path: list[str]) -> DataFrame:
    """Blocks whose section path starts with the given one, case aside."""
    own = F.transform(F.slice("section_path", 1, len(path)), F.lower)
    return blocks.filter(own == F.array(*[F.lit(p.lower()) for p in path]))


def grid(cells: DataFrame) -> DataFrame:
    """Rows of each table as arrays by column, gaps as empty strings."""
    filled = cells.filter("row_index is not null and col_index is not null")
    width = Window.partitionBy("paper_id", "parent_table_anchor")
    rows = filled.withColumn("w", F.max("col_index").over(width)).groupBy("paper_id", "parent_table_anchor", "row_index").agg(F.max("w").alias("w"), F.map_from_entries(F.collect_list(F.struct("col_index", "cell_text"))).alias("m"))
    return rows.select("paper_id", "parent_table_anchor", "row_index", F.transform(F.sequence(F.lit(0), F.col("w")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("cells"))


def table_row(cells: DataFrame) -> DataFrame:
    """Rows compacted in column order, cells without a column first."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("col_index", F.lit(-1)).alias("c"), "cell_text")))
    return cells.groupBy("paper_id", "parent_table_anchor", "row_index").agg(F.transform(ordered, lambda x: x["cell_text"]).alias("cells"))


def scaled(values: Column, size: float) -> Column:
    return F.transform(values, lambda v: v.cast("double") / size)


def normalized_polygons(locators: DataFrame, pages: DataFrame) -> DataFrame:
    """Polygons over their page's width and height; those without a page are left out."""
    found = locators.join(pages.select("paper_id", "page", "width", "height"), ["paper_id", "page"])
    return found.withColumn("polygon", F.transform("polygon", lambda p: F.array(p[0] / F.col("width"), p[1] / F.col("height"))))


# ------------------------------------------------------------------ quality

_TAG = r"/?[A-Za-z][A-Za-z0-9]*\b"
#: Leftovers of markup in final text.
LEAKS = {
    "html_escaped_tag_fragment": rf"&lt;{_TAG}[^&]*&gt;",
    "raw_unrendered_tag": rf"<(?!/?math\b){_TAG}[^<>]*>",
    "leftover_content_ref": "<content-ref",
    "dangling_amp_entity": "&amp;(?:lt|gt|amp);",
}


def leak_sweep(rows: DataFrame, text: str, patterns: dict[str, str] = LEAKS) -> DataFrame:
    """Hits and rows of each pattern: one pass with a column for each, then unpivoted."""
    counts = rows.select(*[F.regexp_count(text, F.lit(p)).alias(n) for n, p in patterns.items()])
    sums = counts.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(f"{n}_h") for n in patterns], *[F.count_if(F.col(n) > 0).alias(f"{n}_r") for n in patterns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_h").alias("hits"), F.col(f"{n}_r").alias("rows")) for n in patterns])).alias("x")).select("x.*")


def uncovered(rows: DataFrame, column: str, policy: DataFrame) -> DataFrame:
    """Values that the policy does not know, with their number: counted first, so that the join is small."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).join(policy, column, "left_anti")


def round_trip(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """Keys of either side with the side they stand on."""
    a, b = left.select(F.col(key).alias("_a")), right.select(F.col(key).alias("_b"))
    state = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise(names[2])
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), state.alias("state"))


def quality_report(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each paper: duplicate anchors, anchors only in text or only in provenance, unknown types, passed."""
    seen = anchors.groupBy("paper_id", "anchor").agg(F.count("*").alias("times"))
    both = seen.join(blocks.withColumn("_in", F.lit(True)), ["paper_id", "anchor"], "full")
    rendered = F.coalesce("rendered_in_content_md", F.lit(False))
    known = [t for t, _ in POLICY]
    out = both.groupBy("paper_id").agg(
        F.count_if(F.col("times") > 1).alias("duplicates"), F.count_if(F.col("_in").isNull()).alias("no_provenance"),
        F.count_if(F.col("times").isNull() & rendered).alias("not_in_text"), F.count_if(F.col("times").isNotNull() & F.col("_in").isNotNull() & ~rendered).alias("marked_unrendered"),
        F.count_if(F.col("_in").isNotNull() & ~F.col("block_type").isin(known)).alias("unknown_types"),
    )
    return out.withColumn("passed", F.expr("duplicates + no_provenance + not_in_text + marked_unrendered + unknown_types = 0"))
